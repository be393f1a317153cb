"""What becomes of records that are sent to a store that may know them already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.scalars import framed
from loghelm.schema import REF

PURGE_DOMAIN = "loghelm-purge-1"
START = list(REF[:3])


def purge_digest():
    """Commitment to the bytes of a purged record."""
    return F.sha2(framed(F.lit(PURGE_DOMAIN), F.hex("raw"), F.col("parse_error")), 256)


def outcomes(records: DataFrame, stored: DataFrame, purged: DataFrame) -> DataFrame:
    """records with `outcome`: new, stored (the same is there), skipped (the same was purged) or
    collision (something else is or was at that place). One row per record."""
    old = stored.select(*START, F.col("end_offset").alias("old_end"), F.col("raw").alias("old_raw"), F.lit(True).alias("is_stored"))
    gone = purged.select(*START, F.col("digest").alias("old_digest"))
    same = (F.col("old_end") == F.col("end_offset")) & F.col("old_raw").eqNullSafe(F.col("raw"))
    outcome = (
        F.when(F.col("is_stored"), F.when(same, "stored").otherwise("collision"))
        .when(F.col("old_digest").isNotNull(), F.when(F.col("old_digest") == purge_digest(), "skipped").otherwise("collision"))
        .otherwise("new")
    )
    met = records.join(old, START, "left").join(gone, START, "left")
    return met.select(*[F.col(c) for c in records.columns], outcome.alias("outcome"))
