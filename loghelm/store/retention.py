"""Which facts retention may show, and which it may purge: plans over the stored tables.

A preview shows dated facts of an instance before an instant that a checkpoint with an anchor
covers. A purge is stricter: the origin must be a retired file, or one whose import runs have all
been completed, with every byte read and the checkpoint at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORIGIN = ("source_id", "origin_id")


def covered(facts: DataFrame, checkpoints: DataFrame, instance: str, before_ns: int) -> DataFrame:
    """Dated facts (with the column search_ns) that a checkpoint covers."""
    marks = checkpoints.where(F.col("anchor") != "").select(*ORIGIN, F.col("offset").alias("covered_to"))
    old = facts.where((F.col("instance") == instance) & (F.col("search_ns") < before_ns))
    return old.join(marks, list(ORIGIN)).where(F.col("end_offset") <= F.col("covered_to")).select(*facts.columns)


def finished_origins(origins: DataFrame, imports: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Origins of which nothing more can come: one row per origin, joined and aggregated by origin."""
    retired = origins.where(F.col("state") == "retired").select(*ORIGIN)
    followed = origins.select(*ORIGIN)
    done = (F.col("status") == "complete") & (F.col("end_offset") == F.col("content_bytes")) & (F.col("offset") == F.col("content_bytes"))
    runs = imports.select(*ORIGIN, "status", "end_offset", "content_bytes").join(checkpoints.select(*ORIGIN, "offset"), list(ORIGIN), "left")
    whole = runs.groupBy(*ORIGIN).agg(F.min(F.coalesce(done, F.lit(False))).alias("done")).where("done").select(*ORIGIN)
    return retired.unionByName(whole.join(followed, list(ORIGIN), "left_anti")).distinct()


def purgeable(facts: DataFrame, checkpoints: DataFrame, origins: DataFrame, imports: DataFrame, instance: str, before_ns: int) -> DataFrame:
    """Covered facts of finished origins."""
    return covered(facts, checkpoints, instance, before_ns).join(finished_origins(origins, imports, checkpoints), list(ORIGIN), "left_semi")
