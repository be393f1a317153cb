"""Generation summaries: status counts, expirations, and the ordered list of reserves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.facts import delivery, is_expiration, projects_delivery
from loghelm.schema import GENERATION

STATUSES = ("sent", "delivered", "deferred", "bounced", "unknown")


def summaries(rows: DataFrame) -> DataFrame:
    """One row per generation, in two nested aggregations of one reading of the rows: by generation
    and address (none for other facts), then by generation. Both keys extend the key that the
    stream windows are partitioned by, so neither adds a shuffle."""
    counted = (F.col("kind") == "delivery") & projects_delivery()
    told = delivery()
    rows = rows.where(F.col("reason") == "resolved").select(
        *GENERATION, "t", "place", "start_offset", "receipt", "cross_stream",
        F.when(F.col("removed"), F.col("t")).alias("removed_t"),
        (F.col("time_quality") != "explicit_offset").alias("non_explicit"),
        F.when(counted, told["recipient"]).alias("address"),
        F.when(counted, told["status"]).alias("status"),
        is_expiration().cast("int").alias("expires"),
        ((F.col("kind") == "delivery") & ~projects_delivery()).cast("int").alias("unprojected"),
    )
    # the latest instant with its greatest, and with its smallest status
    per = rows.groupBy(*GENERATION, "address").agg(
        F.max(F.struct("t", "status"))["status"].alias("hi"),
        F.min(F.struct(-F.col("t"), F.col("status")))["status"].alias("lo"),
        F.min("t").alias("first_t"),
        F.min(F.struct("place", "start_offset")).alias("head"),
        F.max("removed_t").alias("removed_t"),
        F.max("receipt").alias("receipt"),
        F.max("non_explicit").alias("non_explicit"),
        F.max("cross_stream").alias("cross_stream"),
        F.count(F.lit(1)).alias("n"),
        F.sum("expires").alias("expires"),
        F.sum("unprojected").alias("unprojected"),
    )
    found = F.col("address").isNotNull()
    tie, empty = F.col("hi") != F.col("lo"), F.col("address") == ""
    per = per.withColumn("observed", F.when(found, F.when(tie | empty, F.lit("unknown")).otherwise(F.col("lo"))))
    out = per.groupBy(*GENERATION).agg(
        F.min("first_t").alias("first_t"),
        F.min("head")["start_offset"].alias("first_start"),
        F.max("removed_t").alias("removed_t"),
        F.max("receipt").alias("receipt_observed"),
        F.max("non_explicit").alias("non_explicit_time"),
        F.max("cross_stream").alias("cross_stream_uncertain"),
        F.sum("n").alias("n_facts"),
        F.sum("expires").alias("expiration_reports"),
        F.sum("unprojected").alias("n_unprojected"),
        F.count("address").alias("n_recipients"),
        *[F.count_if(F.col("observed") == s).alias(s) for s in STATUSES],
        F.max(empty).alias("unspecified"),
        F.max(found & tie).alias("uncertain"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    # the order of the reserves is fixed
    reserves = (
        (F.lit(True), "coverage_unproven"),
        (~F.col("receipt_observed"), "receipt_not_observed"),
        (F.col("removed_t").isNull(), "removal_not_observed"),
        (F.col("non_explicit_time"), "non_explicit_time"),
        (F.col("cross_stream_uncertain"), "cross_stream_uncertain"),
        (zero("n_recipients") == 0, "no_recipients_observed"),
        (flag("unspecified"), "address_unspecified"),
        (flag("uncertain"), "latest_order_uncertain"),
        (zero("unknown") > 0, "unknown_result"),
        (F.col("n_unprojected") > 0, "unprojected_deliveries"),
    )
    listed = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in reserves]), lambda x: x.isNotNull())
    return out.select(*GENERATION, "first_start", "first_t", "removed_t", "n_facts", zero("n_recipients").alias("n_recipients"), *[zero(s).alias(s) for s in STATUSES], "expiration_reports", "n_unprojected", listed.alias("reserves"))
