"""Recipient results: all attempts of an exact address in a generation, and the latest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.facts import delivery, projects_delivery
from loghelm.schema import GENERATION, REF


def attempts(rows: DataFrame) -> DataFrame:
    """Delivery reports of resolved generations, with address and status columns."""
    d = rows.where((F.col("reason") == "resolved") & projects_delivery()).withColumn("delivery", delivery())
    return d.withColumns({"address": F.col("delivery.recipient"), "status": F.col("delivery.status")})


def unprojected(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("reason") == "resolved") & (F.col("kind") == "delivery") & ~projects_delivery())


def recipients(rows: DataFrame) -> DataFrame:
    """One row per (generation, address). The latest are all attempts at the greatest date; if
    their statuses differ, or the address is empty, the observed status is unknown."""
    key = (*GENERATION, "address")
    d = attempts(rows).withColumn("latest", F.col("t") == F.max("t").over(Window.partitionBy(*key)))
    attempt = F.struct("t", *REF, "delivery")
    out = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if("latest").alias("n_latest"),
        F.min(F.when(F.col("latest"), F.col("status"))).alias("lo"),
        F.max(F.when(F.col("latest"), F.col("status"))).alias("hi"),
        F.array_sort(F.collect_list(attempt)).alias("attempts"),
        F.array_sort(F.collect_list(F.when(F.col("latest"), attempt))).alias("latest"),
    )
    tie = F.col("lo") != F.col("hi")
    empty = F.col("address") == ""
    return out.select(*key, "n_attempts", "n_latest", F.when(tie | empty, F.lit("unknown")).otherwise(F.col("lo")).alias("observed_status"), tie.alias("order_uncertain"), empty.alias("address_unspecified"), "attempts", "latest")
