"""Queue generations: receipt-to-removal cycles within one stream, or a whole refusal of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.operators.partition import indexed, message_id
from loghelm.schema import GENERATION, REF, STREAM


def assigned(facts: DataFrame) -> DataFrame:
    """Queued facts with their cycle (from 0) and the stream's reason, 'resolved' if it has none.

    Windows only. The physical order (offsets) finds dates that contradict a removal; the timed
    order counts cycles, each of which must open with a later receipt, and compares message ids.
    The first violation in timed order names the reason.
    """
    rows = indexed(facts).where("queued")
    stream = Window.partitionBy(*STREAM)
    physical = stream.orderBy("start_offset").rowsBetween(Window.unboundedPreceding, -1)
    timed = stream.orderBy(F.col("t").asc_nulls_last(), "start_offset")
    t, removed = F.col("t"), F.col("removed")
    rows = rows.withColumns({"last_removal": F.last(F.when(removed, t), ignorenulls=True).over(physical), "max_before": F.max("t").over(physical)})
    conflict = F.coalesce(t <= F.col("last_removal"), F.lit(False)) | (removed & F.coalesce(F.col("max_before") > t, F.lit(False)))
    rows = rows.withColumns({"conflict": conflict, "after_removal": F.coalesce(F.lag("removed").over(timed), F.lit(False)), "t_before": F.lag("t").over(timed), "place": F.row_number().over(timed)})
    rows = rows.withColumn("cycle", F.sum(F.col("after_removal").cast("int")).over(timed.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    in_cycle = Window.partitionBy(*GENERATION).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("message_id", message_id())
    rows = rows.withColumn("first_message_id", F.first("message_id", ignorenulls=True).over(in_cycle))
    opens = F.col("receipt") & F.coalesce(t > F.col("t_before"), F.lit(False))
    violation = F.when(F.col("after_removal") & ~opens, F.lit("boundary_unproven")).when(F.col("message_id") != F.col("first_message_id"), F.lit("conflicting_message_ids"))
    rows = rows.withColumn("violation", F.when(violation.isNotNull(), F.struct(F.col("place").alias("place"), violation.alias("why"))))
    reason = (
        F.when(F.count(F.lit(1)).over(stream) != F.count("t").over(stream), F.lit("undated"))
        .when(F.max("conflict").over(stream), F.lit("boundary_unproven"))
        .otherwise(F.coalesce(F.min("violation").over(stream)["why"], F.lit("resolved")))
    )
    return rows.withColumn("reason", reason).drop("last_removal", "max_before", "conflict", "after_removal", "t_before", "violation", "first_message_id")


def generations(rows: DataFrame) -> DataFrame:
    """One row per generation of assigned facts, with its facts in timed order."""
    fact = F.struct("place", *REF)
    return (
        rows.where(F.col("reason") == "resolved")
        .groupBy(*GENERATION)
        .agg(
            F.min("t").alias("first_t"),
            F.min(F.struct("place", "start_offset", "end_offset")).alias("head"),
            F.max(F.when(F.col("removed"), F.col("t"))).alias("removed_t"),
            F.max("receipt").alias("receipt_observed"),
            F.max(F.col("time_quality") != "explicit_offset").alias("non_explicit_time"),
            F.first("cross_stream").alias("cross_stream_uncertain"),
            F.count(F.lit(1)).alias("n_facts"),
            F.transform(F.array_sort(F.collect_list(fact)), lambda f: f.dropFields("place")).alias("facts"),
        )
        .withColumns({"first_start": F.col("head.start_offset"), "first_end": F.col("head.end_offset")})
        .drop("head")
    )


def unresolved(rows: DataFrame) -> DataFrame:
    """One row per stream that was refused, with its reason and all its facts."""
    return rows.where(F.col("reason") != "resolved").groupBy(*STREAM).agg(F.first("reason").alias("reason"), F.count(F.lit(1)).alias("n_facts"), F.array_sort(F.collect_list(F.struct(*REF))).alias("facts"))
