"""Facts indexed by queue and stream, after their provenance has been validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.facts import is_queued, is_receipt, is_removal, usable_time
from loghelm.operators.origin_order import ordered
from loghelm.schema import MAX_FACTS, QUEUE, REF, STREAM, RefusedError, field


def provenance_faults(facts: DataFrame) -> DataFrame:
    """One row per fault: missing identity, bad offsets, overlap, or an origin of two instances.

    Overlap needs the previous row of an origin only, which ranges of the origin carry on; the
    instance test is a plain aggregation with partial combining.
    """
    rows = ordered(facts.select(*REF, "instance"))
    blank = F.lit(False)
    for c in ("source_id", "origin_id", "instance"):
        blank = blank | F.coalesce(F.col(c) == "", F.lit(True))
    fault = (
        F.when(blank, F.lit("missing_identity"))
        .when(F.col("start_offset").isNull() | F.col("end_offset").isNull() | (F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")), F.lit("invalid_offsets"))
        .when(F.col("previous_end") > F.col("start_offset"), F.lit("overlap"))
    )
    local = rows.select(*REF, fault.alias("fault")).where(F.col("fault").isNotNull())
    mixed = facts.groupBy("source_id", "origin_id").agg(F.min("instance").alias("a"), F.max("instance").alias("b")).where("a <> b")
    none = F.lit(None).cast("long")
    return local.unionByName(mixed.select("source_id", "origin_id", none.alias("start_offset"), none.alias("end_offset"), F.lit("origin_of_two_instances").alias("fault")))


def refuse_invalid(facts: DataFrame, limit: int | None = MAX_FACTS) -> None:
    """Raises RefusedError for more facts than the limit (None: bulk, no limit) or any fault."""
    if limit is not None:
        if limit < 1:
            raise RefusedError("invalid_limit")
        if facts.select("source_id").limit(limit + 1).count() > limit:
            raise RefusedError("too_many_facts", f"more than {limit}")
    fault = provenance_faults(facts).head(1)
    if fault:
        raise RefusedError("invalid_facts", fault[0]["fault"])


def indexed(facts: DataFrame) -> DataFrame:
    """All facts with: queued, t, receipt, removed, and cross_stream for queued ones.

    cross_stream tells whether the queue key has facts of more than one stream. It is the
    comparison of two window extremes over the queue key, the key the later stream windows
    are nested in, so one shuffle serves them all.
    """
    out = facts.withColumns({"queued": is_queued(), "t": usable_time(), "receipt": is_receipt(), "removed": is_removal()})
    w = Window.partitionBy(*QUEUE)
    stream = F.when(F.col("queued"), F.struct("source_id", "origin_id"))
    return out.withColumn("cross_stream", F.coalesce(F.min(stream).over(w) != F.max(stream).over(w), F.lit(False)))


def streams(facts: DataFrame) -> DataFrame:
    """One row per stream: counts of timed and untimed facts, and cross_stream."""
    rows = indexed(facts).where("queued")
    return rows.groupBy(*STREAM).agg(F.count("t").alias("timed"), (F.count(F.lit(1)) - F.count("t")).alias("untimed"), F.first("cross_stream").alias("cross_stream"))


def other(facts: DataFrame) -> DataFrame:
    """Facts of no queue, in provenance order."""
    return facts.where(~is_queued()).orderBy(*REF)


def message_id():
    return F.when(F.col("service") == "cleanup", field("message-id"))
