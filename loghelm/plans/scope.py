"""Facts of a stated scope: queues, and instances whose unqueued facts are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.schema import MAX_FACTS, MAX_SCOPE_PARTS, RefusedError


def check_scope(queues: list[tuple[str, str]], unqueued: list[str]) -> None:
    if not 1 <= len(queues) + len(unqueued) <= MAX_SCOPE_PARTS:
        raise RefusedError("invalid_scope", "size")
    if len(set(queues)) != len(queues) or len(set(unqueued)) != len(unqueued):
        raise RefusedError("invalid_scope", "repeated part")
    if not all(i and q for i, q in queues) or not all(unqueued):
        raise RefusedError("invalid_scope", "empty part")


def facts_in_scope(facts: DataFrame, queues: list[tuple[str, str]], unqueued: list[str] = (), limit: int | None = MAX_FACTS) -> DataFrame:
    """A semi-join with the scope's parts, at most MAX_SCOPE_PARTS rows and so broadcast."""
    check_scope(list(queues), list(unqueued))
    spark = facts.sparkSession
    parts = spark.createDataFrame([*queues, *[(i, "") for i in unqueued]], "instance string, queue_id string")
    key = F.when(F.col("queue_id") == "", F.lit("")).otherwise(F.col("queue_id"))
    own = facts.withColumn("scope_queue", F.when(F.col("no_queue"), F.lit("")).otherwise(key))
    scoped = own.join(F.broadcast(parts.withColumnRenamed("queue_id", "scope_queue")), ["instance", "scope_queue"], "left_semi").drop("scope_queue").select(*facts.columns)
    if limit is not None and scoped.limit(limit + 1).count() > limit:
        raise RefusedError("too_many_facts", f"more than {limit}")
    return scoped
