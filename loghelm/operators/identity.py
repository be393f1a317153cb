"""Revisions and instance keys: digests that change when any fact does, and ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.scalars import framed
from loghelm.operators.origin_order import range_of
from loghelm.schema import QUEUE, REF

DIGEST_VERSION = "loghelm-revision-2"
#: groups of origins whose digests meet in one step
ORIGIN_GROUPS = 1024
RANGE_KEYS = ("source_id", "origin_id", "range")
FACT_COLUMNS = ("instance", "time_raw", "time_utc_ns", "time_quality", "time_year", "time_zone", "host", "program", "service", "pid", "queue_id", "no_queue", "kind", "message", "native_status_field", "parse_error")


def fact_digest():
    """A digest of every column of a fact, fields included, absent and empty apart."""
    entries = F.array_sort(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))))
    pairs = F.concat_ws("", F.transform(entries, lambda e: F.hex(framed(e["key"], e["value"]))))
    return F.sha2(framed(F.lit(DIGEST_VERSION), *[F.col(c) for c in (*REF, *FACT_COLUMNS)], pairs), 256)


def _level(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One step of the tree: the digest of the digests of each group, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "d")))
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["d"])), 256).alias("d"), F.sum("n").alias("n"))


def range_digests(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, source_id, origin_id, range, d, n): the lowest level, over RANGE_BYTES of an origin."""
    rows = facts.select(*{*by, *REF}, fact_digest().alias("d"), F.lit(1).alias("n")).withColumn("range", range_of(F.col("start_offset")))
    return _level(rows, [*dict.fromkeys([*by, *RANGE_KEYS])], ["start_offset", "end_offset"])


def revision_of(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The revision of facts whose range digests these are."""
    rows = _level(ranges, [*dict.fromkeys([*by, "source_id", "origin_id"])], ["range"])
    rows = rows.withColumn("group", F.pmod(F.xxhash64("source_id", "origin_id"), F.lit(ORIGIN_GROUPS)))
    rows = _level(rows, [*by, "group"], ["source_id", "origin_id"])
    return _level(rows, list(by), ["group"]).select(*by, F.col("d").alias("revision"), F.col("n").alias("n_facts"))


def revision(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest of all facts (or of each group): the digest of the digests in provenance order.

    Independent of row order and partitioning. A tree: over the facts of RANGE_BYTES of an origin,
    over the ranges of the origin, over origins of a group (by hash), over the groups; so no step
    gathers all facts of an origin, or all origins, into one row.
    """
    return revision_of(range_digests(facts, by), by)


def queue_instances(gens: DataFrame) -> DataFrame:
    """Generations with their ordinal (from 0) within the queue key, by stream, then in time."""
    w = Window.partitionBy(*QUEUE).orderBy("source_id", "origin_id", "cycle")
    return gens.withColumn("generation", F.row_number().over(w) - 1)
