"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of each source are dealt into blocks of `block_docs`. Block k (from 0) of a source
with weight w may run from slot floor(k / w), its release, and must have run by slot
ceil((k + 1) / w), its deadline. One block runs per slot, always the released one with the
earliest deadline (ties to the source named first). On one processor this meets every deadline,
so after any number of slots each source has had its share of them to within less than one
block, as long as it has documents left; a source that has run out leaves its slots empty.

Weights are used as they are: releases and deadlines are worked out in whole numbers in the
exact proportions of the weights, so the bound holds however long the schedule gets. Slots are
given on the driver, one step of a heap for each block (not for each document), and written in
batches of BATCH blocks; blocks then find their slots by a join, shuffled where the table of
slots is large. Only names and counts of sources go to the driver. Sources without a stated
weight are pooled as one source.

Numbering the documents of a source never gathers the source in one task: all documents are
dealt by hash into buckets of about `bucket_docs`, those of a source are numbered in each
bucket, and shifted by the counts of the buckets before.

Defined cases: a null source counts as pooled, like a source without weight; null ids and
texts are kept; repeated rows are kept, each with its own place; an empty table gives none;
columns of any name are carried along, but mix_sources replaces input columns that have the
names of its own. Weights so unlike that a block would come after slot 2 ** 52 are refused.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghelm.llm.common import Scratch, whole_row

POOLED = ""
#: stated weights are looked up in the expression up to so many names, beyond it by a join
INLINE = 256
SALTS = 16
BATCH = 500_000
#: blocks without weight come from this slot on
LATE = 1 << 52
ADDED = ("mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")
SLOTS = ("mix_source", "mix_block", "mix_r", "mix_d", "mix_t")


def whole_parts(weights: dict[str, float], parts: int) -> dict[str, int]:
    """Weights as whole parts: each positive one gets one part at least, by largest remainder."""
    live = {k: Fraction(w).limit_denominator(10**9) for k, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no source has a positive weight")
    if len(live) > parts:
        raise ValueError("more sources than parts")
    total = sum(live.values())
    exact = {k: w / total * parts for k, w in live.items()}
    got = {k: max(1, math.floor(x)) for k, x in exact.items()}
    while (gap := parts - sum(got.values())) != 0:
        step = 1 if gap > 0 else -1
        able = [k for k in got if step > 0 or got[k] > 1]
        k = max(able, key=lambda k: (step * (exact[k] - got[k]), k))
        got[k] += step
    return got


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in the exact proportions of the weights: as the short decimals that they
    stand for, or where these have no small common denominator, as the binary fractions that
    they are."""
    common = 1
    for w in weights:
        short = Fraction(w).limit_denominator(10**6)
        common = math.lcm(common, short.denominator)
        if float(short) != w or common > 10**18:
            break
    else:
        return [int(Fraction(w).limit_denominator(10**6) * common) for w in weights]
    ratios = [float(w).as_integer_ratio() for w in weights]
    common = max(d for _, d in ratios)  # all are powers of two
    return [n * (common // d) for n, d in ratios]


def schedule(names: list[str], shares: list[int], blocks: list[int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, slot by slot.

    Of each source only its next block is held: block k runs before block k + 1 is due to start.
    """
    total = sum(shares)
    order = sorted(range(len(names)), key=names.__getitem__)
    waiting: list[tuple[int, int, int, int]] = []
    ready = [(-(-total // shares[i]), at, 0, 0) for at, i in enumerate(order) if blocks[i]]
    heapq.heapify(ready)
    slot = 0
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, deadline, at, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, at, k, release))
        deadline, at, k, release = heapq.heappop(ready)
        i = order[at]
        yield names[i], k, release, deadline, slot
        slot += 1
        if (k := k + 1) < blocks[i]:
            heapq.heappush(waiting, (k * total // shares[i], -(-(k + 1) * total // shares[i]), at, k))


def period(parts_of: dict[str, int], parts: int) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of the `parts` slots after which whole parts repeat."""
    if sum(parts_of.values()) != parts:
        raise ValueError("the parts do not add up")
    return list(schedule(list(parts_of), list(parts_of.values()), list(parts_of.values())))


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of each source's documents, of every source by itself;
    documents without a source count as one."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(POOLED)).alias("s")).count()
    return {r["s"]: float(r["count"]) ** power for r in counts.toLocalIterator()} or {POOLED: 1.0}


def _named(rows: DataFrame, name: Column, live: list[str]) -> DataFrame:
    """rows with mix_source: the name where it has a weight, else POOLED."""
    if len(live) <= INLINE:
        return rows.withColumn("mix_source", F.when(name.isin(live), name).otherwise(F.lit(POOLED))).drop("mix_name")
    # salted, as a source may have most of the documents
    known = rows.sparkSession.createDataFrame(pa.table({"mix_known": live}))
    known = known.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("mix_salt", F.pmod("mix_hash", F.lit(SALTS)).cast("int")).withColumn("mix_own", name)
    rows = rows.join(known, (F.col("mix_own") == F.col("mix_known")) & (rows["mix_salt"] == known["mix_salt"]), "left").drop("mix_salt")
    return rows.withColumn("mix_source", F.coalesce("mix_known", F.lit(POOLED))).drop("mix_own", "mix_known", "mix_name")


def _slots(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """The schedule as a stored table, written batch by batch."""
    live = {k: w for k, w in weights.items() if w > 0}
    rows = schedule(list(live), whole_weights(list(live.values())), [blocks.get(k, 0) for k in live])
    scratch = Scratch(spark)
    parts = []
    while (batch := list(itertools.islice(rows, BATCH))) or not parts:
        if batch and max(d for _, _, _, d, _ in batch) > LATE:
            raise ValueError("weights are too unlike: a block would come after slot 2 ** 52")
        cols = list(zip(*batch, strict=True)) or [[]] * 5
        types = [pa.string(), *[pa.int64()] * 4]
        table = pa.table({n: pa.array(c, t) for n, c, t in zip(SLOTS, cols, types, strict=True)})
        parts.append(scratch.keep(spark.createDataFrame(table)))
    return spark.read.schema(parts[0].schema).parquet(*[p._loghelm_path for p in parts])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, parts: int | None = None, bucket_docs: int = 4096, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (of them `carry` only, if given) with mix_source, mix_block, mix_release, mix_deadline, mix_slot and
    mix_position (slot by slot, unique). Sources of no weight come after all others. Weights are
    exact; `parts` asks for whole parts of so many instead (see whole_parts)."""
    mixed = _mixed(docs, weights, block_docs, parts, bucket_docs, source_col, id_col, text_col, carry)
    return mixed.select(*[F.col(f"mix_row.`{c}`") for c in carry or docs.columns if c not in ADDED], *ADDED)


def _mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, parts: int | None = None, bucket_docs: int = 4096, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs as the struct mix_row, with the columns ADDED."""
    spark = docs.sparkSession
    every = weights is None
    weights = tempered_weights(docs, source_col) if every else dict(weights)
    if not any(w > 0 for w in weights.values()):
        raise ValueError("no source has a positive weight")
    weights.setdefault(POOLED, 0.0)
    if parts is not None:
        weights = {POOLED: 0.0} | {k: float(n) for k, n in whole_parts(weights, parts).items()}

    name = F.coalesce(F.col(source_col).cast("string"), F.lit(POOLED))
    rows = docs.select(whole_row(docs.select(*[F.col(f"`{c}`") for c in carry or docs.columns])).alias("mix_row"), F.col(id_col).alias("mix_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mix_hash"), name.alias("mix_name"))
    name = F.col("mix_name")
    rows = rows.withColumnRenamed("mix_name", "mix_source") if every else _named(rows, name, [k for k, w in weights.items() if w > 0])
    counts = {r["mix_source"]: r["count"] for r in rows.groupBy("mix_source").count().toLocalIterator()}
    slots = _slots(spark, weights, {k: -(-n // block_docs) for k, n in counts.items()})

    rows = rows.withColumn("mix_bucket", F.pmod("mix_hash", F.lit(max(1, math.ceil(sum(counts.values()) / bucket_docs)))))
    before = rows.groupBy("mix_source", "mix_bucket").count()
    before = before.select("mix_source", "mix_bucket", (F.sum("count").over(Window.partitionBy("mix_source").orderBy("mix_bucket")) - F.col("count")).alias("mix_before"))
    own = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", "mix_id")
    rows = rows.withColumn("mix_nth", F.row_number().over(own) - 1).join(before, ["mix_source", "mix_bucket"])
    nth = F.col("mix_before") + F.col("mix_nth")
    rows = rows.withColumn("mix_block", F.floor(nth / block_docs)).withColumn("mix_within", F.pmod(nth, F.lit(block_docs)))
    rows = rows.join(slots, ["mix_source", "mix_block"], "left")
    out = {
        "mix_source": F.col("mix_source"),
        "mix_block": F.col("mix_block"),
        "mix_release": F.col("mix_r"),
        "mix_deadline": F.col("mix_d"),
        "mix_slot": F.coalesce(F.col("mix_t"), F.lit(LATE) + F.col("mix_block")),
    }
    out = [v.cast("long").alias(k) if k != "mix_source" else v for k, v in out.items()]
    return rows.select("mix_row", *out, "mix_within").withColumn("mix_position", F.col("mix_slot") * block_docs + F.col("mix_within")).drop("mix_within")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs, laid out in files in the order of mix_position."""
    return _mixed(docs, **options).orderBy("mix_position").select("mix_row.*")
