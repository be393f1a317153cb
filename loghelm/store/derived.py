"""Tables worked out of a store's facts, kept beside them, and rebuilt only where facts changed.

Two tables are kept, in folders by the hash of their keys: the digests of ranges of origins (the
lowest level of the revision's tree), and the summaries of queue generations. A refresh compares
the folders of facts of the version that was seen last with those of the present one. The ranges
that the new and the gone folders touch are digested again; ranges whose digest did not change
(a compaction changes none) are left alone. In those that did, the facts that are on one side only
name the queues to rebuild, since a summary depends on the facts of its queue and no other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.facts import is_queued
from loghelm.operators.generations import assigned
from loghelm.operators.identity import RANGE_KEYS, fact_digest, range_digests, revision_of
from loghelm.operators.origin_order import RANGE_BYTES, range_of
from loghelm.operators.summaries import summaries
from loghelm.schema import QUEUE, REF, RefusedError
from loghelm.store.facts_store import NEAR_ORIGINS, FactStore
from loghelm.store.snapshots import Change, Entry, Version

BUCKETS = 64
MARK = frozenset(["derived:all"])


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: ranges whose digest changed, queues and folders that were rebuilt."""

    version: int
    ranges: int
    queues: int
    folders: int
    whole: bool


class Derived:
    def __init__(self, store: FactStore):
        self.store, self.spark, self.snapshots = store, store.spark, store.snapshots
        self._small: list[str] = []

    def digests(self, at: Version | None = None) -> DataFrame:
        return self._read("digests", at)

    def summaries(self, at: Version | None = None) -> DataFrame:
        return self._read("summaries", at)

    def revision(self, at: Version | None = None) -> str | None:
        """Digest of all facts, from the digests that are kept."""
        got = revision_of(self.digests(at)).first()
        return got["revision"] if got else None

    def seen(self, at: Version | None = None) -> int | None:
        """The version whose facts the tables tell of."""
        return (at or self.snapshots.current()).notes.get("derived", {}).get("version")

    def _read(self, name: str, at: Version | None) -> DataFrame:
        at = at or self.snapshots.current()
        if self.seen(at) is None:
            raise RefusedError("absent", name)
        return self.snapshots.read_entries(at.tables.get(name, []), at.notes["derived"][name])

    def refresh(self) -> Refreshed:
        out: Refreshed | None = None
        staged: list[str] = []

        def make(base: Version) -> Change | None:
            nonlocal out
            self.snapshots.discard(*staged)
            staged.clear()
            change, out = self._change(base)
            staged.extend(e["path"] for t in (change.add if change else {}).values() for e in t)
            return change

        self.snapshots.publish(make)
        return out

    def _change(self, base: Version) -> tuple[Change | None, Refreshed]:
        seen = self.seen(base)
        entries = base.tables.get("facts", [])
        try:
            old = None if seen is None else self.snapshots.version(seen).tables.get("facts", [])
            gone = [] if old is None else [e for e in old if e["path"] not in {x["path"] for x in entries}]
            whole = old is None or not all(self.snapshots.files.names(e["path"]) for e in gone)
        except RefusedError:  # the version that was seen is cleared away
            whole = True
        if whole:
            facts = self.store.facts(base)
            return self._replaced(base, range_digests(facts), summaries(assigned(facts)), None, None, Refreshed(base.number, -1, -1, 0, True))
        new = [e for e in entries if e["path"] not in {x["path"] for x in old}]
        if not new and not gone:
            return None, Refreshed(seen, 0, 0, 0, False)
        try:
            ranges = self._kept(self._changed_ranges(base, new, gone))
            n_ranges = ranges.count()
            if not n_ranges:
                return Change(notes={"derived": {"version": base.number}}, touch=MARK), Refreshed(base.number, 0, 0, 0, False)
            queues = self._kept(self._queues(new, gone, ranges))
            n_queues = queues.count()
            few = queues.limit(NEAR_ORIGINS + 1).collect()
            facts = self.store.facts(base)
            if len(few) <= NEAR_ORIGINS:  # literals prune files by statistics and Bloom filters
                facts = facts.where(F.col("queue_id").isin([r["queue_id"] for r in few]))
            rebuilt = summaries(assigned(facts.join(queues, list(QUEUE), "left_semi")))
            now = ranges.where(F.col("d").isNotNull()).select(*RANGE_KEYS, "d", "n")
            return self._replaced(base, now, rebuilt, ranges.select(*RANGE_KEYS), queues, Refreshed(base.number, n_ranges, n_queues, 0, False))
        finally:
            self.snapshots.discard(*self._small)
            self._small.clear()

    def _changed_ranges(self, base: Version, new: list[Entry], gone: list[Entry]) -> DataFrame:
        """Ranges that changed, with their digest as it is now (NULL where nothing is left)."""
        both = self.store._facts_of(new).select(*REF).unionByName(self.store._facts_of(gone).select(*REF))
        touched = both.select("source_id", "origin_id", range_of(F.col("start_offset")).alias("range")).distinct()
        by_origin = both.withColumn("range", range_of(F.col("start_offset"))).groupBy("source_id", "origin_id").agg((F.min("range") * RANGE_BYTES).alias("lo"), ((F.max("range") + 1) * RANGE_BYTES - 1).alias("hi"))
        near, entries = self.store._near(by_origin, by_origin.limit(NEAR_ORIGINS + 1).collect(), base)
        rows = self.store._facts_of(entries).where(near).withColumn("range", range_of(F.col("start_offset")))
        now = range_digests(rows.join(touched, list(RANGE_KEYS), "left_semi"))
        was = self.digests(base).join(touched, list(RANGE_KEYS), "left_semi").select(*RANGE_KEYS, F.col("d").alias("old"))
        return now.join(was, list(RANGE_KEYS), "full").where(~F.col("d").eqNullSafe(F.col("old"))).select(*RANGE_KEYS, "d", "n")

    def _queues(self, new: list[Entry], gone: list[Entry], ranges: DataFrame) -> DataFrame:
        """Queues of the facts of these ranges that are in new folders or in gone ones, not both."""

        def told(entries: list[Entry]) -> DataFrame:
            rows = self.store._facts_of(entries).withColumn("range", range_of(F.col("start_offset"))).join(ranges, list(RANGE_KEYS), "left_semi")
            return rows.select(*QUEUE, is_queued().alias("queued"), fact_digest().alias("f"))

        a, b = told(new), told(gone)
        apart = a.join(b, "f", "left_anti").unionByName(b.join(a, "f", "left_anti"))
        return apart.where("queued").select(*QUEUE).distinct()

    def _replaced(self, base: Version, digests: DataFrame, told: DataFrame, ranges: DataFrame | None, queues: DataFrame | None, done: Refreshed) -> tuple[Change, Refreshed]:
        add, drop, shapes = {}, {}, {}
        for name, rows, keys, changed in (("digests", digests, ["source_id", "origin_id"], ranges), ("summaries", told, list(QUEUE), queues)):
            bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
            add[name], drop[name] = self._buckets(base, name, rows, bucket, changed)
            shapes[name] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return Change(add, drop, {"derived": {"version": base.number, **shapes}}, MARK), replace(done, folders=sum(map(len, add.values())))

    def _buckets(self, base: Version, name: str, rows: DataFrame, bucket: Column, changed: DataFrame | None) -> tuple[list[Entry], list[str]]:
        """Folders of rows by bucket, with what stays of the folders that they stand for."""
        held = base.tables.get(name, [])
        if changed is None:
            dropped = held
        else:
            numbers = {r["b"] for r in changed.select(bucket.alias("b")).distinct().collect()}  # BUCKETS at most
            dropped = [e for e in held if e["bucket"] in numbers]
            if dropped:
                old = self.snapshots.read_entries(dropped, base.notes["derived"][name])
                rows = old.join(changed, changed.columns, "left_anti").select(*rows.columns).unionByName(rows)
        path = self.snapshots.stage(name, rows.withColumn("bucket", bucket).repartition("bucket"), by="bucket")
        made = sorted(n for n, d, *_ in self.snapshots.files.names(path) if d and n.startswith("bucket="))
        return [{"path": f"{path}/{n}", "bucket": int(n.split("=")[1])} for n in made], [e["path"] for e in dropped]

    def _kept(self, df: DataFrame) -> DataFrame:
        """A small table that a refresh reads more than once."""
        self._small.append(self.snapshots.stage("incoming", df))
        return self.spark.read.schema(df.schema).parquet(f"{self.snapshots.root}/{self._small[-1]}")
