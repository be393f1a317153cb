"""Facts, origins, checkpoints, imports, revisions and purges over versioned tables.

Facts are stored by day and sorted by instance and instant within it, in folders that the log
describes: rows, bytes, instants, and the instances and origins if they are few. A search or a
replay opens only folders that can hold what it asks for, and Parquet's statistics and Bloom
filters do the rest within them.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghelm.operators.origin_order import ordered
from loghelm.plans.projection import Projection, build_projection
from loghelm.plans.scope import check_scope, facts_in_scope
from loghelm.plans.search import SearchPage, SearchQuery, search, search_plan, searchable
from loghelm.schema import DAY_NS, FACT, REF, RETENTION_BATCH, RefusedError
from loghelm.sources.follow import stored_change
from loghelm.store.imports import CHECKPOINTS, IMPORTS, ImportAttempt, runs_with_marks, with_marks
from loghelm.store.replay import outcomes, purge_digest
from loghelm.store.retention import covered, purgeable
from loghelm.store.snapshots import Change, Entry, Snapshots, Version, overlap

FACTS = FACT + ", event_id long, search_ns long, sender string, recipient string, message_id string, status string, sender_domain string, recipient_domain string"
FACTS_COLUMNS = [c.strip().split()[0] for c in FACTS.replace("map<string,string>", "map").split(", ")]
FACT_COLUMNS = [c.strip().split()[0] for c in FACT.replace("map<string,string>", "map").split(", ")]
SOURCES = "source_id string, kind string, trusted_host string"
ORIGINS = "source_id string, origin_id string, path string, device long, inode long, prefix string, state string"
PURGED = "source_id string, origin_id string, start_offset long, end_offset long, digest string"
LAYOUT = 2
#: origins, instances and marks that are named one by one; beyond, they are taken for all
NEAR_ORIGINS = 32
#: batches of more rows are dealt by range, smaller ones are written by one task
ONE_TASK = 200_000
#: folders of a day that are smaller are put together
FOLDER_BYTES = 128 << 20
BLOOM = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("queue_id", "sender", "recipient", "message_id")}


@dataclass(frozen=True)
class PurgeResult:
    purged: int
    more: bool
    invalidated: int


@dataclass(frozen=True)
class _Staged:
    entries: list[Entry]
    touch: frozenset[str]


def _marks(kind: str, rows: list[tuple]) -> frozenset[str]:
    return frozenset([f"{kind}:*"] if len(rows) > NEAR_ORIGINS else [f"{kind}:{json.dumps(r)}" for r in rows])


class FactStore:
    def __init__(self, spark: SparkSession, root: str, put=None):
        self.spark, self.snapshots = spark, Snapshots(spark, root, put)

    # reading

    def facts(self, at: Version | None = None) -> DataFrame:
        return self._facts_of((at or self.snapshots.current()).tables.get("facts", []))

    def _facts_of(self, entries: list[Entry], file_path: bool = False) -> DataFrame:
        """Folders of layout 1 may hold facts from before their columns for search were stored, so
        these are worked out as they are read."""
        old = [e for e in entries if e.get("layout") == 1]
        path = [F.regexp_extract("_metadata.file_path", "(data/.*)/[^/]+$", 1).alias("folder")] if file_path else []
        new = self.snapshots.read_entries([e for e in entries if e.get("layout") != 1], FACTS)
        new = new.select("*", *path) if len(old) < len(entries) else new.select("*", *[F.lit("").alias("folder") for _ in path])
        if not old:
            return new
        raw = self.snapshots.read_entries(old, FACT + ", event_id long").select("*", *path)
        return new.unionByName(searchable(raw).select(*new.columns))

    def searched(self, q: SearchQuery, at: Version | None = None) -> list[Entry]:
        """The folders that can hold hits of a question."""
        low = q.cursor.time_utc_ns if q.cursor else q.from_ns
        return [e for e in (at or self.snapshots.current()).tables.get("facts", []) if e.get("layout") == 1 or (e["ns"] and e["ns"][1] >= low and e["ns"][0] < q.until_ns and (e["instances"] is None or q.instance in e["instances"]))]

    def search_plan(self, q: SearchQuery, with_limit: bool = True, at: Version | None = None) -> DataFrame:
        q.check()
        return search_plan(self._facts_of(self.searched(q, at)), q, with_limit)

    def search(self, q: SearchQuery, at: Version | None = None) -> SearchPage:
        q.check()
        return search(self._facts_of(self.searched(q, at)), q)

    def sources(self, at: Version | None = None) -> DataFrame:
        return self.snapshots.read("sources", SOURCES, at)

    def origins(self, at: Version | None = None) -> DataFrame:
        """Origins with their checkpoints; an absent checkpoint is not offset 0."""
        at = at or self.snapshots.current()
        return with_marks(self.snapshots.read("origins", ORIGINS, at), self.checkpoints(at))

    def origins_page(self, source_id: str, after: str = "", limit: int = 100, path: str | None = None) -> tuple[list, bool]:
        rows = self.origins().where((F.col("source_id") == source_id) & (F.col("origin_id") > after))
        rows = (rows.where(F.col("path") == path) if path is not None else rows).orderBy("origin_id").limit(limit + 1).collect()
        return rows[:limit], len(rows) > limit

    def checkpoints(self, at: Version | None = None) -> DataFrame:
        return self.snapshots.read("checkpoints", CHECKPOINTS, at)

    def checkpoint(self, source_id: str, origin_id: str, at: Version | None = None) -> tuple[int, str] | None:
        got = self.checkpoints(at).where((F.col("source_id") == source_id) & (F.col("origin_id") == origin_id)).head(1)
        return (got[0]["offset"], got[0]["anchor"]) if got else None

    def import_runs(self, at: Version | None = None) -> DataFrame:
        """Import runs with their checkpoints, and what is wrong with a row, if anything."""
        at = at or self.snapshots.current()
        return runs_with_marks(self.snapshots.read("imports", IMPORTS, at), self.checkpoints(at))

    def import_run(self, run_id: str, at: Version | None = None):
        got = self.import_runs(at).where(F.col("run_id") == run_id).head(1)
        if got and got[0]["fault"]:
            raise RefusedError("import_state", got[0]["fault"])
        return got[0] if got else None

    # writing

    def _new_only(self, new: DataFrame, at: Version, by_origin: DataFrame, some: list, kept: list[str]) -> DataFrame:
        """Facts that are not stored yet. The same provenance with other bytes is a collision;
        purged facts come back only as what they were, and are then skipped. `kept` takes the folder
        that they are written to."""
        bad = F.col("source_id").isNull() | (F.col("source_id") == "") | (F.col("origin_id") == "") | (F.col("instance") == "") | (F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset"))
        once = new.dropDuplicates([*REF, "raw"])
        faults = ordered(once.select(*REF, "instance")).agg(F.max(bad), F.max(F.col("previous_end") > F.col("start_offset"))).first()
        if faults[0]:
            raise RefusedError("invalid_batch")
        if faults[1]:
            raise RefusedError("collision", "within the batch")
        near, met = self._near(by_origin, some, at)
        told = outcomes(once, self._facts_of(met).where(near), self.snapshots.read("purged", PURGED, at).where(near))
        # written once, as the ids need the new facts several times
        kept.append(self.snapshots.stage("incoming", told.where(F.col("outcome") != "stored")))
        told = self.spark.read.schema(told.schema).parquet(f"{self.snapshots.root}/{kept[-1]}")
        if not told.where(F.col("outcome") == "collision").isEmpty():
            raise RefusedError("collision", "with a stored or purged record")
        return told.where(F.col("outcome") == "new").select(*once.columns)

    def _near(self, by_origin: DataFrame, some: list, at: Version):
        """A condition on provenance that holds for all that a batch can meet, made of literals so
        that it prunes files and row groups, and the folders that can hold such facts. It names
        origins and offset ranges, or, for a batch of many origins, its sources and overall range."""
        entries = at.tables.get("facts", [])
        if len(some) <= NEAR_ORIGINS:
            out = F.lit(False)
            for r in some:
                out = out | ((F.col("source_id") == r["source_id"]) & (F.col("origin_id") == r["origin_id"]) & F.col("start_offset").between(r["lo"], r["hi"]))
            held = {(r["source_id"], r["origin_id"]): (r["lo"], r["hi"]) for r in some}

            def meets(e: Entry) -> bool:
                return e.get("origins") is None or any((s, o) in held and held[s, o][0] <= hi and held[s, o][1] >= lo for s, o, lo, hi in e["origins"])

            return out, [e for e in entries if meets(e)]
        r = by_origin.agg(F.min("source_id"), F.max("source_id"), F.min("lo"), F.max("hi")).first()
        return F.col("source_id").between(r[0], r[1]) & F.col("start_offset").between(r[2], r[3]), entries

    def commit(
        self, facts: DataFrame | None = None, origins: DataFrame | None = None, checkpoints: DataFrame | None = None, notes: dict | None = None, imports: DataFrame | None = None, base: Version | None = None, sources: DataFrame | None = None, ids: str | None = None
    ) -> Version:
        """All of a batch or nothing. Sending the same batch again changes nothing. Where other
        writers come first, what they wrote of the same origins is met anew, and their origins,
        checkpoints and runs are kept. `base` is the version that the batch was made from, if a
        change of the same origins or run since then must refuse it. `ids` is a column of event ids
        that facts bring along from another store, unique in it; such ids are kept."""
        start = at = base or self.snapshots.current()
        given = {"sources": sources, "origins": origins, "checkpoints": checkpoints, "imports": imports}
        given = {k: v for k, v in given.items() if v is not None}
        touch = self._touched(given)
        staged: _Staged | None = None
        small: dict[str, Entry] = {}
        try:
            while True:
                if facts is not None and staged is None:
                    staged = self._staged(facts, at, ids)
                small = {name: {"path": self.snapshots.stage(name, self._merged(name, new, at))} for name, new in given.items()}
                add = {**({"facts": staged.entries} if staged and staged.entries else {}), **{k: [e] for k, e in small.items()}}
                marks = touch | (staged.touch if staged else frozenset())
                new = self.snapshots.put(at, Change(add, {name: at.paths(name) for name in small}, notes or {}, marks))
                if new is not None:
                    return new
                self.snapshots.discard(*[e["path"] for e in small.values()])
                small = {}
                now = self.snapshots.current()
                since = self.snapshots.changes(at, now)
                if base is not None and any(overlap(marks, c.touch) for c in since):
                    raise RefusedError("conflict", f"version {now.number} changed the same since {start.number}")
                if staged and any(overlap(staged.touch, c.touch) for c in since):
                    self.snapshots.discard(*[e["path"] for e in staged.entries])
                    staged = None
                at = now
        except BaseException:
            self.snapshots.discard(*[e["path"] for e in [*small.values(), *(staged.entries if staged else [])]])
            raise

    def _touched(self, given: dict[str, DataFrame]) -> frozenset[str]:
        out: frozenset[str] = frozenset()
        for name, new in given.items():
            kind, keys = {"imports": ("run", ["run_id"]), "sources": ("source", ["source_id"])}.get(name, ("origin", ["source_id", "origin_id"]))
            out |= _marks(kind, [tuple(r) for r in new.select(*keys).distinct().limit(NEAR_ORIGINS + 1).collect()])
        return out

    def _merged(self, name: str, new: DataFrame, at: Version) -> DataFrame:
        if name == "sources":
            return self._merged_sources(new, at)
        if name == "origins":
            return self._merged_origins(new, at)
        if name == "imports":
            return self._merged_imports(new, at)
        both = self.checkpoints(at).unionByName(new.select("source_id", "origin_id", "offset", "anchor"))
        return both.groupBy("source_id", "origin_id").agg(F.max(F.struct("offset", "anchor")).alias("m")).select("source_id", "origin_id", "m.offset", "m.anchor")

    def _staged(self, facts: DataFrame, at: Version, ids: str | None) -> _Staged:
        """Writes the facts that are new, with their ids. The batch is written as it came first, so
        that its parser runs once for all the checks."""
        given = [] if ids is None else [F.col(ids).cast("long").alias("given_id")]
        kept = [self.snapshots.stage("incoming", facts.select(*FACT_COLUMNS, *given))]
        try:
            batch = self.spark.read.schema(FACT + (", given_id long" if given else "")).parquet(f"{self.snapshots.root}/{kept[0]}")
            by_origin = batch.groupBy("source_id", "origin_id").agg(F.min("start_offset").alias("lo"), F.max("start_offset").alias("hi"), F.count(F.lit(1)).alias("n"))
            some = by_origin.limit(NEAR_ORIGINS + 1).collect()
            few = len(some) <= NEAR_ORIGINS
            size = sum(r["n"] for r in some) if few else batch.count()
            touch = _marks("origin", [(r["source_id"], r["origin_id"]) for r in some])
            new = self._new_only(batch, at, by_origin, some, kept)
            if ids is not None:
                rows = searchable(new).withColumn("event_id", F.col("given_id"))
            else:
                # ids follow provenance order; they only break ties of instants within pages
                rows = ordered(searchable(new)).withColumnRenamed("place", "event_id")
                sizes = new.groupBy("source_id", "origin_id").agg(F.count(F.lit(1)).alias("n"))
                shift = (F.sum("n").over(Window.orderBy("source_id", "origin_id")) - F.col("n")).alias("shift")  # one row per origin of the batch
                first = self._reserve(size)
                rows = rows.join(sizes.select("source_id", "origin_id", shift), ["source_id", "origin_id"]).withColumn("event_id", (F.col("event_id") + F.col("shift") + first).cast("long"))
            return _Staged(self._written(rows.select(*FACTS_COLUMNS), size), touch)
        finally:
            self.snapshots.discard(*kept)

    def _reserve(self, n: int) -> int:
        """The id before n ids that no other batch gets; ids that a batch does not use stay unused."""
        new = self.snapshots.publish(lambda at: Change(notes={"last_event_id": int(at.notes.get("last_event_id", 0)) + n}, touch=frozenset(["ids:all"])))
        return int(new.notes["last_event_id"]) - n

    def _written(self, rows: DataFrame, size: int = ONE_TASK + 1) -> list[Entry]:
        """Writes facts, a folder for each day, and tells what the folders hold."""
        day = F.coalesce(F.floor(F.col("search_ns") / DAY_NS).cast("string"), F.lit("none"))
        order = ["day", "instance", "search_ns", "event_id"]
        dealt = rows.withColumn("day", day)
        dealt = dealt.coalesce(1) if size <= ONE_TASK else dealt.repartitionByRange(*order)
        path = self.snapshots.stage("facts", dealt.sortWithinPartitions(*order), by="day", **BLOOM)
        stored = self.spark.read.schema(FACTS + ", day string").parquet(f"{self.snapshots.root}/{path}")
        each = stored.groupBy("day", "instance", "source_id", "origin_id").agg(F.count(F.lit(1)).alias("n"), F.min("search_ns").alias("low"), F.max("search_ns").alias("high"), F.min("start_offset").alias("lo"), F.max("start_offset").alias("hi"))
        most = NEAR_ORIGINS + 1
        told = each.groupBy("day").agg(
            F.sum("n").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.slice(F.array_sort(F.collect_set("instance")), 1, most).alias("instances"),
            F.slice(F.array_sort(F.collect_list(F.struct("source_id", "origin_id", "lo", "hi"))), 1, most).alias("origins"),
        )
        out = []
        for r in told.orderBy("day").collect():  # one row per day
            folder = f"{path}/day={r['day']}"
            out.append(
                {
                    "path": folder,
                    "layout": LAYOUT,
                    "rows": r["n"],
                    "bytes": self.snapshots.files.size(folder),
                    "ns": None if r["low"] is None else [r["low"], r["high"]],
                    "instances": r["instances"] if len(r["instances"]) < most else None,
                    "origins": [list(o) for o in r["origins"]] if len(r["origins"]) < most else None,
                }
            )
        if not out:
            self.snapshots.discard(path)
        return out

    def _merged_sources(self, new: DataFrame, at: Version) -> DataFrame:
        """What kind a source is and which host it is trusted for never change."""
        old = self.sources(at)
        met = old.alias("o").join(new.alias("n"), "source_id")
        if not met.where(~F.col("o.kind").eqNullSafe(F.col("n.kind")) | ~F.col("o.trusted_host").eqNullSafe(F.col("n.trusted_host"))).isEmpty():
            raise RefusedError("immutable_source")
        if not new.groupBy("source_id").agg(F.count_distinct(F.struct("kind", "trusted_host")).alias("n")).where("n > 1 OR source_id IS NULL OR source_id = ''").isEmpty():
            raise RefusedError("invalid_source")
        return old.join(new, "source_id", "left_anti").unionByName(new.select(*old.columns).distinct())

    def _merged_origins(self, new: DataFrame, at: Version) -> DataFrame:
        """Identity columns never change; states change only along legal transitions."""
        old = self.snapshots.read("origins", ORIGINS, at)
        met = old.alias("o").join(new.alias("n"), ["source_id", "origin_id"])
        if not met.where((F.col("o.device") != F.col("n.device")) | (F.col("o.inode") != F.col("n.inode"))).isEmpty():
            raise RefusedError("immutable_origin")
        for r in met.select(F.col("o.state").alias("a"), F.col("n.state").alias("b")).distinct().collect():  # a few states
            stored_change(r["a"], r["b"])
        return old.join(new, ["source_id", "origin_id"], "left_anti").unionByName(new.select(*old.columns))

    def _merged_imports(self, new: DataFrame, at: Version) -> DataFrame:
        old = self.snapshots.read("imports", IMPORTS, at)
        done = old.where(F.col("status") != "running").alias("o").join(new.alias("n"), "run_id").where((F.col("o.sha256") != F.col("n.sha256")) | (F.col("o.status") != F.col("n.status")))
        if not done.isEmpty():
            raise RefusedError("import_is_final")
        return old.join(new, "run_id", "left_anti").unionByName(new.select(*old.columns))

    # upkeep

    def migrate(self, step_bytes: int = 1 << 34) -> bool:
        """One step from format 1: the log comes first, then each step rewrites folders of about
        step_bytes in the present layout, their columns for search worked out. Readers and writers
        go on meanwhile, and a step that is lost is only done again. True while more is left."""
        self.snapshots.raise_format()
        return self._rewritten(lambda entries: _some([e for e in entries if e.get("layout") == 1], step_bytes, self._bytes)) and any(e.get("layout") == 1 for e in self.snapshots.current().tables.get("facts", []))

    def compact(self, folder_bytes: int = FOLDER_BYTES, step_bytes: int = 1 << 34) -> bool:
        """One step that puts small folders of the same days together; False if none was left."""

        def chosen(entries: list[Entry]) -> list[Entry]:
            by_day: dict[str, list[Entry]] = {}
            for e in entries:
                if e.get("layout") == LAYOUT and e["bytes"] < folder_bytes:
                    by_day.setdefault(e["path"].rsplit("/", 1)[-1], []).append(e)
            return _some([e for d in sorted(by_day) if len(by_day[d]) > 1 for e in by_day[d]], step_bytes, self._bytes, least=2)

        return self._rewritten(chosen)

    def _bytes(self, e: Entry) -> int:
        return e["bytes"] if "bytes" in e else self.snapshots.files.size(e["path"])

    def _rewritten(self, choose) -> bool:
        """Publishes chosen folders of facts written anew; what they hold stays the same."""
        staged: list[Entry] = []

        def make(at: Version) -> Change | None:
            self.snapshots.discard(*[e["path"] for e in staged])
            old = choose(at.tables.get("facts", []))
            staged[:] = self._written(self._facts_of(old).select(*FACTS_COLUMNS)) if old else []
            return Change({"facts": list(staged)}, {"facts": [e["path"] for e in old]}) if old else None

        self.snapshots.publish(make)
        return bool(staged)

    def import_records(self, run_id: str, head: DataFrame, facts: DataFrame, source_id: str = "", step_bytes: int | None = None) -> Version:
        """One finite input: its head row, and its contiguous records from 0. The run is taken up
        where it stands. Records are committed at once, or in steps of about `step_bytes`."""
        top = head.first()
        some = facts.select("source_id").head(1)
        attempt = ImportAttempt(self, run_id, some[0]["source_id"] if some else source_id)
        row = attempt.begin()
        if row["status"] != "running":
            if row["sha256"] is not None and row["sha256"] != top["sha256"]:
                raise RefusedError("import_is_final")
            return self.snapshots.current()
        if top["failure"]:
            if row["sha256"] is not None:  # it may pass; the run stays as it is, to be taken up again
                raise RefusedError("input_unavailable", top["failure"])
            attempt.finish(top["failure"])
            return self.snapshots.current()
        row = attempt.bind(top["sha256"], top["content_bytes"])
        came = None
        if step_bytes is not None:  # written once, as each step reads its part
            came = self.snapshots.stage("incoming", facts)
            facts = self.spark.read.schema(facts.schema).parquet(f"{self.snapshots.root}/{came}")
        at = -1
        while at < row["end_offset"] < row["content_bytes"]:
            at = row["end_offset"]
            row = attempt.advance(facts if step_bytes is None else facts.where(F.col("start_offset").between(at, at + step_bytes - 1)))
            if step_bytes is None:
                break
        if came is not None:
            self.snapshots.discard(came)
        attempt.finish("partial_final_line" if top["partial_tail"] else "")
        return self.snapshots.current()

    # projections

    def install_projection(self, name: str, queues: list[tuple[str, str]], unqueued: list[str], window_ns: int, bindings=(), expected: str | None = None) -> Projection:
        """Builds from the current version and records its manifest against that same version, so
        nothing can come between; `expected` refuses if the facts are not those the caller saw."""
        check_scope(queues, unqueued)
        base = self.snapshots.current()
        p = build_projection(facts_in_scope(self.facts(base), queues, unqueued), window_ns, bindings)
        if expected is not None and expected != p.input_revision:
            raise RefusedError("stale")
        said = {"queues": sorted(map(list, queues)), "unqueued": sorted(unqueued), "window_ns": window_ns, "bindings": sorted(map(list, bindings)), "input_revision": p.input_revision, "revision": p.revision}
        # facts that come meanwhile make it stale, as they would a moment later
        self.snapshots.publish(lambda at: Change(notes={"projections": {name: said}}, touch=_marks("projection", [(name,)])))
        return p

    def current_projection(self, name: str) -> Projection:
        """Rebuilt and verified: absent, stale (facts changed) and malformed are told apart."""
        at = self.snapshots.current()
        m = at.notes.get("projections", {}).get(name)
        if m is None:
            raise RefusedError("absent")
        if m.get("revision") is None:
            raise RefusedError("stale", "invalidated by a purge")
        p = build_projection(facts_in_scope(self.facts(at), [tuple(q) for q in m["queues"]], m["unqueued"]), m["window_ns"], [tuple(b) for b in m["bindings"]])
        if p.input_revision != m["input_revision"]:
            raise RefusedError("stale")
        if p.revision != m["revision"]:
            raise RefusedError("malformed")
        return p

    # retention

    def preview_retention(self, instance: str, before_ns: int, limit: int = RETENTION_BATCH) -> tuple[DataFrame, bool]:
        """Covered facts, oldest first; they need not be purgeable."""
        _check_retention(instance, limit)
        at = self.snapshots.current()
        rows = covered(self.facts(at), self.checkpoints(at), instance, before_ns)
        rows = rows.select(*REF, "search_ns", "event_id").orderBy("search_ns", "event_id").limit(limit + 1).collect()
        shape = ", ".join(f"{c} {'string' if c.endswith('_id') and c != 'event_id' else 'long'}" for c in (*REF, "search_ns", "event_id"))
        return self.spark.createDataFrame(rows[:limit], shape), len(rows) > limit

    def purge_retention(self, instance: str, before_ns: int, limit: int | None = RETENTION_BATCH) -> PurgeResult:
        """Purgeable facts are chosen again, their digests kept, the revisions of projections
        cleared, and the facts left out of the next version, of which only folders that hold such
        facts are written anew. limit None purges all, in bulk."""
        if limit is not None:
            _check_retention(instance, limit)
        result = PurgeResult(0, False, 0)
        staged: list[str] = []

        def make(base: Version) -> Change | None:
            nonlocal result
            self.snapshots.discard(*staged)
            change, result = self._purge(base, instance, before_ns, limit)
            staged[:] = [e["path"] for t in change.add.values() for e in t]
            return change if result.purged else None

        self.snapshots.publish(make)
        return result

    def _purge(self, base: Version, instance: str, before_ns: int, limit: int | None) -> tuple[Change, PurgeResult]:
        entries = base.tables.get("facts", [])
        if not entries:
            return Change(), PurgeResult(0, False, 0)
        facts = self._facts_of(entries, file_path=True)
        every = purgeable(facts, self.checkpoints(base), self.snapshots.read("origins", ORIGINS, base), self.snapshots.read("imports", IMPORTS, base), instance, before_ns)
        chosen = every if limit is None else every.orderBy("search_ns", "event_id").limit(limit)
        gone = self.snapshots.stage("purged", chosen.select(*REF, purge_digest().alias("digest"), "folder"))
        dead = self.spark.read.schema(PURGED + ", folder string").parquet(f"{self.snapshots.root}/{gone}")
        n = dead.count()
        if not n:
            self.snapshots.discard(gone)
            return Change(), PurgeResult(0, False, 0)
        held = {r["folder"] for r in dead.select("folder").distinct().collect()}  # folders of one version
        touched = [e for e in entries if e["path"] in held]
        kept = self._written(self._facts_of(touched).join(dead, list(REF[:3]), "left_anti").select(*FACTS_COLUMNS))
        projections = {k: {**m, "revision": None} for k, m in base.notes.get("projections", {}).items()}
        origins = [tuple(r) for r in dead.select("source_id", "origin_id").distinct().limit(NEAR_ORIGINS + 1).collect()]
        change = Change({"facts": kept, "purged": [{"path": gone}]}, {"facts": [e["path"] for e in touched]}, {"projections": projections, "purged_at": int(time.time())}, _marks("origin", origins) | {"projection:*"})
        more = limit is not None and not every.join(dead, list(REF[:3]), "left_anti").isEmpty()
        return change, PurgeResult(n, more, len(projections))


def _some(entries: list[Entry], step_bytes: int, size, least: int = 1) -> list[Entry]:
    """The first entries, of about step_bytes, and `least` at least."""
    out, total = [], 0
    for e in entries:
        if total >= step_bytes and len(out) >= least:
            break
        out.append(e)
        total += size(e)
    return out


def _check_retention(instance: str, limit: int) -> None:
    if not instance or len(instance) > 1024 or any(c in instance for c in "\0\r\n\t"):
        raise RefusedError("invalid_instance")
    if not 1 <= limit <= RETENTION_BATCH:
        raise RefusedError("invalid_limit")
