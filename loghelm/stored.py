"""Queries that run over a store of the events table: commits, layouts, searches, derived tables,
streams and finite inputs, with their SQL twins."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.functions.facts import usable_time
from loghelm.operators.identity import revision
from loghelm.oracle import EVENTS, SESSIONS, SUMMARY, _KEY, cycles, facts
from loghelm.plans.detail import search_matches
from loghelm.plans.search import SearchQuery, searchable
from loghelm.schema import DAY_NS, FACT, GENERATION
from loghelm.sources.finite import finite_records
from loghelm.store.derived import Derived
from loghelm.store.facts_store import CHECKPOINTS, FACTS_COLUMNS, ORIGINS, FactStore
from loghelm.store.imports import IMPORTS
from loghelm.store.workspace import new_folder
from loghelm.streaming.sessions import latest, read_sessions, write_sessions
from loghelm.views import event_facts, event_sessions

JANUARY = (1704067200 * 10**9, 1706745600 * 10**9)
BEFORE = 1705276800 * 10**9
_STORES: dict[tuple[str, str], FactStore] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_store(spark: SparkSession, sf_dir: str) -> FactStore:
    """The events as facts in a store, written once for an application and folder, with the ids that
    the events have."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = FactStore(spark, new_folder(spark))
        store.commit(event_facts(_events(spark, sf_dir)), ids="event_id")
        _STORES[key] = store
    return _STORES[key]


def _parts(spark: SparkSession, sf_dir: str) -> FactStore:
    """A store that was written by three commits, the second of which sends the first anew."""
    rows = event_facts(_events(spark, sf_dir))
    store = FactStore(spark, new_folder(spark))
    early, middle = F.col("event_id") % 3 == 0, F.col("event_id") % 3 < 2
    for part in (rows.where(early), rows.where(middle), rows):
        store.commit(part)
    return store


def store_event_ids(spark, sf_dir):
    return _parts(spark, sf_dir).facts().select("source_id", "origin_id", "start_offset", "event_id")


def store_compacted(spark, sf_dir):
    """What a store tells of each day and instance after all its small folders were put together."""
    store = _parts(spark, sf_dir)
    while store.compact():
        pass
    day = F.floor(F.col("search_ns") / DAY_NS).cast("long")
    return store.facts().groupBy(day.alias("day"), "instance").agg(F.count(F.lit(1)).alias("n"), F.min("search_ns").alias("low"), F.max("search_ns").alias("high"), F.count("recipient_domain").alias("domains"))


def store_migrated(spark, sf_dir):
    """A store of format 1, written before domains were stored, after one of two steps: a search
    by domain over both layouts."""
    folder = new_folder(spark)
    store = FactStore(spark, folder)
    rows = searchable(event_facts(_events(spark, sf_dir)))
    rows = rows.select(*[F.lit(None).cast("string").alias(c) if c.endswith("_domain") else F.col(c) for c in FACTS_COLUMNS])
    paths = [store.snapshots.stage("facts", rows.where(F.col("event_id") % 2 == k)) for k in range(2)]
    store.snapshots.files.put_if_absent(f"manifests/{1:012d}.json", json.dumps({"format": 1, "tables": {"facts": paths}, "notes": {}}))
    store = FactStore(spark, folder)
    store.migrate(step_bytes=1)
    q = SearchQuery("recipient_domain", "example.net", "mx-1", *JANUARY, 200)
    return store.search_plan(q, with_limit=False).select("event_id", "time_utc_ns", "start_offset")


def store_purged(spark, sf_dir):
    """What is left after a purge in bulk: src-0 was retired, src-1 is followed still, src-2 was
    imported. The purged facts are sent again, and skipped."""
    rows = event_facts(_events(spark, sf_dir))
    store = FactStore(spark, new_folder(spark))
    by = rows.groupBy("source_id", "origin_id").agg(F.floor(F.max("end_offset") * 3 / 4).alias("offset"))
    file = F.col("source_id") != "src-2"
    marks = by.select("source_id", "origin_id", "offset", F.lit("a").alias("anchor"))
    state = F.when(F.col("source_id") == "src-0", "retired").otherwise("following")
    origins = by.where(file).select("source_id", "origin_id", F.lit("/var/log/mail.log").alias("path"), F.lit(1).cast("long").alias("device"), F.lit(2).cast("long").alias("inode"), F.lit("00").alias("prefix"), state.alias("state"))
    run = F.concat_ws("/", "source_id", "origin_id")
    runs = by.where(~file).select(run.alias("run_id"), "source_id", "origin_id", F.sha2(run, 256).alias("sha256"), F.col("offset").alias("content_bytes"), F.lit(0).cast("long").alias("records"), F.col("offset").alias("end_offset"), F.lit("complete").alias("status"), F.lit("").alias("error"))
    shaped = lambda df, shape: df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in shape.split(", ")])
    store.commit(rows, origins=shaped(origins, ORIGINS), checkpoints=shaped(marks, CHECKPOINTS), imports=shaped(runs, IMPORTS))
    for i in range(3):
        store.purge_retention(f"mx-{i}", BEFORE, None)
    store.commit(rows)
    return store.facts().select("instance", "start_offset")


def derived_summaries(spark, sf_dir):
    """Summaries that were refreshed after late facts of every seventh queue, kept beside the store."""
    rows = event_facts(_events(spark, sf_dir))
    late = (F.pmod(F.crc32(F.col("queue_id").cast("binary")), F.lit(7)) == 0) & (F.col("event_id") % 2 == 0)
    store = FactStore(spark, new_folder(spark))
    derived = Derived(store)
    store.commit(rows.where(~late))
    derived.refresh()
    store.commit(rows)
    derived.refresh()
    return derived.summaries().select(*GENERATION, "n_recipients", "sent", "delivered", "deferred", "bounced", "unknown", "n_facts")


def derived_revision(spark, sf_dir):
    """Whether the revision that is kept beside the store, made in three steps, is that of all facts."""
    store = FactStore(spark, new_folder(spark))
    rows, derived = event_facts(_events(spark, sf_dir)), Derived(store)
    for k in (1, 2, 3):
        store.commit(rows.where(F.col("event_id") % 3 < k))
        derived.refresh()
    whole = revision(rows, ("source_id",)).select("source_id", F.col("revision").alias("want"), "n_facts")
    from loghelm.operators.identity import revision_of

    kept = revision_of(derived.digests(), ("source_id",)).select("source_id", "revision")
    return whole.join(kept, "source_id").select("source_id", "n_facts", (F.col("revision") == F.col("want")).alias("same"))


def sessions_streamed(spark, sf_dir):
    """Sessions by the stream, whose input came in three parts, each a micro-batch."""
    folder = new_folder(spark)
    rows = event_sessions(_events(spark, sf_dir))
    shape = [c.strip().split()[0] for c in FACT.replace("map<string,string>", "map").split(", ")]
    cuts = [0, *[int(x) for x in rows.approxQuantile("start_offset", [0.3, 0.6], 0.01)], 2**62]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows.where((F.col("start_offset") >= a) & (F.col("start_offset") < b)).select(*shape).write.parquet(f"{folder}/in/{k}")
        # taken up again for each part, which so may have any number of files
        stream = spark.readStream.schema(FACT).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        write_sessions(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    s = latest(read_sessions(spark, f"{folder}/out"))
    return s.select("start_offset", "pid", "client", F.coalesce("reason", F.lit("assigned")).alias("result"))


def matched_page(spark, sf_dir):
    """A page of hits with the generation of each, or why it has none."""
    store = event_store(spark, sf_dir)
    q = SearchQuery("recipient", "r3@example.net", "mx-1", *JANUARY, 40)
    m = search_matches(store.facts(), q, limit=4096)
    return m.matches.select("event_id", "match", "cycle", "reason")


def finite_lines(spark, sf_dir):
    """Every document as a finite input: its lines with their byte offsets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = finite_records(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))
    lines = r.where(F.col("start_offset").isNotNull() & (F.col("read_error") == ""))
    return lines.select("path", "start_offset", "end_offset", F.sha2("raw", 256).alias("digest"))


def finite_heads(spark, sf_dir):
    """Every document as a gzip of two members: what was found out of it before a line is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def packed(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(t[: len(t) // 2], 1) + gzip.compress(t[len(t) // 2 :], 1) for t in texts], pa.binary())], ["path", "content"])

    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")).mapInArrow(packed, "path string, content binary")
    r = finite_records(files, gzip=True)
    return r.where(F.col("start_offset").isNull()).select("path", "sha256", "content_bytes", "partial_tail", "failure")


def _page_sql() -> str:
    return "instance = 'mx-1' AND t >= 1704067200000000000 AND t < 1706745600000000000"


MARKS = "c AS (SELECT source_id, origin_id, max(end_offset) * 3 // 4 AS off FROM f GROUP BY ALL)"
SQL = {
    "store_event_ids": f"""WITH {facts()}, p AS (SELECT *, event_id % 3 AS part FROM f),
n AS (SELECT part, count(*) AS n FROM p GROUP BY part),
b AS (SELECT source_id, origin_id, start_offset, part, row_number() OVER (PARTITION BY part ORDER BY source_id, origin_id, start_offset) AS place FROM p)
SELECT source_id, origin_id, start_offset, CAST(place + coalesce((SELECT sum(x.n * (b.part - x.part)) FROM n x WHERE x.part < b.part), 0) AS BIGINT) AS event_id FROM b""",
    "store_compacted": f"WITH {facts()} SELECT CAST(floor(t / 86400000000000) AS BIGINT) AS day, instance, count(*) AS n, min(t) AS low, max(t) AS high, count(*) FILTER (address LIKE '%@example.net') AS domains FROM f GROUP BY ALL",
    "store_migrated": f"WITH {facts()} SELECT event_id, t AS time_utc_ns, start_offset FROM f WHERE address LIKE '%@example.net' AND {_page_sql()}",
    "store_purged": f"WITH {facts()}, {MARKS} SELECT instance, start_offset FROM f JOIN c USING (source_id, origin_id) WHERE NOT (coalesce(t < {BEFORE}, FALSE) AND end_offset <= off AND source_id <> 'src-1')",
    "derived_summaries": cycles() + SUMMARY + f" SELECT {_KEY}, n_recipients, sent, delivered, deferred, bounced, unknown, n_facts FROM s",
    "derived_revision": f"WITH {facts()} SELECT source_id, count(*) AS n_facts, TRUE AS same FROM f GROUP BY source_id",
    "sessions_streamed": SESSIONS,
    "matched_page": cycles() + f""", hits AS (SELECT event_id FROM f WHERE address = 'r3@example.net' AND {_page_sql()} ORDER BY t, event_id LIMIT 40)
SELECT event_id, CASE WHEN reason = 'resolved' THEN 'candidate' ELSE 'unresolved' END AS match, CASE WHEN reason = 'resolved' THEN cycle END AS cycle, CASE WHEN reason <> 'resolved' THEN reason END AS reason
FROM a WHERE event_id IN (SELECT event_id FROM hits)""",
    "finite_lines": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT path, unnest(range(1, len(l))) AS i, unnest(l[:-2]) || chr(10) AS line FROM d WHERE len(l) > 1),
e AS (SELECT path, line, octet_length(encode(line)) AS n, sum(octet_length(encode(line))) OVER (PARTITION BY path ORDER BY i) AS e FROM s)
SELECT path, CAST(e - n AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset, sha256(line) AS digest FROM e WHERE n <= 65536""",
    "finite_heads": """SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS content_bytes,
  coalesce(text, '') <> '' AND right(text, 1) <> chr(10) AS partial_tail, '' AS failure FROM documents""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
