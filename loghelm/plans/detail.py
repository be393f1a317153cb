"""Search answers with candidates, one candidate's detail, and its timeline."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.scalars import wire_value
from loghelm.plans.cursors import CandidateId, timeline_cursor, timeline_position
from loghelm.plans.projection import Projection, build_projection
from loghelm.plans.scope import facts_in_scope
from loghelm.plans.search import SearchPage, SearchQuery, search
from loghelm.schema import GENERATION, MAX_FACTS, REF, RefusedError

DEFAULT_FACTS = 1024
MAX_RESPONSE_BYTES = 1 << 20
# Fixed vocabulary: the code of a refusal and the status a server would answer with.
STATUS = {"invalid_query": 400, "invalid_cursor": 400, "invalid_candidate": 400, "unauthenticated": 401, "forbidden": 403, "absent": 404, "method_not_allowed": 405, "stale": 409, "too_many_facts": 422, "response_too_large": 422, "busy": 429, "unavailable": 503}


class Admission:
    """At most `most` questions at a time; another is refused at once, and a job can be cancelled."""

    def __init__(self, most: int = 2):
        self._slots = threading.BoundedSemaphore(most)

    @contextmanager
    def enter(self, spark=None, group: str | None = None):
        if not self._slots.acquire(blocking=False):
            raise RefusedError("busy")
        try:
            if spark is not None and group:
                spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
            yield
        finally:
            self._slots.release()


@dataclass(frozen=True)
class Matches:
    page: SearchPage
    matches: DataFrame


def _facts_of_hits(facts: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    rows = hits.select("instance", "queue_id").distinct().collect()  # a page of hits at most
    queues = sorted((r["instance"], r["queue_id"]) for r in rows if r["queue_id"])
    unqueued = sorted({r["instance"] for r in rows if not r["queue_id"]})
    return facts_in_scope(facts, queues, unqueued, limit)


def search_matches(stored: DataFrame, q: SearchQuery, limit: int = DEFAULT_FACTS) -> Matches:
    """Each hit with its candidate generation, or why it has none: unresolved, prequeue, other."""
    page = search(stored, q)
    if page.hits.isEmpty():
        return Matches(page, page.hits.withColumns({"match": F.lit(None).cast("string"), "cycle": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")}))
    facts = _facts_of_hits(stored, page.hits, limit)
    p = build_projection(facts, limit=limit)
    places = p.rows.select(*REF, "cycle", "reason")
    reports = p.prequeue.select(*REF, F.lit(True).alias("prequeue"))
    met = page.hits.join(places, list(REF), "left").join(reports, list(REF), "left").join(facts.select(*REF, F.lit(True).alias("found")), list(REF), "left")
    match = F.when(F.col("reason") == "resolved", F.lit("candidate")).when(F.col("reason").isNotNull(), F.lit("unresolved")).when(F.col("prequeue"), F.lit("prequeue")).when(F.col("found"), F.lit("other"))
    out = met.withColumn("match", match)
    if not out.where(F.col("match").isNull()).isEmpty():
        raise RefusedError("unavailable", "the facts changed between page and projection")
    return Matches(page, out.select(*page.hits.columns, "match", F.when(F.col("match") == "candidate", F.col("cycle")).alias("cycle"), F.when(F.col("match") == "unresolved", F.col("reason")).alias("reason")))


def snapshot(facts: DataFrame, candidate: str, limit: int = MAX_FACTS) -> tuple[Projection, dict]:
    """The rebuilt projection of the candidate's whole queue, and its generation's row."""
    c = CandidateId.decode(candidate)
    p = build_projection(facts_in_scope(facts, [(c.instance, c.queue_id)], [], limit), limit=limit)
    found = p.instances.where((F.col("instance") == c.instance) & (F.col("queue_id") == c.queue_id) & (F.col("generation") == c.generation)).head(1)
    if p.rows.isEmpty():
        raise RefusedError("absent")
    if p.revision != c.revision:
        raise RefusedError("stale")
    if not found:
        raise RefusedError("absent")
    return p, found[0].asDict()


def candidates(p: Projection) -> list[str]:
    """Ids of all generations of an interactive (bounded) projection."""
    rows = p.instances.select("generation", "instance", "queue_id").orderBy("instance", "queue_id", "generation").collect()
    return [CandidateId(p.revision, r["generation"], r["instance"], r["queue_id"]).encode() for r in rows]


def _of(df: DataFrame, row: dict) -> DataFrame:
    cond = F.lit(True)
    for k in GENERATION:
        cond = cond & (F.col(k) == F.lit(row[k]))
    return df.where(cond)


def detail(facts: DataFrame, candidate: str, limit: int = MAX_FACTS) -> tuple[DataFrame, DataFrame]:
    """(summary, recipients) of one candidate; RefusedError absent or stale."""
    p, row = snapshot(facts, candidate, limit)
    return _of(p.summaries, row), _of(p.recipients, row).orderBy("address")


def positioned(rows: DataFrame) -> DataFrame:
    """Rows of generations with their position (from 0) in the timed order of their generation,
    whose places in the stream follow one another."""
    return rows.withColumn("position", F.col("place") - F.min("place").over(Window.partitionBy(*GENERATION)))


def timeline(facts: DataFrame, candidate: str, limit: int = 50, cursor: str | None = None, raw: bool = False) -> tuple[DataFrame, str | None]:
    """A page of the candidate's facts in timed order; raw lines only if asked for."""
    if not 1 <= limit <= 200:
        raise RefusedError("invalid_query", "limit")
    start = timeline_position(cursor, candidate, raw) if cursor else 0
    p, row = snapshot(facts, candidate)
    own = _of(p.rows, row)
    n = row["n_facts"]
    if start >= n:
        raise RefusedError("invalid_cursor")
    page = positioned(own).where(F.col("position").between(start, start + limit - 1)).orderBy("position")
    values = F.transform_values("fields", lambda _, v: wire_value(v))
    out = page.select("position", *[F.col(c).cast("string").alias(c) for c in REF], "t", "time_quality", "kind", "service", wire_value(F.col("message")).alias("message"), values.alias("fields"), (wire_value(F.col("raw")) if raw else F.lit(None)).alias("raw"))
    return out, timeline_cursor(candidate, raw, start + limit) if start + limit < n else None


def to_json(df: DataFrame, most: int = MAX_RESPONSE_BYTES) -> str:
    """The rows as one JSON array, or a refusal: never a part of it."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    # tested before anything is collected
    if (rows.agg(F.sum(F.octet_length("line"))).first()[0] or 0) > most:
        raise RefusedError("response_too_large")
    lines = [r[0] for r in rows.collect()]
    out = "[" + ",".join(lines) + "]"
    if len(out.encode()) > most:
        raise RefusedError("response_too_large")
    return out
