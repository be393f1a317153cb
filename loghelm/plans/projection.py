"""The full projection of a set of facts, as lazy DataFrames that share one index."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.operators.generations import assigned, generations, unresolved
from loghelm.operators.identity import queue_instances, revision
from loghelm.operators.links import check_options, links
from loghelm.operators.partition import other, refuse_invalid
from loghelm.operators.prequeue import prequeue_reports, sessions
from loghelm.operators.recipients import recipients
from loghelm.operators.summaries import summaries
from loghelm.schema import MAX_FACTS

MINUTE_NS = 60 * 10**9


@dataclass(frozen=True)
class Projection:
    """All parts are lazy; `input_revision` and `revision` were computed from the same facts."""

    revision: str
    input_revision: str
    rows: DataFrame
    instances: DataFrame
    recipients: DataFrame
    summaries: DataFrame
    links: DataFrame
    prequeue: DataFrame
    sessions: DataFrame
    unresolved: DataFrame
    other: DataFrame


def projection_digest(input_revision: str, window_ns: int, bindings: Sequence[tuple[str, str, str]]) -> str:
    said = json.dumps(["loghelm-projection-1", input_revision, window_ns, sorted(map(list, bindings))], separators=(",", ":"))
    return hashlib.sha256(said.encode()).hexdigest()


def build_projection(facts: DataFrame, window_ns: int = MINUTE_NS, bindings: Sequence[tuple[str, str, str]] = (), limit: int | None = MAX_FACTS) -> Projection:
    """limit: refuse more facts than this; None is the bulk mode, partitioned by stream."""
    check_options(window_ns, bindings)
    refuse_invalid(facts, limit)
    found = revision(facts).first()
    input_revision = found["revision"] if found and found["revision"] else hashlib.sha256(b"").hexdigest()
    rev = projection_digest(input_revision, window_ns, bindings)
    rows = assigned(facts)
    keyed = queue_instances(generations(rows)).withColumn("revision", F.lit(rev))
    return Projection(rev, input_revision, rows, keyed, recipients(rows), summaries(rows), links(facts, window_ns, bindings), prequeue_reports(facts), sessions(facts), unresolved(rows), other(facts))
