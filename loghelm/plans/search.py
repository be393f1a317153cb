"""Exact, time-windowed, keyset-paginated search over facts."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.facts import usable_time
from loghelm.functions.scalars import address_domain
from loghelm.plans.cursors import SearchCursor
from loghelm.schema import DAY_NS, MAX_PAGE, MAX_SEARCH_WINDOW_NS, REF, RefusedError, field

FIELDS = ("sender", "recipient", "queue_id", "message_id", "sender_domain", "recipient_domain")
DEFAULT_LIMIT = 50
MAX_QUERY_BYTES = 8192


def searchable(facts: DataFrame) -> DataFrame:
    """The stored form: promoted and derived columns are computed once, at write time, so that a
    question filters plain columns that reach the Parquet scan."""
    sender, recipient = field("from"), field("to")
    return facts.select(
        "*",
        usable_time().alias("search_ns"),
        sender.alias("sender"),
        recipient.alias("recipient"),
        field("message-id").alias("message_id"),
        field("status").alias("status"),
        address_domain(sender).alias("sender_domain"),
        address_domain(recipient).alias("recipient_domain"),
    )


@dataclass(frozen=True)
class SearchQuery:
    field: str
    value: str
    instance: str
    from_ns: int
    until_ns: int
    limit: int = DEFAULT_LIMIT
    cursor: SearchCursor | None = None

    def digest(self) -> bytes:
        h = hashlib.sha256(b"loghelm-search-1")
        for p in (self.field, self.value, self.instance, str(self.from_ns), str(self.until_ns)):
            h.update(struct.pack(">Q", len(p.encode())) + p.encode())
        return h.digest()

    def check(self) -> None:
        if self.field not in FIELDS or not self.instance:
            raise RefusedError("invalid_query", "field or instance")
        if not self.value and self.field not in ("sender", "recipient"):
            raise RefusedError("invalid_query", "value")
        if not 1 <= self.limit <= MAX_PAGE:
            raise RefusedError("invalid_query", "limit")
        if not 0 < self.until_ns - self.from_ns <= MAX_SEARCH_WINDOW_NS or not -(2**63) <= self.from_ns < self.until_ns < 2**63:
            raise RefusedError("invalid_query", "window")
        if self.cursor and (self.cursor.question != self.digest() or not self.from_ns <= self.cursor.time_utc_ns < self.until_ns):
            raise RefusedError("invalid_cursor")


@dataclass(frozen=True)
class SearchPage:
    hits: DataFrame
    more: bool
    cursor: str | None


def search_plan(stored: DataFrame, q: SearchQuery, with_limit: bool = True) -> DataFrame:
    """Hits in (instant, event_id) order, one more than the page to see whether it goes on.

    After a cursor the lower bound on time is raised to the cursor's, besides the tuple test:
    Catalyst does not derive it, and it prunes row groups.
    """
    q.check()
    t, i = F.col("search_ns"), F.col("event_id")
    low = q.cursor.time_utc_ns if q.cursor else q.from_ns
    hits = stored.where((F.col(q.field) == q.value) & (F.col("instance") == q.instance) & (t >= low) & (t < q.until_ns))
    if q.field == "queue_id":
        hits = hits.where(F.col("queue_id") != "")
    if q.cursor:
        hits = hits.where((t > q.cursor.time_utc_ns) | ((t == q.cursor.time_utc_ns) & (i > q.cursor.event_id)))
    hits = hits.select("event_id", t.alias("time_utc_ns"), *REF, "instance", "queue_id", "kind", "service").orderBy("time_utc_ns", "event_id")
    return hits.limit(q.limit + 1) if with_limit else hits


def search(stored: DataFrame, q: SearchQuery) -> SearchPage:
    """One page: a top-k of at most MAX_PAGE + 1 rows is all that reaches the driver."""
    plan = search_plan(stored, q)
    rows = plan.collect()
    more = len(rows) > q.limit
    rows = rows[: q.limit]
    last = rows[-1] if more else None
    cursor = SearchCursor(q.digest(), last["time_utc_ns"], last["event_id"]).encode() if last else None
    return SearchPage(stored.sparkSession.createDataFrame(rows, plan.schema), more, cursor)


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?Z\Z")


def parse_utc(text: str) -> int:
    if not _DATE.match(text):
        raise RefusedError("invalid_query", "date")
    whole, _, part = text[:-1].partition(".")
    try:
        at = datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC)
    except ValueError:
        raise RefusedError("invalid_query", "date") from None
    ns = int(at.timestamp()) * 10**9 + int(part.ljust(9, "0") or 0)
    if not -(2**63) <= ns < 2**63:
        raise RefusedError("invalid_query", "date")
    return ns


def parse_request(raw: str, now_ns: int) -> SearchQuery:
    """A query string: known keys once each; from and until together (default: the last day); a
    cursor only with dates; a canonical limit."""
    if len(raw) > MAX_QUERY_BYTES:
        raise RefusedError("invalid_query", "too long")
    try:
        pairs = parse_qsl(raw, keep_blank_values=True, strict_parsing=True, errors="strict") if raw else []
    except ValueError:
        raise RefusedError("invalid_query") from None
    got = dict(pairs)
    if len(got) != len(pairs) or set(got) - {"field", "value", "instance", "from", "until", "limit", "cursor"}:
        raise RefusedError("invalid_query", "keys")
    if not {"field", "value", "instance"} <= set(got) or ("from" in got) != ("until" in got) or ("cursor" in got and "from" not in got):
        raise RefusedError("invalid_query", "keys")
    limit = got.get("limit", str(DEFAULT_LIMIT))
    if not re.match(r"[1-9]\d{0,3}\Z", limit):
        raise RefusedError("invalid_query", "limit")
    until = parse_utc(got["until"]) if "until" in got else now_ns
    start = parse_utc(got["from"]) if "from" in got else until - DAY_NS
    q = SearchQuery(got["field"], got["value"], got["instance"], start, until, int(limit), SearchCursor.decode(got["cursor"]) if "cursor" in got else None)
    q.check()
    return q
