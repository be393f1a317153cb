"""Columns of a fact, the vocabularies, and the bounds of the interactive interface."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed vocabularies and bounds.
TIME_QUALITIES = ("unknown", "wall_only", "year_without_zone", "configured_year_and_zone", "inferred_year_and_zone", "explicit_offset")
ORDERING_QUALITIES = ("configured_year_and_zone", "inferred_year_and_zone", "explicit_offset")
KINDS = ("unknown", "connect", "disconnect", "reject", "message", "delivery", "removed", "bounce")
QUEUED_KINDS = ("message", "delivery", "removed", "bounce")
SERVICES = ("smtpd", "pickup", "cleanup", "qmgr", "smtp", "lmtp", "local", "pipe", "bounce", "virtual")
DELIVERY_SCOPES = {"smtp": "smtp_peer", "lmtp": "lmtp_peer", "pipe": "pipe_command", "local": "local_agent", "virtual": "virtual_agent"}
MAILBOX_SCOPES = {"local": "local_mailbox", "virtual": "virtual_mailbox"}
MAX_LINE_BYTES = 65_536
MAX_FIELDS = 32
MAX_PARTS = 32
MAX_KEY = 32
MAX_FACTS = 4_096
MAX_SCOPE_PARTS = 64
MAX_BINDINGS = 64
MAX_BOUNDARIES = 256
MAX_PAGE = 200
DAY_NS = 86_400 * 10**9
MAX_LINK_WINDOW_NS = DAY_NS
MAX_SEARCH_WINDOW_NS = 31 * DAY_NS
RETENTION_BATCH = 256

#: provenance: the identity of a fact
REF = ("source_id", "origin_id", "start_offset", "end_offset")
QUEUE = ("instance", "queue_id")
STREAM = ("instance", "queue_id", "source_id", "origin_id")
GENERATION = (*STREAM, "cycle")

OBSERVATION = "time_raw string, time_utc_ns long, time_quality string, time_year int, time_zone string, host string, program string, service string, pid string, queue_id string, no_queue boolean, kind string, message string, fields map<string,string>, native_status_field string, parse_error string"
FACT = f"source_id string, origin_id string, start_offset long, end_offset long, instance string, raw binary, {OBSERVATION}"


class RefusedError(ValueError):
    """Input or a question that is refused as a whole; nothing partial is returned."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@cache
def field(name: str) -> Column:
    """A parsed field: NULL where absent, '' where observed empty."""
    return F.try_element_at(F.col("fields"), F.lit(name))


def ref() -> Column:
    return F.struct(*REF)
