"""The events table seen as facts, so that every operator has input in the driver's tables.

The same definitions exist as SQL for DuckDB in oracle.FACTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_columns(events: DataFrame) -> DataFrame:
    """events with u (user), k (from props), us (microseconds) and day."""
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", F.col("user_id").alias("u"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_micros(ts).alias("us"), F.dayofmonth(ts).alias("day"))


def queue_of(u, day):
    return F.concat(F.lit("A"), F.lpad(u.cast("string"), 4, "0"), F.lpad(day.cast("string"), 2, "0"))


def event_facts(events: DataFrame, hour_ties: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """FACT rows: signup, view, click, purchase and error events as lines of five services; `also`
    names columns of event_columns to keep beside them."""
    e = event_columns(events)
    kind = F.col("event_type")
    s = lambda c: F.col(c).cast("string")
    is_hint = (kind == "click") & (F.col("event_id") % 5 == 0)
    t = F.col("us") - F.pmod("us", F.lit(3_600_000_000)) if hour_ties else F.col("us")
    # half of the users share senders and message ids by threes, so that links can hold
    who = F.when(F.col("u") % 30 < 15, F.col("u") % 3).otherwise(F.col("u")).cast("string")
    sender = F.concat(F.lit("u"), who, F.lit("@example.org"))
    mid = F.concat(F.lit("m"), who, F.lit("-"), F.when(F.col("event_id") % 50 == 0, s("event_id")).otherwise(F.lit("0")), F.lit("@example.org"))
    rcpt = F.when(F.col("k") % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), (F.col("k") % 7).cast("string"), F.lit("@example.net")))
    target = queue_of((F.col("u") + 3) % 150, F.col("day"))
    status = F.when((kind == "purchase") | is_hint, F.lit("sent")).otherwise(F.lit("deferred"))
    reply = F.when(is_hint, F.concat(F.lit("250 2.0.0 Ok: queued as "), target)).when(kind == "click", F.lit("connect timed out")).when(F.col("value") > 100, F.lit("delivered to maildir")).otherwise(F.lit("delivered to command: filter"))
    native = F.concat(status, F.lit(" ("), reply, F.lit(")"))
    delivered = kind.isin("click", "purchase")
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    return e.select(
        F.concat(F.lit("src-"), (F.col("u") % 3).cast("string")).alias("source_id"),
        F.concat(F.lit("org-"), F.when(F.col("u") % 10 == 0, (F.col("event_id") % 2).cast("string")).otherwise(F.lit("0"))).alias("origin_id"),
        (F.col("event_id") * 128).alias("start_offset"),
        (F.col("event_id") * 128 + 128).alias("end_offset"),
        F.concat(F.lit("mx-"), (F.col("u") % 3).cast("string")).alias("instance"),
        F.lit(None).cast("binary").alias("raw"),
        F.lit("").alias("time_raw"),
        F.when(F.col("event_id") % 997 != 0, t * 1000).alias("time_utc_ns"),
        F.when(F.col("event_id") % 997 == 0, F.lit("wall_only")).when(F.col("event_id") % 2 == 0, F.lit("explicit_offset")).otherwise(F.lit("configured_year_and_zone")).alias("time_quality"),
        F.lit(2024).alias("time_year"),
        F.lit("UTC").alias("time_zone"),
        F.concat(F.lit("mx-"), (F.col("u") % 3).cast("string")).alias("host"),
        F.lit("postfix").alias("program"),
        F.when(kind == "signup", F.lit("cleanup")).when(kind == "click", F.lit("smtp")).when(kind == "purchase", F.lit("local")).otherwise(F.lit("qmgr")).alias("service"),
        s("u").alias("pid"),
        queue_of(F.col("u"), F.col("day")).alias("queue_id"),
        F.lit(False).alias("no_queue"),
        F.when(delivered, F.lit("delivery")).when(kind == "error", F.lit("removed")).otherwise(F.lit("message")).alias("kind"),
        F.when(kind == "error", F.lit("removed")).otherwise(F.lit("")).alias("message"),
        F.when(kind == "signup", pair("message-id", mid))
        .when(kind == "view", pair("from", sender, "size", "100", "nrcpt", "1 (queue active)"))
        .when(delivered, pair("to", rcpt, "relay", F.lit("peer[192.0.2.1]:25"), "dsn", "2.0.0", "status", status, "reply", reply))
        .alias("fields"),
        F.when(delivered, native).alias("native_status_field"),
        F.lit("").alias("parse_error"),
        "event_id",
        *also,
    )


def event_sessions(events: DataFrame) -> DataFrame:
    """FACT rows before any queue: signup connects, error disconnects, other events are reports."""
    facts = event_facts(events, also=("u", "event_type"))
    kind = F.col("event_type")
    client = F.concat(F.lit("host"), (F.col("u") % 5).cast("string"), F.lit("[192.0.2."), F.when(F.col("event_id") % 41 == 0, F.lit("9")).otherwise((F.col("u") % 5).cast("string")), F.lit("]"))
    action = F.when(kind == "view", F.lit("reject_warning")).otherwise(F.lit("reject"))
    edge = kind.isin("signup", "error")
    over = {
        "service": F.lit("smtpd"),
        "queue_id": F.lit(""),
        "no_queue": ~edge,
        "kind": F.when(kind == "signup", F.lit("connect")).when(kind == "error", F.lit("disconnect")).otherwise(F.lit("reject")),
        "message": F.when(kind == "signup", F.concat(F.lit("connect from "), client)).when(kind == "error", F.concat(F.lit("disconnect from "), client, F.lit(" ehlo=1"))).otherwise(F.concat(action, F.lit(": RCPT from "), client, F.lit(": 554 5.7.1 refused; from=<a@example.org> to=<b@example.net> proto=ESMTP"))),
        "fields": F.when(~edge, F.create_map(F.lit("from"), F.lit("a@example.org"), F.lit("to"), F.lit("b@example.net"), F.lit("proto"), F.lit("ESMTP"))),
        "native_status_field": F.lit(None).cast("string"),
    }
    return facts.withColumns(over).drop("event_id", "u", "event_type")
