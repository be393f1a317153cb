"""Predicates and projections of one fact, as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghelm.functions.scalars import is_queue_id, literal_client
from loghelm.schema import DELIVERY_SCOPES, MAILBOX_SCOPES, ORDERING_QUALITIES, QUEUED_KINDS, field

BOUNCE_NOTE = "sender non-delivery notification: "
QUEUED_AS = "250 2.0.0 Ok: queued as "
FORWARDED_AS = "forwarded as "


def _choose(mapping: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


@cache
def _clean() -> Column:
    return ~F.col("no_queue") & (F.col("queue_id") != "") & (F.col("parse_error") == "")


@cache
def is_queued() -> Column:
    return _clean() & F.col("kind").isin(*QUEUED_KINDS)


@cache
def usable_time() -> Column:
    """Instant in nanoseconds where its quality may order events, else NULL."""
    return F.when(F.col("time_quality").isin(*ORDERING_QUALITIES), F.col("time_utc_ns"))


@cache
def is_receipt() -> Column:
    s = F.col("service")
    has = lambda n: field(n).isNotNull()
    return (F.col("kind") == "message") & (
        ((s == "cleanup") & has("message-id")) | ((s == "smtpd") & has("client")) | ((s == "pickup") & has("uid")) | ((s == "qmgr") & has("from") & has("size") & has("nrcpt") & ~has("status"))
    )


@cache
def is_removal() -> Column:
    return F.col("kind") == "removed"


def native_status_is(status: Column) -> Column:
    """The first status field, before any reply, is exactly this."""
    f = F.col("native_status_field")
    at = F.instr(f, " (")
    return F.coalesce(F.when(at > 0, F.substring(f, F.lit(1), at - 1)).otherwise(f) == status, F.lit(False))


def native_reply_is(status: Column, reply: Column) -> Column:
    return F.coalesce(F.col("native_status_field") == F.concat(status, F.lit(" ("), reply, F.lit(")")), F.lit(False))


@cache
def projects_delivery() -> Column:
    """Whether the fact is a delivery report that projects."""
    return _clean() & (F.col("kind") == "delivery") & F.col("service").isin(*DELIVERY_SCOPES) & field("to").isNotNull() & field("status").isNotNull()


@cache
def delivery() -> Column:
    """struct of one delivery report; meaningful where projects_delivery() holds."""
    native, reply, service = field("status"), field("reply"), F.col("service")
    mailbox = (native == "sent") & F.coalesce(reply.isin("delivered to maildir", "delivered to mailbox"), F.lit(False)) & native_reply_is(native, reply) & service.isin(*MAILBOX_SCOPES)
    status = F.when(~native_status_is(native), F.lit("unknown")).when(mailbox, F.lit("delivered")).when(native.isin("sent", "deferred", "bounced"), native).otherwise(F.lit("unknown"))
    scope = F.when(native_status_is(native) & mailbox, _choose(MAILBOX_SCOPES, service)).otherwise(_choose(DELIVERY_SCOPES, service))
    return F.struct(
        field("to").alias("recipient"),
        field("orig_to").alias("original_recipient"),
        native.alias("native_status"),
        status.alias("status"),
        scope.alias("scope"),
        field("relay").alias("relay"),
        field("dsn").alias("dsn"),
        reply.alias("reply"),
    )


@cache
def is_expiration() -> Column:
    return _clean() & (F.col("kind") == "message") & (F.col("service") == "qmgr") & F.coalesce(field("status") == "expired", F.lit(False)) & native_status_is(F.lit("expired"))


@cache
def prequeue_action() -> Column:
    """'reject' or 'reject_warning' for a report before any queue, else NULL."""
    m = F.col("message")
    ok = (F.col("kind") == "reject") & (F.col("service") == "smtpd") & F.col("no_queue") & (F.col("queue_id") == "") & (F.col("parse_error") == "")
    return F.when(ok & m.startswith("reject:"), F.lit("reject")).when(ok & m.startswith("reject_warning:"), F.lit("reject_warning"))


@cache
def boundary_client() -> Column:
    """The client named by a connect or disconnect line, '' where none is."""
    m = F.col("message")
    free = ~F.col("no_queue") & (F.col("queue_id") == "") & (F.col("parse_error") == "")
    opened = F.when(m.startswith("connect from "), F.substring(m, F.lit(14), F.length(m)))
    closed = F.when(m.startswith("disconnect from "), F.substring_index(F.substring(m, F.lit(17), F.length(m)), " ", 1))
    named = F.when(F.col("kind") == "connect", opened).when(F.col("kind") == "disconnect", closed)
    return F.when(free & named.isNotNull(), literal_client(named)).otherwise(F.lit(""))


def report_client(action: Column) -> Column:
    """The client named by a report after one of the protocol's verbs, '' where none is."""
    text = F.btrim(F.substring(F.col("message"), F.length(action) + 2, F.length("message")), F.lit(" \t\r\n\x0b\x0c"))
    named = F.regexp_extract(text, r"\A(?:CONNECT|HELO|EHLO|MAIL|RCPT|DATA|END-OF-MESSAGE) from ([\s\S]+?): ", 1)
    return literal_client(named)


@cache
def queue_hint() -> Column:
    """struct<kind, target_queue_id, target_instance, relay, native_proof>, NULL where none."""
    m, note = F.col("message"), field("notification_queue_id")
    bounce = is_queued() & (F.col("kind") == "bounce") & (F.col("service") == "bounce") & F.coalesce(is_queue_id(note) & (m == F.concat(F.lit(BOUNCE_NOTE), note)), F.lit(False))
    reply = field("reply")
    # an exact reply after `sent` implies the native status, and excludes mailbox reports below
    sent = projects_delivery() & F.coalesce((field("status") == "sent") & native_reply_is(F.lit("sent"), reply), F.lit(False))

    def after(prefix: str) -> Column:
        return F.when(reply.startswith(prefix), F.substring(reply, F.lit(len(prefix) + 1), F.length(reply)))

    local, smtp = F.col("service") == "local", F.col("service") == "smtp"
    target = F.when(bounce, note).when(sent & local, after(FORWARDED_AS)).when(sent & smtp, after(QUEUED_AS))
    kind = F.when(bounce, F.lit("bounce_notification_hint")).when(local, F.lit("local_forward_hint")).otherwise(F.lit("smtp_queue_hint"))
    return F.when(
        F.coalesce(is_queue_id(target), F.lit(False)),
        F.struct(
            kind.alias("kind"),
            target.alias("target_queue_id"),
            F.when(bounce | local, F.col("instance")).alias("target_instance"),
            F.when(~bounce, field("relay")).alias("relay"),
            F.when(bounce, m).otherwise(reply).alias("native_proof"),
        ),
    )
