"""Queries of the engine over the driver's tables; their SQL twins are in loghelm.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.functions.facts import usable_time
from loghelm.functions.scalars import address_domain, fits_nanoseconds, framed, import_origin_id, is_field_key, is_queue_id, wire_value
from loghelm.operators.continuity import chains, check_claims, extremities
from loghelm.operators.generations import assigned, generations
from loghelm.operators.identity import queue_instances as with_ordinals
from loghelm.operators.links import hints, links
from loghelm.operators.partition import other, provenance_faults, streams
from loghelm.operators.prequeue import prequeue_reports as reports_of
from loghelm.operators.prequeue import sessions
from loghelm.operators.recipients import recipients
from loghelm.operators.summaries import STATUSES, summaries
from loghelm.oracle import ORACLE
from loghelm.plans.cursors import SearchCursor
from loghelm.plans.detail import candidates, positioned, timeline
from loghelm.plans.projection import build_projection
from loghelm.plans.scope import facts_in_scope
from loghelm.plans.search import SearchQuery
from loghelm.schema import DAY_NS, GENERATION, STREAM, field
from loghelm.sources.envelope import TimeContext
from loghelm.sources.mail_lines import parse_lines
from loghelm.store.imports import gaps, runs_with_marks, with_marks
from loghelm.store.replay import outcomes, purge_digest
from loghelm.store.retention import covered, purgeable
from loghelm.store.workspace import new_folder
from loghelm import stored
from loghelm.stored import event_store
from loghelm.views import event_columns, event_facts, event_sessions

JANUARY = (1704067200 * 10**9, 1706745600 * 10**9)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return event_facts(_t(spark, sf_dir, "events"), **kw)


def facts_partition(spark, sf_dir):
    return streams(_facts(spark, sf_dir))


def generation_split(spark, sf_dir):
    g = generations(assigned(_facts(spark, sf_dir)))
    return g.select(*GENERATION, "first_t", F.coalesce("removed_t", F.lit(-1)).alias("removed_t"), "receipt_observed", "non_explicit_time", "cross_stream_uncertain", "n_facts", "first_start")


def generation_reasons(spark, sf_dir):
    per = assigned(_facts(spark, sf_dir)).groupBy(*STREAM, "reason").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("reason").agg(F.count(F.lit(1)).alias("n_streams"), F.sum("n").alias("n_facts"))


def queue_instances(spark, sf_dir):
    return with_ordinals(generations(assigned(_facts(spark, sf_dir)))).select(*GENERATION, "generation")


def _recipients(facts):
    return recipients(assigned(facts)).drop("attempts", "latest")


def recipient_latest(spark, sf_dir):
    return _recipients(_facts(spark, sf_dir))


def recipient_ties(spark, sf_dir):
    return _recipients(_facts(spark, sf_dir, hour_ties=True))


def summary_counts(spark, sf_dir):
    s = summaries(assigned(_facts(spark, sf_dir)))
    return s.agg(F.count(F.lit(1)).alias("n_generations"), F.sum("n_recipients").alias("recipients"), *[F.sum(c).alias(c) for c in STATUSES])


def summary_reserves(spark, sf_dir):
    s = summaries(assigned(_facts(spark, sf_dir, hour_ties=True)))
    return s.select(*GENERATION, "n_recipients", *STATUSES, F.concat_ws(",", "reserves").alias("reserves"))


def queue_hints(spark, sf_dir):
    return hints(_facts(spark, sf_dir)).select("start_offset", "instance", "queue_id", "hint_kind", "target_queue_id", "relay")


def queue_links(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    bindings = [(f"mx-{i}", "peer[192.0.2.1]:25", f"mx-{i}") for i in range(3)]
    out = links(facts, DAY_NS, bindings)
    return out.select("start_offset", "instance", "queue_id", "target_queue_id", F.coalesce("reason", "state").alias("result"), F.col("target_generation.cycle").alias("target_cycle"), F.col("non_explicit_time"))


def prequeue_reports(spark, sf_dir):
    return reports_of(event_sessions(_t(spark, sf_dir, "events"))).select("start_offset", "pid", "disposition", "client", "sender", "recipient")


def prequeue_sessions(spark, sf_dir):
    s = sessions(event_sessions(_t(spark, sf_dir, "events")))
    return s.select("start_offset", "pid", "client", F.coalesce("reason", F.lit("assigned")).alias("result"))


def _search(spark, sf_dir, name, value, limit, cursor=None):
    return SearchQuery(name, value, "mx-1", *JANUARY, limit, cursor)


def _page(spark, sf_dir, q):
    plan = event_store(spark, sf_dir).search_plan(q, with_limit=False)
    return plan.limit(q.limit).select("event_id", "time_utc_ns", "start_offset", "queue_id")


def search_exact(spark, sf_dir):
    return _page(spark, sf_dir, _search(spark, sf_dir, "recipient", "r3@example.net", 100))


def search_domain(spark, sf_dir):
    return _page(spark, sf_dir, _search(spark, sf_dir, "recipient_domain", "example.net", 200))


def search_page_2(spark, sf_dir):
    q = _search(spark, sf_dir, "recipient", "r3@example.net", 20)
    last = _page(spark, sf_dir, q).orderBy(F.desc("time_utc_ns"), F.desc("event_id")).first()  # the end of page 1
    return _page(spark, sf_dir, _search(spark, sf_dir, q.field, q.value, 20, SearchCursor(q.digest(), last["time_utc_ns"], last["event_id"])))


def search_all_fields(spark, sf_dir):
    store = event_store(spark, sf_dir)
    asked = (("sender", "u1@example.org"), ("recipient", ""), ("queue_id", "A000102"), ("message_id", "m1-0@example.org"), ("sender_domain", "example.org"), ("recipient_domain", "example.net"))
    parts = [store.search_plan(_search(spark, sf_dir, n, v, 1), with_limit=False).agg(F.lit(n).alias("field"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids")) for n, v in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_more(spark, sf_dir):
    """A page and the row after it, which tells that there is more."""
    q = _search(spark, sf_dir, "recipient", "r3@example.net", 20)
    return event_store(spark, sf_dir).search_plan(q).select("event_id", "time_utc_ns")


def origin_overlap(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    longer = facts.withColumn("end_offset", F.col("end_offset") + F.when(F.col("event_id") % 89 == 0, 50000).otherwise(0))
    return provenance_faults(longer).select("start_offset", "fault")


def origin_extremities(spark, sf_dir):
    return extremities(_facts(spark, sf_dir)).select("source_id", "origin_id", "first_start", "last_end")


def continuity_chain(spark, sf_dir):
    """Each day of a source as an origin that goes on with the next day, but for days 10 and 20."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source_id", "day").orderBy("event_id"))
    days = event_columns(_t(spark, sf_dir, "events")).select("event_id", "day")
    daily = _facts(spark, sf_dir).join(days, "event_id").withColumns({"origin_id": F.format_string("d%02d", "day"), "end_offset": (n * 128).cast("long")})
    daily = daily.withColumn("start_offset", F.col("end_offset") - 128)
    ends = sorted((r["source_id"], r["origin_id"], r["last_end"]) for r in extremities(daily).collect())  # a row per source and day
    claims = [(a[0], a[1], a[2], b[1], 0) for a, b in zip(ends, ends[1:]) if a[0] == b[0] and a[1] not in ("d10", "d20")]
    rows = [(source, chain[0][1], i, origin) for chain in chains(check_claims(daily, claims)) for i, (source, origin) in enumerate(chain)]
    return spark.createDataFrame(rows, "source_id string, head string, place int, origin_id string")


def asof_last_boundary(spark, sf_dir):
    return sessions(event_sessions(_t(spark, sf_dir, "events"))).select("start_offset", "pid", "open_start")


def expirations(spark, sf_dir):
    facts, gone = _facts(spark, sf_dir), (F.col("service") == "qmgr") & (F.col("kind") == "message") & (F.col("event_id") % 11 == 0)
    status = F.map_concat("fields", F.create_map(F.lit("status"), F.lit("expired")))
    facts = facts.withColumns({"fields": F.when(gone, status).otherwise(F.col("fields")), "native_status_field": F.when(gone, F.lit("expired")).otherwise(F.col("native_status_field"))})
    return summaries(assigned(facts)).select(*GENERATION, "expiration_reports")


def other_facts(spark, sf_dir):
    return other(_facts(spark, sf_dir).withColumn("no_queue", F.col("event_id") % 13 == 0)).select("source_id", "origin_id", "start_offset")


def _kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read from there."""
    path = f"{new_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def candidate_timeline(spark, sf_dir):
    """The first facts of every generation of two queues, each asked for by its candidate id."""
    facts, out = _facts(spark, sf_dir), None
    for queue in (("mx-1", "A000102"), ("mx-1", "A003105")):
        own = _kept(facts_in_scope(facts, [queue], [], None))  # each question reads its queue several times, and the events once
        for c in candidates(build_projection(own, limit=None)):  # few generations of one queue
            page, _ = timeline(own, c, limit=3)
            page = page.select("start_offset", "position", "kind", "service")
            out = page if out is None else out.unionByName(page)
    return out if out is not None else spark.createDataFrame([], "start_offset string, position int, kind string, service string")


def scope_semi_join(spark, sf_dir):
    parts = [("mx-1", "A000102"), ("mx-1", "A000110"), ("mx-1", "A003105"), ("mx-2", "A000203")]
    return facts_in_scope(_facts(spark, sf_dir), parts, [], None).select("start_offset", "instance", "queue_id")


def _retention(spark, sf_dir):
    """Facts, checkpoints, origins and imports as the store would hold them: src-0 was retired,
    src-1 is followed still, src-2 was imported, and one import of it runs."""
    facts = _facts(spark, sf_dir).withColumn("search_ns", usable_time())
    by = facts.groupBy("source_id", "origin_id").agg(F.floor(F.max("end_offset") * 3 / 4).alias("offset"))
    file = F.col("source_id") != "src-2"
    marks = by.withColumn("anchor", F.when((F.col("source_id") == "src-1") & (F.col("origin_id") == "org-1"), F.lit("")).otherwise(F.lit("a")))
    origins = by.where(file).select("source_id", "origin_id", F.when(F.col("source_id") == "src-0", F.lit("retired")).otherwise(F.lit("following")).alias("state"))
    size = F.col("offset").alias("content_bytes")
    runs = by.where(~file).select("source_id", "origin_id", F.lit("complete").alias("status"), F.col("offset").alias("end_offset"), size)
    late = by.where(~file & (F.col("origin_id") == "org-1")).select("source_id", "origin_id", F.lit("running").alias("status"), F.lit(0).cast("long").alias("end_offset"), size)
    return facts, marks, origins, runs.unionByName(late)


BEFORE = 1705276800 * 10**9


def retention_preview(spark, sf_dir):
    facts, marks, _, _ = _retention(spark, sf_dir)
    parts = [covered(facts, marks, f"mx-{i}", BEFORE) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("start_offset", "instance")


def retention_purge(spark, sf_dir):
    parts = [purgeable(*_retention(spark, sf_dir), f"mx-{i}", BEFORE) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("start_offset", "instance")


def replay_guard(spark, sf_dir):
    facts = _facts(spark, sf_dir).withColumn("raw", F.concat("queue_id", "kind").cast("binary"))
    n = F.col("event_id")
    stored = facts.where(n % 10 == 5).withColumn("raw", F.when(n % 70 == 5, F.lit("other").cast("binary")).otherwise(F.col("raw")))
    purged = facts.where(n % 10 == 3).withColumn("digest", F.when(n % 70 == 3, F.lit("other")).otherwise(purge_digest()))
    return outcomes(facts, stored, purged).select("start_offset", "outcome")


def revision_digest(spark, sf_dir):
    return _facts(spark, sf_dir).select("start_offset", F.sha2(framed(*[F.col(c) for c in ("source_id", "origin_id", "start_offset", "end_offset", "queue_id")]), 256).alias("digest"))


def event_lines(events: DataFrame) -> DataFrame:
    """events as lines of text: wall time, host, service, pid, queue id, message."""
    f = event_facts(events, also=("us",))
    message = (
        F.when(F.col("kind") == "removed", F.lit("removed"))
        .when(F.col("service") == "cleanup", F.concat(F.lit("message-id=<"), field("message-id"), F.lit(">")))
        .when(F.col("service") == "qmgr", F.concat(F.lit("from=<"), field("from"), F.lit(">, size=100, nrcpt=1 (queue active)")))
        .otherwise(F.concat(F.lit("to=<"), field("to"), F.lit(">, relay="), field("relay"), F.lit(", dsn=2.0.0, status="), F.col("native_status_field")))
    )
    m = f.select("event_id", "host", "service", "pid", "queue_id", message.alias("m"), "us")
    wall = F.timestamp_micros(F.col("us"))
    stamp = F.concat(F.date_format(wall, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(wall).cast("string"), 2, " "), F.date_format(wall, " HH:mm:ss"))
    line = F.concat(stamp, F.lit(" "), F.col("host"), F.lit(" postfix/"), F.col("service"), F.lit("["), F.col("pid"), F.lit("]: "), F.col("queue_id"), F.lit(": "), F.col("m"))
    return m.select("event_id", F.when(F.col("event_id") % 101 == 0, F.lit("no envelope here")).otherwise(line).alias("line"), line.alias("whole"))


def syslog_roundtrip(spark, sf_dir):
    lines = event_lines(_t(spark, sf_dir, "events")).select("event_id", F.col("line").cast("binary").alias("raw"))
    return parse_lines(lines, TimeContext(2024, "UTC")).select("event_id", "time_utc_ns", "host", "service", "pid", "parse_error")


def postfix_fields(spark, sf_dir):
    lines = event_lines(_t(spark, sf_dir, "events")).select("event_id", F.col("whole").cast("binary").alias("raw"))
    p = parse_lines(lines, TimeContext(2024, "UTC"))
    return p.select("event_id", "kind", "queue_id", field("message-id").alias("message_id"), field("from").alias("sender"), field("to").alias("recipient"), field("status").alias("status"))


def _parsed(spark, sf_dir, line, ctx=TimeContext(2024, "UTC")):
    """Events as lines, parsed; `line` is built from the columns of event_columns."""
    lines = event_columns(_t(spark, sf_dir, "events")).select("event_id", line.cast("binary").alias("raw"))
    return parse_lines(lines, ctx)


def _cases(*texts):
    """One of the texts by event_id, with every {n} replaced by event_id."""
    n, out = F.col("event_id"), F.lit(None).cast("string")
    for i, text in enumerate(texts):
        out = F.when(n % len(texts) == i, F.replace(F.lit(text), F.lit("{n}"), n.cast("string"))).otherwise(out)
    return out


def rfc5424_lines(spark, sf_dir):
    n = F.col("event_id")
    wall = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad((F.col("us") % 1000000).cast("string"), 6, "0")))
    zone = F.when(n % 3 == 0, F.lit("Z")).when(n % 3 == 1, F.lit("+02:00")).otherwise(F.lit("-05:30"))
    data = F.when(n % 31 == 0, F.lit("[broken")).when(n % 5 == 0, F.lit('[x@1 a="b\\]c"][y z=""]')).otherwise(F.lit("-"))
    line = F.concat(F.lit("<"), (n % 200).cast("string"), F.lit(">1 "), wall, part, zone, F.lit(" mx-1 postfix/smtp 77 - "), data, F.lit(" hello "), n.cast("string"))
    return _parsed(spark, sf_dir, line).select("event_id", "time_utc_ns", "time_quality", "time_zone", "message", "parse_error")


def nearest_year(spark, sf_dir):
    lines = event_lines(_t(spark, sf_dir, "events")).select("event_id", F.col("whole").cast("binary").alias("raw"))
    return parse_lines(lines, TimeContext(0, "UTC", 1720569600 * 10**9)).select("event_id", "time_utc_ns", "time_quality", "time_year")


def dst_gap(spark, sf_dir):
    """Wall times of the two days of 2024 on which Berlin changes its clocks."""
    n = F.col("event_id")
    line = F.concat(F.when(n % 2 == 0, F.lit("Mar 31 ")).otherwise(F.lit("Oct 27 ")), F.format_string("%02d:%02d:%02d", n % 24, n % 59, n % 53), F.lit(" mx-1 postfix/smtp[7]: hello"))
    return _parsed(spark, sf_dir, line, TimeContext(2024, "Europe/Berlin")).select("event_id", "time_utc_ns", "time_quality")


def comma_fields(spark, sf_dir):
    line = F.concat(F.lit("Jan 12 03:04:05 mx-1 postfix/smtp[7]: A1B2C3: "), _cases(
        'to=<"a,b"@example.net>, relay=peer[192.0.2.1,x]:25, conn_use=(2, 3), delay={n}, status=deferred (host said: 450 (try, later))',
        "to=<first@example.net>, to=<second@example.net>, delay={n}, status=sent (250 ok), relay=late",
        "delay={n}, 1x=5, to=<open, status=sent",
        '"quoted, \\" still, relay=1", delay={n}',
    ))
    p = _parsed(spark, sf_dir, line)
    return p.select("event_id", "kind", *[field(x).alias(x) for x in ("to", "relay", "conn_use", "delay", "status", "reply")])


def space_fields(spark, sf_dir):
    line = F.concat(F.lit("Jan 12 03:04:05 mx-1 postfix/pickup[7]: A1B2C3: "), _cases('uid={n} from=<a b;c@example.org>;y="q r" z=', 'uid={n}, uid=9 1x=2 y="open', "y=<open uid={n}"))
    return _parsed(spark, sf_dir, line).select("event_id", "kind", *[field(x).alias(x) for x in ("uid", "from", "y", "z")])


def reject_metadata(spark, sf_dir):
    head = "NOQUEUE: reject: RCPT from h[192.0.2.1]: 554 5.7.1 <b>: no"
    line = F.concat(F.lit("Jan 12 03:04:05 mx-1 postfix/smtpd[7]: "), _cases(
        head + "; from=<u{n}@example.org> to=<b@example.net> proto=ESMTP helo=<h {n}>",
        head + "; from=<> to=<b{n}@example.net> proto=SMTP",
        head + "; from=<a@example.org> to=<b@example.net> proto=ESMTP helo=h{n}",
        head + "; from=<a@example.org> said; from=<a@example.org> to=<b@example.net> proto=ESMTP",
        head + "; from=<a@example.org> to=<b@example.net> proto=ESMTP helo=h{n}; more",
    ))
    return _parsed(spark, sf_dir, line).select("event_id", "kind", "no_queue", *[field(x).alias(x) for x in ("from", "to", "proto", "helo")])


def timeline_page(spark, sf_dir):
    rows = positioned(assigned(_facts(spark, sf_dir)).where("reason = 'resolved'"))
    return rows.where(F.col("position").between(2, 4)).select("start_offset", "position")


def address_domains(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("word")).where(F.contains("word", F.lit("@")))
    return words.select("doc_id", "word", address_domain(F.col("word")).alias("domain"))


def queue_id_grammar(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("word"))
    return words.where(is_queue_id(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def field_key_grammar(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("word"))
    return words.where(is_field_key(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ns_range(spark, sf_dir):
    n = F.col("event_id")
    near = F.when(n % 2 == 0, F.lit("9223372036.85477580")).otherwise(F.lit("-9223372036.85477580"))
    seconds = F.when(n % 10 < 8, F.concat((n * 1000003 % 20000000000 - 10000000000).cast("string"), F.lit(".5"))).otherwise(F.concat(near, (n % 9 + 1).cast("string")))
    return _t(spark, sf_dir, "events").select("event_id", fits_nanoseconds(seconds).alias("fits"))


def left_join_checkpoints(spark, sf_dir):
    _, marks, origins, _ = _retention(spark, sf_dir)
    return with_marks(origins, marks.where("origin_id = 'org-0'")).select("source_id", "origin_id", "state", "offset")


def import_runs(spark, sf_dir):
    _, marks, _, runs = _retention(spark, sf_dir)
    return runs_with_marks(runs, marks).select("source_id", "origin_id", "status", "end_offset", "offset", "fault")


def contiguity_check(spark, sf_dir):
    return gaps(_facts(spark, sf_dir)).select("source_id", "origin_id", "start_offset", "expected")


def import_origin_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", import_origin_id(F.col("source"), F.sha2("text", 256)).alias("origin_id"))


def utf8_wire(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", wire_value(F.col("text")).alias("w"))
    return d.select("doc_id", "w.encoding", "w.value")


def conversation_pages(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("n")).where(F.col("n").between(2, 3)).drop("n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE} | stored.queries()


def oracle_sql() -> dict[str, str]:
    return ORACLE | stored.oracle_sql()
