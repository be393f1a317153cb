from pyspark.sql import functions as F

from loghelm.operators.generations import assigned, generations, unresolved
from loghelm.operators.links import hints, links
from loghelm.operators.prequeue import prequeue_reports, sessions
from loghelm.operators.recipients import recipients
from loghelm.operators.summaries import summaries
from loghelm.plans.projection import build_projection
from loghelm.schema import RefusedError
from tests.helpers import INBOUND, facts

MINUTE = 60 * 10**9


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_inbound_local_delivery(spark):
    rows = assigned(facts(spark, INBOUND))
    g = one(generations(rows))
    assert (g.n_facts, g.receipt_observed, g.cycle) == (5, True, 0) and g.removed_t
    r = one(recipients(rows))
    assert (r.address, r.observed_status, r.attempts[0].delivery.scope) == ("bob@example.net", "delivered", "local_mailbox")
    s = one(summaries(rows))
    assert s.reserves == ["coverage_unproven", "non_explicit_time"] and s.delivered == 1


def test_retries_ties_and_unknown(spark):
    text = """
Oct  1 10:00:00 mx postfix/qmgr[1]: AB12: from=<a@b>, size=1, nrcpt=2 (queue active)
Oct  1 10:00:01 mx postfix/smtp[1]: AB12: to=<x@y>, dsn=4.0.0, status=deferred (later)
Oct  1 10:00:09 mx postfix/smtp[1]: AB12: to=<x@y>, dsn=2.0.0, status=sent (250 ok)
Oct  1 10:00:09 mx postfix/smtp[1]: AB12: to=<t@y>, status=sent (250 ok)
Oct  1 10:00:09 mx postfix/smtp[1]: AB12: to=<t@y>, status=bounced (no)
Oct  1 10:00:10 mx postfix/smtp[1]: AB12: to=<>, status=odd (what)
"""
    rows = assigned(facts(spark, text))
    got = {r.address: (r.n_attempts, r.observed_status, r.order_uncertain) for r in recipients(rows).collect()}
    assert got == {"x@y": (2, "sent", False), "t@y": (2, "unknown", True), "": (1, "unknown", False)}
    assert one(summaries(rows)).reserves == ["coverage_unproven", "removal_not_observed", "non_explicit_time", "address_unspecified", "latest_order_uncertain", "unknown_result"]


def test_reused_queue_id_makes_two_generations(spark):
    cycle = """
Oct  1 {h}:00:00 mx postfix/cleanup[1]: AB12: message-id=<{h}@x>
Oct  1 {h}:00:01 mx postfix/qmgr[1]: AB12: from=<a@b>, size=1, nrcpt=1 (queue active)
Oct  1 {h}:00:02 mx postfix/smtp[1]: AB12: to=<x@y>, status=sent (ok)
Oct  1 {h}:00:03 mx postfix/qmgr[1]: AB12: removed
"""
    rows = assigned(facts(spark, cycle.format(h=10).strip() + "\n" + cycle.format(h=11).strip()))
    assert sorted((g.cycle, g.n_facts) for g in generations(rows).collect()) == [(0, 4), (1, 4)]


def test_refused_streams_keep_all_facts(spark):
    no_receipt = """
Oct  1 10:00:03 mx postfix/qmgr[1]: AB12: removed
Oct  1 10:00:04 mx postfix/smtp[1]: AB12: to=<x@y>, status=sent (ok)
"""
    u = one(unresolved(assigned(facts(spark, no_receipt))))
    assert (u.reason, u.n_facts) == ("boundary_unproven", 2)
    ids = """
Oct  1 10:00:03 mx postfix/cleanup[1]: AB12: message-id=<a@x>
Oct  1 10:00:04 mx postfix/cleanup[1]: AB12: message-id=<b@x>
"""
    assert one(unresolved(assigned(facts(spark, ids)))).reason == "conflicting_message_ids"
    from loghelm.sources.envelope import TimeContext

    assert one(unresolved(assigned(facts(spark, ids, ctx=TimeContext(2026))))).reason == "undated"


def test_order_of_rows_does_not_matter(spark):
    df = facts(spark, INBOUND)
    want = one(summaries(assigned(df))).asDict()
    for seed in (1, 2):
        assert one(summaries(assigned(df.repartition(5).orderBy(F.rand(seed))))).asDict() == want


def test_two_streams_of_one_queue_are_uncertain(spark):
    both = facts(spark, INBOUND).unionByName(facts(spark, INBOUND, source="copy"))
    got = generations(assigned(both)).collect()
    assert len(got) == 2 and all(g.cross_stream_uncertain for g in got)


def test_sessions_and_reports(spark):
    text = """
Oct  1 10:00:00 mx postfix/smtpd[5]: connect from a.example[192.0.2.1]
Oct  1 10:00:01 mx postfix/smtpd[5]: NOQUEUE: reject: RCPT from a.example[192.0.2.1]: 554 5.7.1 no; from=<s@x> to=<r@y> proto=ESMTP helo=<a>
Oct  1 10:00:02 mx postfix/smtpd[5]: disconnect from a.example[192.0.2.1] ehlo=1
Oct  1 10:00:03 mx postfix/smtpd[5]: NOQUEUE: reject_warning: MAIL from b.example[192.0.2.2]: hm; from=<s@x> to=<r@y> proto=SMTP
Oct  1 10:00:04 mx postfix/smtpd[6]: connect from c.example[192.0.2.3]
Oct  1 10:00:05 mx postfix/smtpd[6]: NOQUEUE: reject: RCPT from d.example[192.0.2.4]: no; from=<s@x> to=<r@y> proto=SMTP
Oct  1 10:00:06 mx postfix/smtpd[6]: disconnect from c.example[192.0.2.3]
"""
    df = facts(spark, text)
    assert [r.disposition for r in prequeue_reports(df).orderBy("start_offset").collect()] == ["rejected", "warning", "rejected"]
    assert [r.reason for r in sessions(df).orderBy("start_offset").collect()] == [None, "boundary_unproven", "client_mismatch"]


FORWARD = """
Oct  1 10:00:00 mx postfix/cleanup[1]: AB12: message-id=<m@x>
Oct  1 10:00:01 mx postfix/qmgr[1]: AB12: from=<s@x>, size=1, nrcpt=1 (queue active)
Oct  1 10:00:02 mx postfix/{service}[1]: AB12: to=<r@y>, relay=127.0.0.1[127.0.0.1]:10024, status=sent ({reply})
Oct  1 10:00:03 mx postfix/cleanup[1]: CD34: message-id=<m@x>
Oct  1 10:00:04 mx postfix/qmgr[1]: CD34: from=<{sender}>, size=1, nrcpt=1 (queue active)
Oct  1 10:00:05 mx postfix/smtp[1]: CD34: to=<r@y>, relay=p[192.0.2.9]:25, status=sent (250 fine)
"""


def link(spark, bindings=(), window=MINUTE, **kw):
    df = facts(spark, FORWARD.format(**{"service": "smtp", "reply": "250 2.0.0 Ok: queued as CD34", "sender": "s@x"} | kw))
    assert hints(df).count() == 1
    return one(links(df, window, bindings))


def test_links(spark):
    bound = [("mx-a", "127.0.0.1[127.0.0.1]:10024", "mx-a")]
    good = link(spark, bound)
    assert (good.state, good.reason, good.target_generation.queue_id) == ("corroborated", None, "CD34") and len(good.evidence) >= 4
    assert link(spark).reason == "target_instance_unknown"
    assert link(spark, bound, sender="other@x").reason == "evidence_insufficient"
    assert link(spark, bound, reply="250 2.0.0 Ok: queued as EF56").reason == "target_absent"
    assert link(spark, bound, reply="250 2.0.0 Ok: queued as AB12").reason == "self_reference"
    assert link(spark, service="local", reply="forwarded as CD34").state == "corroborated"


def test_hostile_reply_makes_no_hint(spark):
    df = facts(spark, FORWARD.format(service="smtp", reply="250 2.0.0 Ok: queued as CD34, status=sent", sender="s@x"))
    assert hints(df).count() == 0


def test_projection_is_whole_or_refused(spark):
    df = facts(spark, INBOUND)
    p = build_projection(df)
    assert p.revision == build_projection(df.repartition(3)).revision
    changed = df.withColumn("message", F.concat("message", F.lit("x")))
    assert build_projection(changed).revision != p.revision
    assert p.sessions.count() == 0 and p.other.count() == 2 and p.links.count() == 0
    for bad, code in ((df.unionByName(df), "invalid_facts"), (df, "too_many_facts")):
        try:
            build_projection(bad, limit=3 if code == "too_many_facts" else 100)
        except RefusedError as x:
            assert x.code == code
        else:
            raise AssertionError(code)
