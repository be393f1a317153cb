import pytest

from loghelm.operators.continuity import chains, check_claims
from loghelm.plans.cursors import CandidateId, SearchCursor, timeline_cursor, timeline_position
from loghelm.plans.detail import Admission, candidates, detail, search_matches, timeline, to_json
from loghelm.plans.projection import build_projection
from loghelm.plans.scope import facts_in_scope
from loghelm.plans.search import SearchQuery, parse_request, parse_utc, search, search_plan, searchable
from loghelm.schema import RefusedError
from tests.helpers import INBOUND, facts

FROM, UNTIL = parse_utc("2026-10-01T00:00:00Z"), parse_utc("2026-10-02T00:00:00Z")


def refused(code, f, *a, **kw):
    with pytest.raises(RefusedError) as x:
        f(*a, **kw)
    assert x.value.code == code


def test_pages_follow_each_other(spark, tmp_path):
    stored = searchable(facts(spark, INBOUND))
    stored.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    q = SearchQuery("queue_id", "4F1A2B3C4D", "mx-a", FROM, UNTIL, 2)
    seen, cursor = [], None
    while True:
        page = search(stored, SearchQuery(q.field, q.value, q.instance, FROM, UNTIL, 2, cursor))
        seen += [r.event_id for r in page.hits.collect()]
        if not page.more:
            break
        cursor = SearchCursor.decode(page.cursor)
    assert len(seen) == len(set(seen)) == 5
    plan = search_plan(stored, SearchQuery("sender", "ann@example.org", "mx-a", FROM, UNTIL))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(sender,ann@example.org)" in plan and "GreaterThanOrEqual(search_ns" in plan
    assert "raw" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_candidates_detail_and_timeline(spark):
    df = facts(spark, INBOUND)
    stored = searchable(df)
    m = search_matches(stored, SearchQuery("recipient_domain", "example.net", "mx-a", FROM, UNTIL))
    assert [r.match for r in m.matches.collect()] == ["candidate"]
    (cid,) = candidates(build_projection(facts_in_scope(df, [("mx-a", "4F1A2B3C4D")])))
    summary, rcpt = detail(df, cid)
    assert summary.first().delivered == 1 and rcpt.count() == 1
    page, cursor = timeline(df, cid, limit=3)
    rest, end = timeline(df, cid, limit=3, cursor=cursor, raw=False)
    assert page.count() == 3 and rest.count() == 2 and end is None
    assert '"delivered":1' in to_json(summary.select("delivered"))
    refused("response_too_large", to_json, summary, 5)
    c = CandidateId.decode(cid)
    refused("stale", detail, df, CandidateId("0" * 64, c.generation, c.instance, c.queue_id).encode())
    refused("absent", detail, df, CandidateId(c.revision, 0, "mx-a", "ZZ99").encode())


def test_codecs_are_exact():
    c = SearchCursor(b"q" * 32, -5, 7)
    assert len(c.encode()) == 66 and SearchCursor.decode(c.encode()) == c
    refused("invalid_cursor", SearchCursor.decode, c.encode()[:-1] + "!")
    i = CandidateId("ab" * 32, 3, "mx-é", "AB12")
    assert CandidateId.decode(i.encode()) == i
    t = timeline_cursor(i.encode(), True, 9)
    assert timeline_position(t, i.encode(), True) == 9
    refused("invalid_cursor", timeline_position, t, i.encode(), False)


@pytest.mark.parametrize("raw", ["", "field=sender", "field=sender&value=a&instance=m&field=x", "field=nope&value=a&instance=m", "field=sender&value=a&instance=m&limit=0", "field=sender&value=a&instance=m&limit=01", "field=sender&value=a&instance=m&from=2026-10-01T00:00:00Z", "field=sender&value=a&instance=m&from=2026-10-01T00:00:00Z&until=2026-12-01T00:00:00Z", "field=sender&value=a&instance=m&from=2026-10-01T00:00:00%2B02:00&until=2026-10-02T00:00:00Z"])
def test_bad_requests(raw):
    refused("invalid_query", parse_request, raw, UNTIL)


def test_good_request():
    q = parse_request("field=sender&value=&instance=mx-a&limit=7", UNTIL)
    assert (q.value, q.limit, q.from_ns, q.until_ns) == ("", 7, FROM, UNTIL)


def test_admission_refuses_at_once():
    a = Admission(1)
    with a.enter():
        refused("busy", a.enter().__enter__)


def test_continuity(spark):
    a, b = facts(spark, INBOUND, origin="a"), facts(spark, INBOUND, origin="b")
    both = a.unionByName(b)
    end = max(r.end_offset for r in a.collect())
    claims = check_claims(both, [("src", "a", end, "b", 0)])
    assert chains(claims) == [[("src", "a"), ("src", "b")]]
    refused("boundary_unproven", check_claims, both, [("src", "a", end - 1, "b", 0)])
    refused("cyclic_succession", check_claims, both, [("src", "a", end, "b", 0), ("src", "b", end, "a", 0)])
