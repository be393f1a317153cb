"""The log of versions: writers that meet, states, vacuum, formats, and layouts of facts."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from loghelm.operators.identity import revision
from loghelm.plans.search import SearchQuery, parse_utc, search_plan, searchable
from loghelm.schema import DAY_NS, RefusedError
from loghelm.store import snapshots as snapshots_module
from loghelm.store.facts_store import CHECKPOINTS, FACT_COLUMNS, FACTS_COLUMNS, ORIGINS, SOURCES, FactStore
from loghelm.store.log import Files
from loghelm.store.snapshots import Change, Snapshots, Version, overlap
from tests.helpers import INBOUND, facts

FROM, UNTIL = parse_utc("2026-10-01T00:00:00Z"), parse_utc("2026-10-02T00:00:00Z")


def refused(code, f, *a, **kw):
    with pytest.raises(RefusedError) as x:
        f(*a, **kw)
    assert x.value.code == code


def together(n, work):
    """work(i) in n threads that start at once; what they raised."""
    gate, failed = threading.Barrier(n), []

    def one(i):
        gate.wait()
        try:
            work(i)
        except BaseException as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def test_one_of_many_creates_a_file(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    won = []
    for k in range(20):
        assert together(4, lambda i, k=k: won.append((k, i)) if files.put_if_absent(f"log/{k}", str(i) * 1000) else None) == []
    assert sorted(k for k, _ in won) == list(range(20))
    assert all(files.read(f"log/{k}") == str(i) * 1000 for k, i in won) and len(os.listdir(tmp_path / "log")) == 20
    assert files.read("log/none") is None


def test_stores_without_creation_are_refused(spark, tmp_path, monkeypatch):
    asked = []
    own = Snapshots(spark, str(tmp_path), put=lambda path, text: asked.append(path) or True)
    assert own.put(Version(0), Change(notes={"a": 1})).number == 1 and asked == [f"{tmp_path}/log/000000000001.json"]

    class Other:
        def getScheme(self):
            return "s3a"

    class Path:
        def __init__(self, *a):
            pass

        def getFileSystem(self, conf):
            return Other()

    monkeypatch.setattr(Files, "path", lambda self, name: Path())
    refused("unsupported_store", Files, spark, "s3a://bucket/x")


def test_writers_rebase_or_work_their_change_out_again(spark, tmp_path):
    """Each of four writers counts a common number up, and adds folders of its own."""
    made = []

    def work(i):
        s = Snapshots(spark, str(tmp_path / "s"))
        for k in range(10):

            def count(at):
                made.append(i)
                return Change(notes={"n": at.notes.get("n", 0) + 1}, touch=frozenset(["number:n"]))

            s.publish(count)
            s.publish(lambda at, k=k: made.append("own") or Change({"t": [{"path": f"{i}-{k}"}]}, notes={"of": {str(i): k}}, touch=frozenset([f"writer:{i}"])))

    assert together(4, work) == []
    at = Snapshots(spark, str(tmp_path / "s")).current()
    assert at.number == 80 and at.notes["n"] == 40 and at.notes["of"] == {str(i): 9 for i in range(4)}
    assert sorted(at.paths("t")) == sorted(f"{i}-{k}" for i in range(4) for k in range(10))
    assert made.count("own") == 40  # changes that clash with nothing are made once


def test_what_clashes():
    a = Change(drop={"t": ["x", "y"]})
    assert a.clashes(Change(drop={"t": ["y"]})) and not a.clashes(Change({"t": [{"path": "x"}]})) and not a.clashes(Change(drop={"u": ["y"]}))
    assert overlap(["origin:1"], ["origin:*"]) and overlap(["origin:*"], ["origin:2"]) and overlap(["p:*"], ["p:*"])
    assert not overlap(["origin:1"], ["origin:2", "run:1", "run:*"]) and not overlap([], ["origin:*"])
    assert Change.of(a.text()) == a
    refused("unsupported_format", Change.of, json.dumps({"format": 9}))


def test_states_are_in_proportion_to_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots_module, "STATE_BYTES", 2_000)
    s = Snapshots(spark, str(tmp_path))
    sizes = []
    for k in range(300):
        s.publish(lambda at, k=k: Change({"t": [{"path": f"data/t/{k:05d}-{'x' * 30}"}]}))
        if k in (149, 299):
            sizes.append(sum(f.stat().st_size for f in (tmp_path / "log").iterdir() if not f.name.endswith(".crc")))
    assert sizes[1] < 3 * sizes[0]  # whole manifests would be four times as much
    assert any(f.name.endswith("state.json") for f in (tmp_path / "log").iterdir())
    again = Snapshots(spark, str(tmp_path))
    assert again.current().number == 300 and again.current().paths("t") == s.current().paths("t")
    for n in (0, 1, 77, 150, 299, 300):
        assert len(again.version(n).paths("t")) == n and again.version(n).number == n
    refused("expired", again.version, 301)


def test_vacuum_keeps_what_recent_versions_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots_module, "STATE_BYTES", 500)
    s = Snapshots(spark, str(tmp_path))
    for k in range(60):
        path = f"data/t/{k}"
        (tmp_path / path / "day=1").mkdir(parents=True)
        s.publish(lambda at, path=path: Change({"t": [{"path": f"{path}/day=1"}]}, {"t": at.paths("t")}))
    (tmp_path / "data/t/staged").mkdir()
    assert all(p.startswith("log/") for p in s.vacuum(keep=10))  # folders are younger than a day
    before = s.current()
    gone = s.vacuum(keep=10, older_than_s=-5)
    left = {f.name for f in (tmp_path / "data/t").iterdir()}
    assert {str(k) for k in range(49, 60)} <= left and "staged" not in left and len(left) < 40 and gone
    fresh = Snapshots(spark, str(tmp_path))
    assert fresh.current() == before and fresh.version(55).paths("t") == ["data/t/54/day=1"]
    refused("expired", fresh.version, 3)
    fresh.publish(lambda at: Change(notes={"x": 1}))
    assert s.current().number == 61


def test_four_writers_of_one_store(spark, tmp_path):
    """Origins of their own, one origin of all, and one batch that all send: none fails, none is lost."""
    root = str(tmp_path / "s")
    own = [facts(spark, INBOUND, origin=f"o{i}").persist() for i in range(4)]
    shared = facts(spark, INBOUND, origin="shared").persist()
    n = own[0].count()

    def work(i):
        store = FactStore(spark, root)
        mark = spark.createDataFrame([("src", f"o{i}", 100 + i, "a")], CHECKPOINTS)
        store.commit(own[i], checkpoints=mark)
        store.commit(shared.where(F.col("start_offset") < 200 * (i + 1)))

    assert together(4, work) == []
    store = FactStore(spark, root)
    rows = store.facts().collect()
    assert sorted((r.origin_id) for r in rows) == sorted([f"o{i}" for i in range(4) for _ in range(n)] + ["shared"] * shared.where("start_offset < 800").count())
    assert len({r.event_id for r in rows}) == len(rows)
    assert {(r.origin_id, r.offset) for r in store.checkpoints().collect()} == {(f"o{i}", 100 + i) for i in range(4)}
    named = {e["path"].split("/day=")[0] for t in store.snapshots.current().tables.values() for e in t}
    staged = {f"data/{t}/{f}" for t in os.listdir(tmp_path / "s/data") for f in os.listdir(tmp_path / f"s/data/{t}")}
    old = {e["path"].split("/day=")[0] for k in range(store.snapshots.current().number) for t in store.snapshots.version(k).tables.values() for e in t}
    assert staged <= named | old  # what was staged in vain is gone
    for df in [*own, shared]:
        df.unpersist()


def old_store(spark, root, df):
    """A store of format 1, as it was written then: whole manifests, facts in any order, and here
    from before domains and other columns for search were stored."""
    s = searchable(df).select(*[F.lit(None).cast("string").alias(c) if c.endswith("_domain") else F.col(c) for c in FACTS_COLUMNS])
    for k, part in enumerate((s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1"))):
        part.write.parquet(f"{root}/data/facts/old{k}")
    os.makedirs(f"{root}/manifests")
    for n, paths in ((1, ["data/facts/old0"]), (2, ["data/facts/old0", "data/facts/old1"])):
        with open(f"{root}/manifests/{n:012d}.json", "w") as f:
            json.dump({"format": 1, "tables": {"facts": paths}, "notes": {"last_event_id": 10_000}}, f)


def test_a_store_of_format_1_is_raised_while_it_is_read(spark, tmp_path):
    root = str(tmp_path / "s")
    df = facts(spark, INBOUND)
    old_store(spark, root, df)
    store = FactStore(spark, root)
    before = store.snapshots.current()
    assert (before.number, before.notes["format"]) == (2, 1) and store.facts(store.snapshots.version(1)).count() < store.facts().count() == 7
    digest = revision(df.select(*FACT_COLUMNS)).first().revision
    asked = SearchQuery("recipient_domain", "example.net", "mx-a", FROM, UNTIL)
    hits = [r.start_offset for r in store.search(asked).hits.collect()]
    assert len(hits) == 1  # though the domain is not stored
    refused("old_format", store.commit, df)
    reader = FactStore(spark, root)
    reader.snapshots.current()
    assert store.migrate(step_bytes=1) is True  # one of the two folders
    half = store.snapshots.current()
    assert [e["layout"] for e in half.tables["facts"]] == [1, 2] and reader.facts(before).count() == 7
    for s in (store, reader, FactStore(spark, root)):
        assert revision(s.facts()).first().revision == digest and [r.start_offset for r in s.search(asked).hits.collect()] == hits
    other = facts(spark, INBOUND, origin="later")
    FactStore(spark, root).commit(other)  # a writer between two steps
    assert store.migrate(step_bytes=1) is False and store.migrate() is False
    assert all(e["layout"] == 2 for e in store.snapshots.current().tables["facts"]) and store.facts().count() == 14
    assert len(store.search(asked).hits.collect()) == 2 and store.facts().agg(F.min("event_id"), F.max("event_id")).first()[1] == 10_007
    with open(f"{root}/manifests/{3:012d}.json") as f:
        assert json.load(f)["format"] == 2  # which writers of format 1 refuse
    again = FactStore(spark, root)
    store.commit(df)  # known already
    assert again.facts().count() == 14 and again.snapshots.current().number == store.snapshots.current().number


def test_small_folders_are_put_together(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    lines = INBOUND.strip().split("\n")
    whole = facts(spark, INBOUND).persist()
    starts = sorted(r.start_offset for r in whole.select("start_offset").collect())
    for start in starts[:4]:
        store.commit(whole.where(F.col("start_offset") == start))
    pinned = store.snapshots.current()
    digest = revision(store.facts()).first().revision
    assert len(pinned.tables["facts"]) == 4 and store.compact() and not store.compact()
    now = store.snapshots.current()
    assert len(now.tables["facts"]) == 1 and now.tables["facts"][0]["rows"] == 4 and revision(store.facts()).first().revision == digest
    assert store.facts(pinned).count() == 4 and len(lines) == len(starts)
    store.commit(whole)
    assert store.facts().count() == len(starts)
    store.snapshots.vacuum(keep=0, older_than_s=-5)
    assert store.facts().count() == len(starts)
    whole.unpersist()


def test_a_search_opens_what_can_hold_its_hits(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    days = facts(spark, "\n".join(INBOUND.strip().replace("Oct  1", f"Oct  {d}") for d in (1, 2, 9)))
    store.commit(days)
    store.commit(facts(spark, INBOUND, origin="b", instance="mx-b"))
    entries = store.snapshots.current().tables["facts"]
    assert [(e["rows"], e["instances"]) for e in entries] == [(7, ["mx-a"])] * 3 + [(7, ["mx-b"])]
    assert all(e["ns"][0] // DAY_NS == int(e["path"].split("day=")[1]) for e in entries)
    q = SearchQuery("sender", "ann@example.org", "mx-a", FROM + DAY_NS, UNTIL + DAY_NS)
    assert store.searched(q) == entries[1:2]
    plan = store.search_plan(q)
    said = plan._jdf.queryExecution().toString()
    assert "EqualTo(sender,ann@example.org)" in said and "GreaterThanOrEqual(search_ns" in said and "raw" not in said.split("ReadSchema")[1].split("\n")[0]
    assert {f.rsplit("/", 2)[1] for f in plan.inputFiles()} == {entries[1]["path"].split("/")[-1]}
    assert plan.count() == 1 == search_plan(store.facts(), q).count()
    nothing = SearchQuery("sender", "ann@example.org", "mx-a", FROM + 3 * DAY_NS, UNTIL + 3 * DAY_NS)
    assert store.searched(nothing) == [] and store.search(nothing).hits.count() == 0


def test_sources_and_ids_that_facts_bring(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    source = lambda *rows: spark.createDataFrame(rows, SOURCES)
    store.commit(sources=source(("a", "file", "mx-a"), ("b", "import", None)))
    store.commit(sources=source(("b", "import", None), ("c", "file", "mx-c")))
    assert sorted(r.source_id for r in store.sources().collect()) == ["a", "b", "c"]
    refused("immutable_source", store.commit, sources=source(("a", "file", "other")))
    refused("immutable_source", store.commit, sources=source(("b", "import", "mx-b")))
    refused("invalid_source", store.commit, sources=source(("d", "file", "x"), ("d", "import", "x")))
    df = facts(spark, INBOUND).withColumn("known", F.col("start_offset") * 3 + 1)
    store.commit(df, ids="known")
    assert store.facts().where("event_id = start_offset * 3 + 1").count() == 7
    undated = facts(spark, INBOUND, origin="u").withColumn("time_quality", F.lit("unknown"))
    store.commit(undated)
    assert [e["ns"] for e in store.snapshots.current().tables["facts"] if e["path"].endswith("day=none")] == [None]


def test_a_writer_that_is_refused_leaves_nothing(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    df = facts(spark, INBOUND)
    file = ("src", "org", "/var/log/mail.log", 1, 2, "00")
    store.commit(df, origins=spark.createDataFrame([(*file, "following")], ORIGINS))
    held = lambda: sorted(f"{t}/{f}" for t in os.listdir(tmp_path / "s/data") for f in os.listdir(tmp_path / f"s/data/{t}"))
    before = held()
    refused("collision", store.commit, df.withColumn("raw", F.lit(b"x")))
    refused("immutable_origin", store.commit, facts(spark, INBOUND, origin="new"), origins=spark.createDataFrame([("src", "org", "p", 9, 9, "00", "following")], ORIGINS))
    assert held() == before and store.snapshots.current().tables["facts"][0]["rows"] == 7
