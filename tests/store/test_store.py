import gzip
import os

import pytest
from pyspark.sql import functions as F

from loghelm.plans.search import parse_utc
from loghelm.schema import RefusedError
from loghelm.sources.envelope import TimeContext
from loghelm.sources.finite import Caps, imported, inspect
from loghelm.sources.follow import WINDOW, Follower, anchor, open_origin, records, register, select_origin, verify
from loghelm.sources.mail_lines import parse_lines
from loghelm.operators.identity import revision
from loghelm.store.facts_store import CHECKPOINTS, ORIGINS, FactStore
from loghelm.store.imports import ImportAttempt
from loghelm.store.snapshots import Change
from loghelm.streaming.ingest import ingest, read_log
from tests.helpers import CTX, INBOUND, facts


def refused(code, f, *a, **kw):
    with pytest.raises(RefusedError) as x:
        f(*a, **kw)
    assert x.value.code == code


def test_commit_twice_collide_and_purge(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    df = facts(spark, INBOUND)
    store.commit(df)
    n = store.facts().count()
    store.commit(df)
    assert store.facts().count() == n == 7
    other = df.withColumn("raw", F.concat("raw", F.lit("x").cast("binary")))
    refused("collision", store.commit, other)
    p = store.install_projection("p", [("mx-a", "4F1A2B3C4D")], [], 60 * 10**9)
    assert store.current_projection("p").revision == p.revision
    refused("absent", store.current_projection, "q")
    end = df.agg(F.max("end_offset")).first()[0]
    store.commit(df, checkpoints=spark.createDataFrame([("src", "org", end, "a")], CHECKPOINTS))
    assert store.checkpoint("src", "org") == (end, "a") and store.checkpoint("src", "none") is None
    later = parse_utc("2026-10-01T10:00:03Z")
    preview, more = store.preview_retention("mx-a", later, 2)
    assert preview.count() == 2 and more
    file = ("src", "org", "/var/log/mail.log", 1, 2, "00")
    store.commit(df, origins=spark.createDataFrame([(*file, "following")], ORIGINS))
    assert store.purge_retention("mx-a", later).purged == 0  # the file is followed still
    store.commit(df, origins=spark.createDataFrame([(*file, "retired")], ORIGINS))
    assert store.purge_retention("mx-b", later).purged == 0
    refused("invalid_instance", store.purge_retention, "", later)
    before = store.snapshots.current().paths("facts")
    other_file = facts(spark, INBOUND, origin="other", instance="mx-c")
    store.commit(other_file)
    got = store.purge_retention("mx-a", later)
    assert set(store.snapshots.current().paths("facts")) & set(before) == set()
    assert len(store.snapshots.current().paths("facts")) == 2
    store_rows = store.facts().where("instance = 'mx-c'").count()
    assert store_rows == 7
    assert (got.purged, got.more, got.invalidated) == (3, False, 1) and store.facts().where("instance = 'mx-a'").count() == 4
    refused("stale", store.current_projection, "p")
    store.commit(df)  # purged records are recognised and skipped
    assert store.facts().where("instance = 'mx-a'").count() == 4
    refused("collision", store.commit, other)
    assert store.snapshots.metadata()["tables"]["facts"]["files"] > 0


def test_two_writers_conflict(spark, tmp_path):
    a, b = FactStore(spark, str(tmp_path / "s")), FactStore(spark, str(tmp_path / "s"))
    base = b.snapshots.current()
    a.commit(facts(spark, INBOUND))
    mark = frozenset(['origin:["src", "org"]'])
    refused("conflict", b.snapshots.publish, lambda at: Change(touch=mark), base)
    assert b.snapshots.put(base, Change(touch=mark)) is None


def test_finite_imports(spark, tmp_path):
    text = INBOUND.strip().encode() + b"\n"
    plain, packed = tmp_path / "a.log", tmp_path / "a.gz"
    plain.write_bytes(text)
    packed.write_bytes(gzip.compress(text[:100]) + gzip.compress(text[100:]))
    rows = {}
    for path, gz in ((plain, False), (packed, True)):
        r = inspect(spark, [str(path)], gz)
        head = r.where(F.col("start_offset").isNull())
        lines = parse_lines(imported(r, "hist", "mx-a").drop("path"), CTX)
        rows[gz] = sorted((x.origin_id, x.start_offset, bytes(x.raw)) for x in lines.collect())
        store = FactStore(spark, str(tmp_path / f"store{gz}"))
        store.import_records("run", head, lines)
        assert store.import_run("run").status == "complete" and store.facts().count() == 7
        assert store.purge_retention("mx-a", 2**62, None).purged == 7 and store.facts().count() == 0
    assert rows[False] == rows[True]
    bomb = tmp_path / "b.gz"
    bomb.write_bytes(gzip.compress(b"0" * 10**6))
    assert "ratio" in inspect(spark, [str(bomb)], True, Caps(ratio=10)).first().failure
    packed.write_bytes(gzip.compress(text)[:-9])
    assert "invalid_gzip" in inspect(spark, [str(packed)], True).first().failure


def test_import_is_taken_up_again(spark, tmp_path):
    text = INBOUND.strip().encode() + b"\n"
    path = tmp_path / "a.log"
    path.write_bytes(text)
    r = inspect(spark, [str(path)])
    head = r.where(F.col("start_offset").isNull())
    lines = parse_lines(imported(r, "hist", "mx-a").drop("path"), CTX).persist()
    top = head.first()
    store = FactStore(spark, str(tmp_path / "store"))
    run = ImportAttempt(store, "run", "hist")
    refused("import_not_begun", run.advance, lines)
    assert run.begin().status == "running" and run.begin().end_offset == 0
    refused("import_mismatch", ImportAttempt(store, "run", "else").begin)
    refused("import_unbound", run.advance, lines)
    run.bind(top.sha256, top.content_bytes)
    refused("import_resume", run.bind, "00" * 32, top.content_bytes)
    ends = sorted(x.end_offset for x in lines.select("end_offset").collect())
    refused("records_not_contiguous", run.advance, lines.where(F.col("start_offset") >= ends[0]))
    refused("import_mismatch", run.advance, lines.withColumn("origin_id", F.lit("other")))
    run.advance(lines.where(F.col("end_offset") <= ends[2]))  # and here the process is lost
    refused("import_unfinished", run.finish)
    store = FactStore(spark, str(tmp_path / "store"))
    row = store.import_run("run")
    assert (row.status, row.records, row.end_offset, row.offset) == ("running", 3, ends[2], ends[2])
    store.import_records("run", head, lines, step_bytes=150)
    row = store.import_run("run")
    assert (row.status, row.records, row.end_offset) == ("complete", 7, len(text)) and store.facts().count() == 7
    refused("import_is_final", ImportAttempt(store, "run", "hist").finish, "late")
    # another run of the same content starts where the checkpoint stands and adds nothing
    store.import_records("again", head, lines)
    assert store.import_run("again").status == "complete" and store.import_run("again").records == 0 and store.facts().count() == 7
    lines.unpersist()


def test_import_of_empty_and_broken_inputs(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    for name, text, status, error in (("empty", b"", "complete", ""), ("tail", INBOUND.strip().encode(), "failed", "partial_final_line"), ("only", b"no end", "failed", "partial_final_line")):
        path = tmp_path / name
        path.write_bytes(text)
        r = inspect(spark, [str(path)])
        store.import_records(name, r.where(F.col("start_offset").isNull()), parse_lines(imported(r, "hist", "mx-a").drop("path"), CTX), "hist")
        row = store.import_run(name)
        assert (row.source_id, row.status, row.error) == ("hist", status, error)
    assert store.facts().count() == 6
    path.write_bytes(b"not gzip")
    r = inspect(spark, [str(path)], True)
    store.import_records("bad", r.where(F.col("start_offset").isNull()), parse_lines(imported(r, "hist", "mx-a").drop("path"), CTX), "hist")
    assert store.import_run("bad").status == "failed" and store.import_run("bad").sha256 is None


def test_revision_does_not_depend_on_layout(spark):
    df = facts(spark, INBOUND).unionByName(facts(spark, INBOUND, origin="two"))
    one = revision(df).first()
    assert one.n_facts == 14 and revision(df.repartition(3)).first() == one
    assert revision(df.where("start_offset > 0")).first().revision != one.revision
    assert revision(df, ("origin_id",)).count() == 2


def test_resume_decisions(tmp_path):
    path = str(tmp_path / "mail.log")
    with open(path, "wb") as f:
        f.write(b"one\ntwo\n")
    o = register(path, 4)
    assert verify(o, path).kind == "match"
    assert select_origin([o], path) == (o, "match") and select_origin([o, o], path)[1] == "ambiguous"
    with open(path, "r+b") as f:
        f.write(b"ONE")
    assert verify(o, path).reason == "prefix_changed"
    with open(path, "r+b") as f:
        f.truncate(2)
    assert verify(o, path).reason == "file_shortened"


def test_rotation_grace_and_truncation(tmp_path):
    path = str(tmp_path / "mail.log")
    with open(path, "wb") as f:
        f.write(b"one\ntail")
    w = Follower(path, grace_s=5)
    w.bootstrap()
    w.poll(0)
    w.advance()
    assert w.origins[0].offset == 4
    with open(path, "ab") as f:
        f.write(b" done\n")
    os.rename(path, path + ".1")
    with open(path, "wb") as f:
        f.write(b"new\n")
    w.poll(1)
    w.advance()
    assert [o.offset for o in w.origins] == [14, 4]
    w.poll(2)
    w.poll(8)
    assert [o.state for o in w.origins] == ["retired", "following"]
    with open(path, "wb") as f:
        f.write(b"x\n")
    with pytest.raises(RefusedError):
        w.poll(9)
        w.advance()


def test_streaming_restart(spark, tmp_path):
    path = str(tmp_path / "mail.log")
    lines = INBOUND.strip().split("\n")
    store = FactStore(spark, str(tmp_path / "store"))

    def run():
        q = ingest(read_log(spark, path, "live", maxBytesPerTrigger="100000"), store, TimeContext(2026, "UTC"), str(tmp_path / "check"), "200 milliseconds")
        q.processAllAvailable()
        q.processAllAvailable()
        q.stop()

    with open(path, "w") as f:
        f.write("\n".join(lines[:4]) + "\npart")
    run()
    assert store.facts().count() == 4
    with open(path, "a") as f:
        f.write("ial\n" + "\n".join(lines[4:]) + "\n")
    run()
    got = store.facts()
    assert got.count() == 8 and got.select("origin_id").distinct().count() == 1
    assert got.where("parse_error <> ''").count() == 1
    whole = open(path, "rb").read()
    row = store.origins().collect()
    assert [(r["state"], r["path"], r["offset"], r["inode"]) for r in row] == [("following", path, len(whole), os.stat(path).st_ino)]
    assert store.checkpoint("live", row[0]["origin_id"]) == (len(whole), anchor(whole[-WINDOW:], len(whole)))

    os.rename(path, path + ".1")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    run()
    assert store.facts().count() == 8 + len(lines)
    assert sorted((r["state"], r["path"]) for r in store.origins().collect()) == [("following", path), ("following", path + ".1")]


def test_read_follows_a_file_that_moves_after_the_plan(tmp_path):
    path = str(tmp_path / "a.log")
    with open(path, "wb") as f:
        f.write(b"one\ntwo\n")
    o = register(path, 8)
    os.rename(path, path + ".1")
    with open(path, "wb") as f:
        f.write(b"new\nnew\nnew\n")
    assert [r[2] for r in records(open_origin(o), 0, 8)] == [b"one\n", b"two\n"]
    with open(path + ".1", "r+b") as f:
        f.write(b"ONE\n")
    with pytest.raises(RefusedError, match="content_changed"):
        open_origin(o)
    os.remove(path + ".1")
    with pytest.raises(RefusedError, match="gap"):
        open_origin(o)


def test_zero_replay_is_asked_for(tmp_path):
    path = str(tmp_path / "a.log")
    with open(path, "wb") as f:
        f.write(b"unfinished")
    first = Follower(path)
    first.bootstrap()
    first.advance()
    for allowed in (False, True):
        again = Follower(path, zero_replay=allowed)
        again.load(first.save())
        if allowed:
            again.advance()
        else:
            with pytest.raises(RefusedError, match="decision"):
                again.advance()
