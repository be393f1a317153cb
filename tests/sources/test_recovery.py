"""Taking paths up again: tables of cases, whole sets, unknown lifecycles, fair turns."""

import json
import os
from dataclasses import asdict, replace

import pytest

from loghelm.schema import RefusedError
from loghelm.sources.envelope import TimeContext
from loghelm.sources.follow import REASONS, WINDOW, Follower, LogFileReader, anchor, prefix_fingerprint, register, verify
from loghelm.sources.recovery import ResumeError, resume, settle_unknown
from loghelm.store.facts_store import CHECKPOINTS, ORIGINS, FactStore
from loghelm.streaming.ingest import ingest, read_log
from tests.helpers import INBOUND


def made(path, text=b"one\ntwo\n"):
    with open(path, "wb") as f:
        f.write(text)
    return str(path)


def at(path, offset):
    return register(str(path), offset)


def troubles(f, *a, **kw):
    with pytest.raises(ResumeError) as x:
        f(*a, **kw)
    return [(p.code, p.reason) for p in x.value.parts]


def test_every_reason(tmp_path):
    path = made(tmp_path / "a.log")
    o = at(path, 4)
    cases = {
        "fingerprints_match": (o, "match"),
        "invalid_state": (replace(o, state="unknown"), "insufficient"),
        "physical_identity_changed": (replace(o, inode=o.inode + 1), "different"),
        "invalid_prefix": (replace(o, prefix="md5:1:x"), "insufficient"),
        "missing_checkpoint": (replace(o, anchor=""), "insufficient"),
        "invalid_anchor": (replace(o, anchor=anchor(b"one\n", 5)), "insufficient"),
        "empty_prefix": (replace(o, prefix=prefix_fingerprint(b"")), "insufficient"),
        "zero_checkpoint": (at(path, 0), "insufficient"),
        "file_shortened": (replace(o, offset=9, anchor=anchor(b"x" * 9, 9)), "different"),
        "prefix_changed": (replace(o, prefix=prefix_fingerprint(b"ONE\n")), "different"),
        "anchor_changed": (replace(o, anchor=anchor(b"ONE\n", 4)), "different"),
        "not_line_boundary": (at(path, 3), "insufficient"),
    }
    for reason, (origin, kind) in cases.items():
        assert (verify(origin, path).kind, verify(origin, path).reason) == (kind, reason)
    assert verify(o, path + ".none").reason == "physical_identity_unavailable"
    assert verify(at(path, 0), path, zero_replay=True) == verify(replace(at(path, 0), prefix=prefix_fingerprint(b"")), path, True)
    assert verify(at(path, 0), path, True).reason == "zero_checkpoint_replay"
    assert {*cases, "physical_identity_unavailable", "zero_checkpoint_replay"} == set(REASONS)


def test_whole_sets_or_nothing(tmp_path):
    path = made(tmp_path / "mail.log", b"old\nlines\n")
    old = at(path, 4)
    os.rename(path, path + ".1")
    made(path, b"new\nlines\n")
    new = at(path, 4)
    found = resume([new, old], path)
    assert (found.status, found.current) == ("ready", "known")
    assert [(o.origin_id, o.path) for o in found.origins] == [(old.origin_id, path + ".1"), (new.origin_id, path)]
    assert resume([replace(new, state="retired")], path).status == resume([], path).status == "absent"

    # one of two can't be found: the other is not taken up either, and both troubles are told
    lost = replace(old, inode=1)
    assert troubles(resume, [lost, new], path) == [("gap", "physical_identity_unavailable")]
    assert troubles(resume, [lost, replace(new, anchor="")], path) == [("gap", "physical_identity_unavailable"), ("decision", "missing_checkpoint")]
    assert troubles(resume, [replace(old, prefix=prefix_fingerprint(b"x")), new], path) == [("content_changed", "prefix_changed")]
    assert troubles(resume, [new, replace(new, origin_id="twin")], path) == [("decision", "ambiguous")] * 2
    assert troubles(resume, [old, replace(new, state="unknown")], path) == [("decision", "lifecycle_unknown")]
    assert troubles(resume, [old, replace(new, state="?")], path) == [("decision", "invalid_state")]
    assert [c for c, _ in troubles(resume, [old, new, replace(new, origin_id="third")], path)] == ["capacity"]

    # the path is gone, or a third file
    os.rename(path, path + ".2")
    assert troubles(resume, [old, new], path) == [("missing", path)]
    made(path, b"third\n")
    assert troubles(resume, [old, new], path) == [("capacity", "the path is a further file")]
    assert resume([old], path).current == "new"
    os.symlink(path + ".1", path + ".link")
    assert resume([old], path).origins[0].path == path + ".1"


def test_zero_is_replayed_for_one_origin_at_the_path_only(tmp_path):
    path = made(tmp_path / "mail.log", b"unfinished")
    o = at(path, 0)
    assert troubles(resume, [o], path) == [("decision", "zero_checkpoint")]
    assert resume([o], path, zero_replay=True).status == "ready"
    os.rename(path, path + ".1")
    made(path, b"new\n")
    assert troubles(resume, [o], path, zero_replay=True) == [("decision", "zero_checkpoint")]
    assert troubles(resume, [o, at(path, 4)], path, zero_replay=True) == [("decision", "zero_checkpoint")]


def test_generations_take_fair_turns(tmp_path):
    path = made(tmp_path / "mail.log", b"a234567\n" * 1000)
    w = Follower(path, budget=8)
    w.bootstrap()
    w.advance()  # a file that moves is known by what was read of it
    w.budget = 800
    os.rename(path, path + ".1")
    made(path, b"b234567\n" * 250)
    w.poll(0)
    for k in range(1, 6):
        w.advance()
        assert [o.offset for o in w.origins] == [8 + 400 * k, 400 * k]
    again = Follower(path, budget=800)
    again.load(json.loads(json.dumps(w.save())))
    again.advance()
    assert [o.offset for o in again.origins] == [2808, 2000]  # what one leaves goes to the other
    odd = Follower(path, budget=801)
    odd.load(w.save())
    firsts = []
    for _ in range(4):
        before = [o.offset for o in odd.origins]
        odd.advance()
        firsts.append(sum(o.offset for o in odd.origins) - sum(before))
    assert max(firsts) <= 808 and odd.turn == w.turn + 4
    long = made(tmp_path / "long.log", b"x" * 5000 + b"\n")
    one = Follower(long, budget=100)
    one.bootstrap()
    one.advance()
    assert one.origins[0].offset == 5001


def test_a_reader_starts_from_stored_origins(tmp_path):
    path = made(tmp_path / "mail.log")
    o = at(path, 4)
    reader = LogFileReader({"sourceId": "s", "path": path, "stored": json.dumps([asdict(o)])})
    begin = reader.initialOffset()
    assert [(x["origin_id"], x["offset"]) for x in begin["origins"]] == [(o.origin_id, 4)]
    end = reader.latestOffset()
    (part,) = reader.partitions(begin, end)
    assert [r[5] for r in reader.read(part) if r[7] is None] == [b"two\n"]
    with open(path, "r+b") as f:
        f.write(b"ONE\n")
    with pytest.raises(RefusedError, match="prefix_changed"):
        LogFileReader({"sourceId": "s", "path": path, "stored": json.dumps([asdict(o)])}).initialOffset()


def test_a_stream_goes_on_without_its_checkpoint(spark, tmp_path):
    path, lines = str(tmp_path / "mail.log"), INBOUND.strip().split("\n")
    store = FactStore(spark, str(tmp_path / "store"))

    def run(check):
        q = ingest(read_log(spark, path, "live", store=store), store, TimeContext(2026, "UTC"), str(tmp_path / check), "200 milliseconds")
        q.processAllAvailable()
        q.processAllAvailable()
        q.stop()

    made(path, ("\n".join(lines[:4]) + "\n").encode())
    run("one")
    with open(path, "a") as f:
        f.write("\n".join(lines[4:]) + "\n")
    run("two")  # the first checkpoint is lost
    assert store.facts().count() == len(lines) and store.origins().count() == 1
    (row,) = store.origins().collect()
    assert (row.offset, row.state) == (os.path.getsize(path), "following")

    # an unknown lifecycle blocks until it is settled
    bad = FactStore(spark, str(tmp_path / "other"))
    o = at(path, row.offset)
    bad.commit(origins=spark.createDataFrame([("live", o.origin_id, path, o.device, o.inode, o.prefix, "unknown")], ORIGINS), checkpoints=spark.createDataFrame([("live", o.origin_id, o.offset, o.anchor)], CHECKPOINTS))
    for name, code in (("", "invalid_origin"), ("else", "decision")):
        with pytest.raises(RefusedError) as x:
            settle_unknown(bad, "live", path, name)
        assert x.value.code == code
    with pytest.raises(RefusedError, match="absent"):
        settle_unknown(bad, "none", path, o.origin_id)
    assert settle_unknown(bad, "live", path, o.origin_id) is True and settle_unknown(bad, "live", path, o.origin_id) is False
    assert bad.origins().first().state == "following" and bad.checkpoint("live", o.origin_id) == (o.offset, o.anchor)
    made(path, b"X" * WINDOW)
    assert troubles(settle_unknown, bad, "live", path, o.origin_id)[0][0] == "content_changed"
