"""Finite inputs read in pieces: digests, caps and lines, against reading them whole."""

import gzip
import hashlib
import random
import resource

import pytest

from loghelm.schema import MAX_LINE_BYTES, RefusedError
from loghelm.sources import finite
from loghelm.sources.finite import Caps, cut_lines, finite_records, pieces, told


def whole_lines(content):
    at, out = 0, []
    while (end := content.find(b"\n", at)) >= 0:
        out.append((at, end + 1, content[at : end + 1][:MAX_LINE_BYTES]))
        at = end + 1
    return out


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_lines_of_any_cut(size):
    rng = random.Random(size)
    for _ in range(60):
        content = b"".join(rng.choice([b"a", b"\n", b"bc\n", b"\n\n", b"x" * 50]) for _ in range(rng.randrange(60)))
        parts = [content[i : i + size] for i in range(0, len(content), size)]
        assert list(cut_lines(iter(parts))) == whole_lines(content)
        got = list(cut_lines(iter(parts), 10))
        assert got == [(a, b, content[a:b][:10]) for a, b, _ in whole_lines(content)]


def test_members_caps_and_faults(monkeypatch):
    monkeypatch.setattr(finite, "FED", 13)
    monkeypatch.setattr(finite, "PIECE", 50)
    text = b"".join(b"line %d\n" % i for i in range(300))
    packed = b"".join(gzip.compress(text[i : i + 700]) for i in range(0, len(text), 700)) + gzip.compress(b"")
    assert b"".join(pieces(memoryview(packed), True)) == text and all(len(p) <= 50 for p in pieces(memoryview(packed), True))
    assert told(memoryview(packed), True) == told(memoryview(text), False) == finite.Told(hashlib.sha256(text).hexdigest(), len(text), False, "")
    for bad, said in ((packed[:-9], "truncated"), (packed[:-40] + b"\0" + packed[-39:], "invalid_gzip"), (packed + b"\0", "invalid_gzip"), (b"", "invalid_gzip"), (b"no gzip", "invalid_gzip")):
        assert said in told(memoryview(bad), True).failure and told(memoryview(bad), True).content_bytes == 0
    assert "ratio" in told(memoryview(gzip.compress(b"0" * 10**5)), True, Caps(ratio=10)).failure
    assert "content_too_large" in told(memoryview(packed), True, Caps(content_bytes=100)).failure
    assert "content_too_large" in told(memoryview(text), False, Caps(content_bytes=100)).failure
    with pytest.raises(RefusedError):
        list(pieces(memoryview(packed), True, Caps(compressed_bytes=10)))


def test_a_large_input_in_little_memory():
    """300 MB out of a gzip of some 300 kB, cut into lines, in less than 60 MB more."""
    line = b"Oct  1 10:00:00 mx postfix/qmgr[13]: 4F1A2B3C4D: removed".ljust(999) + b"\n"
    packed = memoryview(b"".join([gzip.compress(line * 10_000)] * 30))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = told(packed, True, Caps(ratio=5000))
    n = sum(1 for _ in cut_lines(pieces(packed, True, Caps(ratio=5000))))
    assert (found.content_bytes, n) == (300_000_000, 300_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # kB


def test_records_of_inputs_in_rows(spark):
    texts = {"a": b"one\ntwo\nthree", "b": b"", "c": None, "d": b"x" * (MAX_LINE_BYTES + 5) + b"\nlast\n", "e": b"\n"}
    for packed in (False, True):
        rows = [(k, bytearray(gzip.compress(v) if packed else v) if v is not None else None) for k, v in texts.items()]
        got = finite_records(spark.createDataFrame(rows, "path string, content binary"), packed, Caps(ratio=10**6)).collect()
        heads = {r.path: r for r in got if r.start_offset is None}
        assert set(heads) == set(texts) and len(got) == 5 + 2 + 2 + 1
        for k, v in texts.items():
            if packed and v is None:
                assert "invalid_gzip" in heads[k].failure
                continue
            assert (heads[k].sha256, heads[k].content_bytes, heads[k].partial_tail) == (hashlib.sha256(v or b"").hexdigest(), len(v or b""), k == "a")
        lines = sorted((r.path, r.start_offset, r.end_offset, len(r.raw), r.read_error) for r in got if r.start_offset is not None)
        assert lines == [("a", 0, 4, 4, ""), ("a", 4, 8, 4, ""), ("d", 0, MAX_LINE_BYTES + 6, MAX_LINE_BYTES, "line_too_long"), ("d", MAX_LINE_BYTES + 6, MAX_LINE_BYTES + 11, 5, ""), ("e", 0, 1, 1, "")]
