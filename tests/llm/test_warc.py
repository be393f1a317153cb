"""Archives read back record by record and as a whole, against the pages they were written from."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from loghelm.llm.warc import DICTIONARY_FRAME, PROFILE, archive_digests, read_record, read_warc, record_id, records, write_warc

SHAPE = "page_id long, url string, html string, key string, digest int, payload string"


def pages(spark, rows, parts=3):
    """rows of (page_id, url, html), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "z", 1, "y") for r in rows], SHAPE).repartition(parts)


def plain(rows):
    top = {}
    for page_id, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 1000 and page_id is not None:
            top[html] = max(page_id, top.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = top.get(html or "")
        again = first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


SOME = [(i, f"http://host{i % 7}.example/{i}", f"<html><head><title>Page {i}</title></head><body>{'word ' * (i * 7 % 400)}</body></html>") for i in range(200)]
LONG = "<p>" + "é" * 500 + "</p>"  # more than 1000 bytes, fewer letters
ODD = [
    (500, "http://a/x\r\nWARC-Type: response", LONG),
    (501, "http://a/ü b", LONG),
    (501, None, LONG),
    (499, "http://a/", LONG),
    (None, "http://a/", LONG),
    (502, "http://a/", "x" * 999),
    (503, "http://a/", "x" * 999),
    (504, "http://a/", "x" * 1000),
    (505, "http://a/", "x" * 1000),
    (None, None, "n" * 2000),
    (None, None, "n" * 2000),
    (506, "", None),
    (507, "", ""),
    (508, "u", "WARC/1.1\r\n\r\n" + "\r\n\r\n" * 300),
    (509, "u", "long \x00" * 400_000),
    (509, "u", "long \x00" * 400_000),
]


def test_archives_hold_all_pages(spark, tmp_path):
    rows = SOME + ODD
    index = write_warc(pages(spark, rows), f"file://{tmp_path}/a", date="2024-02-03T04:05:06Z").collect()
    read = read_warc(spark, f"file://{tmp_path}/a")
    assert sorted(map(repr, map(tuple, archive_digests(read).collect()))) == plain(rows)
    told = read.collect()
    want = {(str(i) if i is not None else None, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows}
    for r in told:
        assert r.date == "2024-02-03T04:05:06Z"
        assert (bytes(r.payload) == want[r.key, r.payload_digest]) if r.record_type == "response" else r.payload is None
    ids = {r.record_id for r in told if r.record_type == "response"}
    assert all(r.refers_to in ids for r in told if r.record_type == "revisit")
    assert "http://a/x%0D%0AWARC-Type:%20response" in {r.url for r in told} and "urn:loghelm:none" in {r.url for r in told}
    assert len(index) == len(told) == len(rows) and {(r.record_id, r.record_type) for r in index} == {(r.record_id, r.record_type) for r in told}
    for r in index:
        fields, block = read_record(f"file://{tmp_path}/a", r.file, r.offset, r.length)
        assert (fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("X-Key")) == (r.record_id, r.record_type, r.key)
        assert fields.get("WARC-Profile") == (PROFILE if r.record_type == "revisit" else None)
        if r.record_type == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).digest()).decode()
    assert read_warc(spark, f"file://{tmp_path}/a", payloads=False).where(F.col("payload").isNotNull()).isEmpty()


def test_files_lead_with_their_dictionary_and_are_cut_by_size(spark, tmp_path):
    write_warc(pages(spark, SOME, parts=1).coalesce(1), f"file://{tmp_path}/a", file_bytes=6_000, sample_bytes=40_000)
    files = sorted((tmp_path / "a/archive").iterdir())
    names = [f.name for f in files if not f.name.startswith(".")]
    assert len(names) > 2 and all(n.startswith("part-") for n in names)
    dictionary = 0
    for name in names:
        blob = (tmp_path / "a/archive" / name).read_bytes()
        magic, size = struct.unpack_from("<II", blob)
        first = next(records(blob))[0]
        assert (first["WARC-Type"], first["WARC-Filename"]) == ("warcinfo", name)
        if magic == DICTIONARY_FRAME:
            dictionary += 1
            # without the dictionary the records can't be read
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().stream_reader(blob[8 + size :], read_across_frames=True).read()
    assert dictionary >= 1
    assert sorted(map(repr, map(tuple, archive_digests(read_warc(spark, f"file://{tmp_path}/a")).collect()))) == plain(SOME)


def test_the_same_rows_give_the_same_files(spark, tmp_path):
    for name in "ab":
        write_warc(pages(spark, SOME + ODD), f"file://{tmp_path}/{name}", date="2024-01-01T00:00:00Z")
    files = {n: {f.name: f.read_bytes() for f in (tmp_path / n / "archive").iterdir()} for n in "ab"}
    assert files["a"] == files["b"] and files["a"]


def test_damage_is_noticed_and_empty_tables_are_empty(spark, tmp_path):
    assert write_warc(pages(spark, []), f"file://{tmp_path}/none").collect() == []
    assert read_warc(spark, f"file://{tmp_path}/none").collect() == []
    write_warc(pages(spark, SOME[:3], parts=1), f"file://{tmp_path}/few")
    (name,) = [f.name for f in (tmp_path / "few/archive").iterdir() if f.name.startswith("part-")]
    blob = (tmp_path / "few/archive" / name).read_bytes()
    told = list(records(blob))
    assert [f["WARC-Type"] for f, _ in told] == ["warcinfo", "response", "response", "response"]
    text = zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).read()
    (tmp_path / "few/archive" / name).write_bytes(zstandard.ZstdCompressor().compress(text.replace(b"Page 1", b"Page 9")))
    with pytest.raises(Exception, match="does not have its digest"):
        read_warc(spark, f"file://{tmp_path}/few").collect()
    with pytest.raises(ValueError, match="cut short"):
        list(records(zstandard.ZstdCompressor().compress(text[:-30])))
    assert record_id("1", "u", "d") == record_id("1", "u", "d") != record_id("1", None, "d")
