"""Finite inputs: plain or gzip files, inspected whole and cut into records with byte offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.functions.scalars import import_origin_id
from loghelm.schema import MAX_LINE_BYTES, RefusedError

MAX_INPUTS = 1000
#: bytes that are decoded, fed to a decoder, and given out at a time
PIECE = 1 << 20
FED = 1 << 16
OUT_BYTES = 4 << 20


@dataclass(frozen=True)
class Caps:
    """Bounds of one input; beyond any of them the input is refused whole."""

    content_bytes: int = 1 << 30
    compressed_bytes: int = 1 << 30
    ratio: int = 200


def pieces(content: memoryview, gzip: bool, caps: Caps = Caps()) -> Iterator[bytes | memoryview]:
    """The content of an input, PIECE bytes at most at a time: as it is, or of all members of a gzip
    file, checksums verified. Refused as soon as a cap is passed."""
    if not gzip:
        if len(content) > caps.content_bytes:
            raise RefusedError("content_too_large")
        for at in range(0, len(content), PIECE):
            yield content[at : at + PIECE]
        return
    if len(content) > caps.compressed_bytes:
        raise RefusedError("compressed_too_large")
    if not len(content):
        raise RefusedError("invalid_gzip")
    at = size = 0
    while at < len(content):
        member, rest = zlib.decompressobj(31), b""
        while not member.eof:
            if not rest:
                if at == len(content):
                    raise RefusedError("invalid_gzip", "truncated")
                rest = content[at : at + FED]
                at += len(rest)
            try:
                part = member.decompress(rest, PIECE)
            except zlib.error as x:
                raise RefusedError("invalid_gzip", str(x)) from None
            rest = member.unconsumed_tail
            size += len(part)
            if size > caps.content_bytes:
                raise RefusedError("content_too_large")
            if size > caps.ratio * len(content):
                raise RefusedError("ratio_too_large")
            if part:
                yield part
        at -= len(member.unused_data)


@dataclass(frozen=True)
class Told:
    """What is found out of an input before its lines are read."""

    sha256: str
    content_bytes: int
    partial_tail: bool
    failure: str


def told(content: memoryview, gzip: bool, caps: Caps = Caps()) -> Told:
    digest, size, last = hashlib.sha256(), 0, b""
    try:
        for piece in pieces(content, gzip, caps):
            digest.update(piece)
            size += len(piece)
            last = piece[-1:]
    except RefusedError as x:
        return Told(hashlib.sha256(b"").hexdigest(), 0, False, str(x))
    return Told(digest.hexdigest(), size, size > 0 and bytes(last) != b"\n", "")


def cut_lines(parts: Iterator[bytes | memoryview], most: int = MAX_LINE_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, line) of each LF-terminated line of a content that comes in parts; of a longer
    line the first `most` bytes. A tail without LF gives none. Never holds more than a part and
    `most` bytes."""
    start = at = 0
    head = b""
    for part in parts:
        part = bytes(part)
        begin = 0
        while (stop := part.find(b"\n", begin)) >= 0:
            line = head + part[begin : stop + 1][: most - len(head)] if len(head) < most else head
            yield start, at + stop + 1, line
            start, begin, head = at + stop + 1, stop + 1, b""
        if len(head) < most:
            head += part[begin : begin + most - len(head)]
        at += len(part)


RECORDS = "path string, sha256 string, content_bytes long, partial_tail boolean, start_offset long, end_offset long, raw binary, read_error string, failure string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_SHAPE = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in RECORDS.split(", ")])


def _rows(path: str, content: memoryview, gzip: bool, caps: Caps) -> Iterator[tuple]:
    """The head row of an input, then its lines: one reading to find its digest, one to cut it."""
    t = told(content, gzip, caps)
    head = (path, t.sha256, t.content_bytes, t.partial_tail)
    yield (*head, None, None, None, None, t.failure)
    if not t.failure:
        for start, end, line in cut_lines(pieces(content, gzip, caps)):
            yield (*head, start, end, line, "line_too_long" if end - start > MAX_LINE_BYTES else "", "")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHAPE, strict=True)], schema=_SHAPE)


def finite_records(files: DataFrame, gzip: bool = False, caps: Caps = Caps()) -> DataFrame:
    """RECORDS of inputs given as rows of (path, content): a head row each (no offsets) and a row for
    each LF-terminated line. Contents are read in pieces, and rows go out OUT_BYTES at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for i in range(len(b)):
                raw = b.column(1)[i]
                content = memoryview(raw.as_buffer()) if raw.is_valid else memoryview(b"")
                for row in _rows(b.column(0)[i].as_py(), content, gzip, caps):
                    held.append(row)
                    size += 256 + len(row[6] or b"")
                    if size >= OUT_BYTES:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return files.select("path", "content").mapInArrow(cut, RECORDS)


def inspect(spark: SparkSession, paths: list[str], gzip: bool = False, caps: Caps = Caps()) -> DataFrame:
    """RECORDS: a head row per input (no offsets) and a row per LF-terminated line.

    gzip is stated, never guessed from a name. Inputs are read by Spark, one task each; it leaves
    out files of no bytes, so these are found by their size.
    """
    if not 1 <= len(paths) <= MAX_INPUTS or len(set(paths)) != len(paths):
        raise RefusedError("invalid_inputs")
    out = finite_records(spark.read.format("binaryFile").load(paths), gzip, caps)
    heads = [row for path in _empty(spark, paths) for row in _rows(path, memoryview(b""), gzip, caps)]
    return out.unionByName(spark.createDataFrame(heads, RECORDS)) if heads else out


def _empty(spark: SparkSession, paths: list[str]) -> list[str]:
    conf = spark._jsc.hadoopConfiguration()
    found = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths)
    said = [p.getFileSystem(conf).getFileStatus(p) for p in found]  # at most MAX_INPUTS
    return [s.getPath().toString() for s in said if s.isFile() and s.getLen() == 0]


def imported(records: DataFrame, source_id: str, instance: str) -> DataFrame:
    """Line rows with their identity: the same bytes from the same source are the same origin."""
    lines = records.where(F.col("start_offset").isNotNull())
    return lines.select(
        F.lit(source_id).alias("source_id"), import_origin_id(F.lit(source_id), F.col("sha256")).alias("origin_id"), "start_offset", "end_offset", F.lit(instance or source_id).alias("instance"), "raw", "read_error", "path"
    )
