"""WARC archives whose records are Zstandard frames that share a dictionary of their file.

Writing: a record of each page, a `response` with the whole payload or, where a larger page has
the same payload, a `revisit` that refers to it. Payloads are compared by SHA-1 and length, and the
largest key of each is found by an aggregation of digests alone; payloads are shuffled once, to
meet it. Each task writes files of about `file_bytes`. Of a file's records the first `sample_bytes`
are held (of long ones, SAMPLE_EACH bytes each), a Zstandard dictionary is built from them, and
written as a leading skippable frame (0x184D2A5D); then every record is a frame of its own, so one
record can be read by its place alone (`read_record`). What is held is bounded by the sample and
one record. A file gets its name when it is complete, and names and bytes follow from the rows of
the task, so a task that is run again writes the same file. The index, one row per record, names
all files that belong to the archive.

Reading: Spark reads the files, and each is decoded as a stream. A payload that does not have the
digest of its record is an error.

Folders are written by pyarrow's file systems (local or mounted folders, HDFS, S3, GCS) and read
by Spark's.

Defined cases: null payloads are empty; null keys have no key in the record, come before all
others, and alone never make a revisit; rows that share the largest key of a payload are responses
all of them; a null address is `urn:loghelm:none`; bytes of an address or key other than printable
ASCII are percent-encoded; an empty table writes no files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: magic number of the skippable frame that holds a dictionary, and of a Zstandard frame
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_EACH = 128 << 10
LEAST_SAMPLES = 16
READ_BYTES = 4 << 20
SAFE = "".join(map(chr, range(0x21, 0x7F)))
INDEX = "file string, offset long, length long, key string, record_type string, record_id string"
RECORD = "file string, record_type string, record_id string, key string, url string, date string, payload_digest string, payload_bytes long, refers_to_key string, refers_to string, payload binary"


def _plain(text: str) -> str:
    """text as it may stand in a header: printable ASCII, the rest percent-encoded."""
    return quote(text, safe=SAFE)


def record_id(key: str | None, url: str | None, digest: str) -> str:
    """The same for rows that are alike."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((key, url, digest)))}>"


def _sha1(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(key: str | None, url: str | None, payload: bytes, digest: str, date: str, refers_key: str | None, refers_url: str | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, record) of a page; the HTTP header of a revisit tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id(key, url, digest)
    said = lambda u: "urn:loghelm:none" if u is None else _plain(u)
    fields = [
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", said(url)),
        ("WARC-Payload-Digest", _sha1(digest)),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Key", None if key is None else _plain(key)),
    ]
    if not revisit:
        return own, _record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_key, refers_url, digest)), ("WARC-Refers-To-Target-URI", said(refers_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Key", _plain(refers_key))]
    return own, _record("revisit", fields, http)


class WarcFile:
    """One file being written; `rows` are its index."""

    def __init__(self, files: pafs.FileSystem, folder: str, name: str, attempt: str, date: str, sample_bytes: int, dict_bytes: int, level: int):
        self.files, self.folder, self.name, self.date = files, folder, name, date
        self.draft = f"{folder}/_{attempt}-{name}"
        self.sample_bytes, self.dict_bytes, self.level = sample_bytes, dict_bytes, level
        self.held: list[tuple[tuple, bytes]] = []
        self.holding = 0
        self.out = self.packer = None
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, told: tuple, record: bytes) -> None:
        if self.packer is not None:
            self._frame(told, record)
            return
        self.held.append((told, record))
        self.holding += len(record)
        if self.holding >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        self.out = self.files.open_output_stream(self.draft, compression=None)
        built = None
        if len(self.held) >= LEAST_SAMPLES:
            try:
                built = zstandard.train_dictionary(self.dict_bytes, [r[:SAMPLE_EACH] for _, r in self.held], k=200, d=8)
            except zstandard.ZstdError:  # too little in them to build one
                built = None
        options = {} if built is None else {"dict_data": built}
        self.packer = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True, **options)
        if built is not None:
            raw = built.as_bytes()
            small = zstandard.ZstdCompressor(level=19).compress(raw)
            body = min(raw, small, key=len)
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        about = b"software: loghelm\r\nformat: WARC File Format 1.1\r\n"
        info = _record("warcinfo", [("WARC-Record-ID", record_id(self.name, None, "")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about)
        self._write(self.packer.compress(info))
        for told, record in self.held:
            self._frame(told, record)
        self.held = []

    def _frame(self, told: tuple, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.rows.append((self.name, self.size, len(frame), *told))
        self._write(frame)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> pa.RecordBatch:
        if self.packer is None:
            self._start()
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.files.get_file_info(final).type != pafs.FileType.NotFound and not isinstance(self.files, pafs.LocalFileSystem):
            self.files.delete_file(final)  # of an earlier attempt, with the same bytes
        self.files.move(self.draft, final)
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names)


def write_warc(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, file_bytes: int = 32 << 20, sample_bytes: int = 8 << 20, dict_bytes: int = 64 << 10, level: int = 6, date: str | None = None) -> DataFrame:
    """Writes the archive of pages to folder/archive and its index to folder/index, which is
    returned: (file, offset, length, key, record_type, record_id) of every record. `revisit_bytes`
    is the least payload that is compared, `file_bytes` the compressed size at which a file ends."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive = f"{folder.rstrip('/')}/archive"
    files, path = pafs.FileSystem.from_uri(archive)
    files.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    long_ones = rows.select("key", "url", "digest", "n").where(F.col("n") >= revisit_bytes)
    first = long_ones.groupBy("digest", "n").agg(F.max(F.struct("key", "url")).alias("top"), F.count(F.lit(1)).alias("rows"))
    first = first.where("rows > 1 AND top.key IS NOT NULL").drop("rows")
    met = rows.join(first, ["digest", "n"], "left")
    revisit = F.coalesce(F.col("top.key").isNotNull() & ~F.col("key").eqNullSafe(F.col("top.key")), F.lit(False))
    ready = met.sortWithinPartitions("key", "url", "digest").select(
        F.col("key").cast("string").alias("key"), "url", "payload", "digest", F.col("top.key").cast("string").alias("refers_key"), F.col("top.url").alias("refers_url"), revisit.alias("revisit")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(archive)
        task = TaskContext.get()
        n, now = 0, None
        for batch in batches:
            for i in range(len(batch)):
                key, url, payload, digest, refers_key, refers_url, revisit = (batch.column(c)[i].as_py() for c in range(7))
                if now is None:
                    name = f"part-{task.partitionId():06d}-{n:05d}.warc.zst"
                    now, n = WarcFile(files, path, name, str(task.taskAttemptId()), date, sample_bytes, dict_bytes, level), n + 1
                own, record = page_record(key, url, payload, digest, date, refers_key, refers_url, revisit)
                now.add((key, "revisit" if revisit else "response", own), record)
                if now.size >= file_bytes:
                    yield now.close()
                    now = None
        if now is not None:
            yield now.close()

    ready.mapInArrow(work, INDEX).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/index")


def _opened(blob: bytes | memoryview) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decoder with the file's dictionary, and where its records begin."""
    if len(blob) >= 8 and struct.unpack_from("<I", blob)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", blob, 4)[0]
        body = bytes(blob[8 : 8 + size])
        if body.startswith(FRAME):
            body = zstandard.ZstdDecompressor().decompress(body)
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT)), 8 + size
    return zstandard.ZstdDecompressor(), 0


def records(blob: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file."""
    decoder, begin = _opened(blob)
    stream = io.BufferedReader(decoder.stream_reader(memoryview(blob)[begin:], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("ascii").partition(":")
            fields[name] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
        yield fields, block


def read_record(folder: str, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; of the rest of the file only the dictionary is read."""
    files, path = pafs.FileSystem.from_uri(f"{folder.rstrip('/')}/archive/{file}")
    with files.open_input_file(path) as f:
        head = f.read_at(8, 0)
        size = struct.unpack_from("<I", head, 4)[0] if len(head) == 8 and struct.unpack_from("<I", head)[0] == DICTIONARY_FRAME else 0
        decoder, _ = _opened(f.read_at(8 + size, 0))
        frame = f.read_at(length, offset)
    head, _, rest = decoder.decompress(frame).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _read(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A page's record as a row of RECORD, without the file."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line.split(b":", 1)[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return (fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("X-Key"), fields["WARC-Target-URI"], fields["WARC-Date"], digest, length, fields.get("X-Refers-To-Key"), fields.get("WARC-Refers-To"), payload if whole and payloads else None)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every page's record of the archive in folder; `payload` is null for revisits, and everywhere
    if `payloads` is off."""
    kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in RECORD.split(", ")]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                file = batch.column(0)[i].as_py()
                rows, size = [], 0
                for fields, block in records(memoryview(batch.column(1)[i].as_buffer())):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    rows.append((file, *_read(fields, block, payloads)))
                    size += len(block) if payloads else 256
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder.rstrip('/')}/archive")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(work, RECORD)


def archive_digests(records_read: DataFrame) -> DataFrame:
    """What the archive tells of each page."""
    return records_read.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))
