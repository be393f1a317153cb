"""A growing log file as a streaming source with byte offsets and verified resumption.

A file is known by device and inode, by a fingerprint of its first bytes, and by an anchor: a
digest of the bytes before the checkpoint. Before any byte is read on, all three must match; a
file that only looks the same is refused, and so is one with too little to tell.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import stat
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loghelm.schema import MAX_LINE_BYTES, RefusedError

WINDOW = 4096
MAX_OPEN = 2
MAX_ENTRIES = 1000
ROUND_BYTES = 64 * 1024
GRACE_S = 30.0

# Fixed vocabulary of lifecycle states and legal changes.
TRANSITIONS = {("unknown", "following"), ("following", "retired"), ("retired", "following"), ("following", "following"), ("retired", "retired")}
FAILURES = ("gap", "content_changed", "decision", "capacity", "missing", "error", "deadline", "canceled", "none")
DEGRADED_FROM = "error"


def prefix_fingerprint(data: bytes) -> str:
    data = data[:WINDOW]
    return f"sha256:{len(data)}:{hashlib.sha256(data).hexdigest()}"


def anchor(data: bytes, offset: int) -> str:
    """Digest of the last bytes before an offset; `data` are those bytes."""
    data = data[-WINDOW:]
    return f"sha256:{offset}:{len(data)}:{hashlib.sha256(data).hexdigest()}"


@dataclass(frozen=True)
class Origin:
    """One generation of a followed file, and how far it has been committed."""

    origin_id: str
    path: str
    device: int
    inode: int
    prefix: str = ""
    offset: int = 0
    anchor: str = ""
    state: str = "following"
    eof_since: float | None = None


def stored_change(before: str, after: str) -> None:
    if (before, after) not in TRANSITIONS:
        raise RefusedError("illegal_transition", f"{before} to {after}")


# Fixed vocabulary: why a file is, or is not, an origin.
REASONS = (
    "fingerprints_match",
    "invalid_state",
    "physical_identity_unavailable",
    "physical_identity_changed",
    "invalid_prefix",
    "missing_checkpoint",
    "invalid_anchor",
    "empty_prefix",
    "zero_checkpoint",
    "zero_checkpoint_replay",
    "file_shortened",
    "prefix_changed",
    "anchor_changed",
    "not_line_boundary",
)


@dataclass(frozen=True)
class Verdict:
    """match, different, insufficient or restart_zero, and why: one of REASONS."""

    kind: str
    reason: str


def _read(path: str, at: int, n: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(n)


def _anchored(o: Origin) -> bool:
    """Whether the anchor has the form of one for the origin's offset."""
    parts = o.anchor.split(":")
    return len(parts) == 4 and parts[0] == "sha256" and parts[1] == str(o.offset) and parts[2] == str(min(WINDOW, o.offset)) and len(parts[3]) == 64


def verify(origin: Origin, path: str, zero_replay: bool = False) -> Verdict:
    """Whether the file at path is this origin. The checks run in a fixed order."""
    if origin.state not in ("following", "retired"):
        return Verdict("insufficient", "invalid_state")
    try:
        s = os.stat(path, follow_symlinks=False)
    except FileNotFoundError:
        return Verdict("different", "physical_identity_unavailable")
    if not stat.S_ISREG(s.st_mode) or (s.st_dev, s.st_ino) != (origin.device, origin.inode):
        return Verdict("different", "physical_identity_changed")
    known = origin.prefix.split(":")
    if len(known) != 3 or known[0] != "sha256" or not known[1].isdigit():
        return Verdict("insufficient", "invalid_prefix")
    if origin.offset and not origin.anchor:
        return Verdict("insufficient", "missing_checkpoint")
    if origin.offset and not _anchored(origin):
        return Verdict("insufficient", "invalid_anchor")
    if int(known[1]) == 0:
        return Verdict("restart_zero", "zero_checkpoint_replay") if zero_replay and origin.offset == 0 else Verdict("insufficient", "empty_prefix")
    if origin.offset == 0 and not zero_replay:
        return Verdict("insufficient", "zero_checkpoint")
    if s.st_size < origin.offset:
        return Verdict("different", "file_shortened")
    if prefix_fingerprint(_read(path, 0, int(known[1]))) != origin.prefix:
        return Verdict("different", "prefix_changed")
    if origin.offset == 0:
        return Verdict("restart_zero", "zero_checkpoint_replay")
    begin = max(0, origin.offset - WINDOW)
    tail = _read(path, begin, origin.offset - begin)
    if anchor(tail, origin.offset) != origin.anchor:
        return Verdict("different", "anchor_changed")
    if not tail.endswith(b"\n"):
        return Verdict("insufficient", "not_line_boundary")
    return Verdict("match", "fingerprints_match")


def select_origin(origins: list[Origin], path: str, zero_replay: bool = False) -> tuple[Origin | None, str]:
    """The one stored origin that the file is. All candidates are tried: two matches are
    ambiguous, and one that can't be told blocks."""
    if len(origins) > MAX_ENTRIES:
        return None, "limit_reached"
    verdicts = [(o, verify(o, path, zero_replay)) for o in origins]
    good = [o for o, v in verdicts if v.kind in ("match", "restart_zero")]
    if any(v.kind == "insufficient" for _, v in verdicts):
        return None, "insufficient"
    if len(good) > 1:
        return None, "ambiguous"
    return (good[0], "match") if good else (None, "absent")


def search_rotation(origin: Origin, directory: str) -> tuple[str | None, str]:
    """The renamed file that the origin is now, among at most MAX_ENTRIES directory entries;
    links, odd files and compressed files are passed over."""
    found, n = [], 0
    with os.scandir(directory) as entries:
        for entry in entries:
            n += 1
            if n > MAX_ENTRIES:
                return None, "limit_reached"
            if entry.name.endswith(".gz") or not entry.is_file(follow_symlinks=False):
                continue
            verdict = verify(origin, entry.path)
            if verdict.kind == "match":
                found.append(entry.path)
    if len(found) > 1:
        return None, "ambiguous"
    return (found[0], "match") if found else (None, "absent")


def first_offset(path: str, start_at: str) -> int:
    """0 for 'beginning'; the size for 'end', refused where the last line is not complete."""
    if start_at == "beginning":
        return 0
    if start_at != "end":
        raise RefusedError("invalid_option", "startAt")
    size = os.stat(path).st_size
    if size and _read(path, size - 1, 1) != b"\n":
        raise RefusedError("partial_final_line")
    return size


def register(path: str, offset: int = 0) -> Origin:
    """A new origin for the file at path, identity checked before and after its bytes are read."""
    before = os.stat(path, follow_symlinks=False)
    if not stat.S_ISREG(before.st_mode):
        raise RefusedError("not_regular", path)
    prefix = prefix_fingerprint(_read(path, 0, WINDOW))
    begin = max(0, offset - WINDOW)
    tail = _read(path, begin, offset - begin)
    after = os.stat(path, follow_symlinks=False)
    if (before.st_dev, before.st_ino) != (after.st_dev, after.st_ino):
        raise RefusedError("replaced_while_opening", path)
    return Origin(secrets.token_hex(16), path, before.st_dev, before.st_ino, prefix, offset, anchor(tail, offset) if offset else "")


def complete_end(path: str, offset: int, budget: int = ROUND_BYTES) -> int:
    """End of the last complete line within the budget from offset (one line at least)."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(budget)
        cut = data.rfind(b"\n")
        while cut < 0 and data:
            part = f.read(budget)
            if not part:
                return offset
            hit = part.find(b"\n")
            if hit >= 0:
                return offset + len(data) + hit + 1
            data += part
    return offset + cut + 1 if cut >= 0 else offset


def open_origin(o: Origin) -> BinaryIO:
    """The origin's file, known by the identity of the open descriptor and by the bytes before its
    offset, under its path or any other name in the folder; RefusedError: gap, content_changed."""
    folder = os.path.dirname(o.path) or "."
    with os.scandir(folder) as entries:
        names = [e.path for e in entries if e.inode() == o.inode]
    for path in dict.fromkeys((o.path, *names)):
        try:
            f = os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb")
        except OSError:
            continue
        s = os.fstat(f.fileno())
        if not stat.S_ISREG(s.st_mode) or (s.st_dev, s.st_ino) != (o.device, o.inode):
            f.close()
            continue
        begin = max(0, o.offset - WINDOW)
        f.seek(begin)
        if o.offset and anchor(f.read(o.offset - begin), o.offset) != o.anchor:
            f.close()
            raise RefusedError("content_changed", path)
        return f
    raise RefusedError("gap", f"no file is origin {o.origin_id}")


def records(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[int, int, bytes, str]]:
    """(start, end, raw, error) of the lines in a range; of a long line only a prefix is kept."""
    with f:
        f.seek(begin)
        at = begin
        while at < end:
            line = f.readline()
            if not line.endswith(b"\n"):
                raise RefusedError("gap", "the file shrank")
            long = len(line) > MAX_LINE_BYTES
            yield at, at + len(line), line[:MAX_LINE_BYTES] if long else line, "line_too_long" if long else ""
            at += len(line)


@dataclass
class Follower:
    """The state of a followed path: at most MAX_OPEN generations, the oldest first."""

    path: str
    start_at: str = "beginning"
    grace_s: float = GRACE_S
    zero_replay: bool = False
    budget: int = ROUND_BYTES
    origins: list[Origin] = field(default_factory=list)
    loaded: set[str] = field(default_factory=set)
    turn: int = 0

    def bootstrap(self) -> None:
        if os.path.exists(self.path):
            self.origins = [register(self.path, first_offset(self.path, self.start_at))]

    def locate(self, o: Origin) -> str:
        """Where the origin's file is now, or RefusedError: gap, content_changed, decision. An origin
        taken up again at offset 0 has no anchor, and is followed only if `zero_replay` allows it."""
        for path in dict.fromkeys((o.path, self.path)):
            if os.path.exists(path):
                s = os.stat(path, follow_symlinks=False)
                if (s.st_dev, s.st_ino) == (o.device, o.inode):
                    known = o.offset or o.origin_id in self.loaded
                    verdict = verify(o, path, self.zero_replay) if known else Verdict("match", "fingerprints_match")
                    if verdict.kind == "insufficient":
                        raise RefusedError("decision", verdict.reason)
                    if verdict.kind == "different":
                        raise RefusedError("content_changed", verdict.reason)
                    if verdict.kind == "match" or verdict.kind == "restart_zero":
                        return path
        found, why = search_rotation(o, os.path.dirname(self.path) or ".")
        if not found:
            raise RefusedError("gap", why)
        return found

    def poll(self, now: float | None = None) -> None:
        """Adopts a replacement of the path, and retires a generation idle for the grace time."""
        now = time.time() if now is None else now
        live = [o for o in self.origins if o.state == "following"]
        if os.path.exists(self.path):
            s = os.stat(self.path, follow_symlinks=False)
            if not any((o.device, o.inode) == (s.st_dev, s.st_ino) for o in live):
                if len(live) >= MAX_OPEN:
                    raise RefusedError("capacity")
                self.origins.append(register(self.path, 0))
                live = [o for o in self.origins if o.state == "following"]
        for i, o in enumerate(self.origins):
            if o.state != "following" or o is self.origins[-1]:
                continue
            path = self.locate(o)
            idle = os.stat(path).st_size == o.offset
            since = (o.eof_since or now) if idle else None
            done = idle and now - since >= self.grace_s
            self.origins[i] = replace(o, path=path, eof_since=since, state="retired" if done else o.state)

    def advance(self) -> None:
        """Live generations go on over complete lines, within one budget for all of them. Each gets an
        equal share; what one leaves goes to the others in turn, and the turn moves on each time,
        so a busy generation can't starve another. A line longer than what is left is still read."""
        live = [i for i, o in enumerate(self.origins) if o.state == "following"]
        live = live[self.turn % len(live) :] + live[: self.turn % len(live)] if live else []
        left = self.budget
        for share in (self.budget // max(1, len(live)), self.budget):
            for i in live:
                if left > 0:
                    before = self.origins[i].offset
                    self._go_on(i, max(1, min(share, left)))
                    left -= self.origins[i].offset - before
        if left < self.budget:  # else nothing came, and what is saved must stay the same
            self.turn += 1

    def _go_on(self, i: int, budget: int) -> None:
        o = self.origins[i]
        path = self.locate(o)
        end = complete_end(path, o.offset, budget)
        if end == o.offset:
            return
        begin = max(0, end - WINDOW)
        prefix = o.prefix if int(o.prefix.split(":")[1]) == WINDOW else prefix_fingerprint(_read(path, 0, min(WINDOW, end)))
        self.origins[i] = replace(o, path=path, prefix=prefix, offset=end, anchor=anchor(_read(path, begin, end - begin), end), eof_since=None)

    def save(self) -> dict:
        return {"origins": [asdict(o) for o in self.origins], "turn": self.turn}

    def load(self, offset: dict) -> None:
        self.origins = [Origin(**o) for o in offset["origins"]]
        self.loaded = {o.origin_id for o in self.origins}
        self.turn = offset.get("turn", 0)


def diagnose(errors: list[str]) -> tuple[str, bool]:
    """The gravest failure by the fixed order, and whether it degrades the source."""
    worst = min((FAILURES.index(e) for e in errors if e in FAILURES), default=len(FAILURES) - 1)
    return FAILURES[worst], worst <= FAILURES.index(DEGRADED_FROM)


@dataclass
class Range(InputPartition):
    """Bytes of an origin from `begin` to its offset, and the origin as it is then."""

    begin: int
    origin: Origin


MARKED = ("path", "prefix", "offset", "state")
#: what the `origin` column of a mark holds, as JSON
MARK = "path string, device long, inode long, prefix string, offset long, anchor string, state string"


class LogFileSource(DataSource):
    """spark.readStream.format("loghelm_log").option("path", ...).option("sourceId", ...)

    A row is a line (`origin` is null) or, once in a batch for each origin that changed, its mark:
    `origin` holds its state and verified position as JSON, and there is no line. Files are read
    where the tasks run, so the folder must be one that the executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "loghelm_log"

    def schema(self) -> str:
        return "source_id string, origin_id string, start_offset long, end_offset long, instance string, raw binary, read_error string, origin string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogFileReader(self.options)


class LogFileReader(DataSourceStreamReader):
    def __init__(self, options):
        self.source_id = options["sourceId"]
        self.instance = options.get("trustedHost") or self.source_id
        self.follower = Follower(options["path"], options.get("startAt", "beginning"), float(options.get("grace", GRACE_S)), options.get("zeroReplay", "false") == "true", int(options.get("maxBytesPerTrigger", ROUND_BYTES)))
        self.stored = json.loads(options.get("stored", "[]"))
        self.started = False

    def initialOffset(self) -> dict:
        if self.stored:  # no checkpoint of Spark's, but a store that knows the path
            from loghelm.sources.recovery import resume

            found = resume([Origin(**o) for o in self.stored], self.follower.path, self.follower.zero_replay)
            if found.status == "ready":
                self.follower.load({"origins": [asdict(o) for o in found.origins]})
                self.started = True
                return self.follower.save()
        self.follower.bootstrap()
        self.started = True
        return self.follower.save()

    def latestOffset(self) -> dict:
        if self.started:
            self.follower.poll()
            self.follower.advance()
        return self.follower.save()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if not self.started:  # after a restart the log of offsets is the state
            self.follower.load(end)
            self.started = True
        before = {o["origin_id"]: o for o in start["origins"]}
        out = []
        for o in end["origins"]:
            old = before.get(o["origin_id"])
            if old is None or any(old[k] != o[k] for k in MARKED):
                out.append(Range(old["offset"] if old else 0, Origin(**o)))
        return out

    def read(self, partition: Range):
        o = partition.origin
        if o.offset > partition.begin:
            for start, end, raw, error in records(open_origin(o), partition.begin, o.offset):
                yield self.source_id, o.origin_id, start, end, self.instance, raw, error, None
        yield self.source_id, o.origin_id, o.offset, o.offset, self.instance, None, "", json.dumps(asdict(o))

    def commit(self, end: dict) -> None:
        """Positions live in Spark's own log of offsets."""


