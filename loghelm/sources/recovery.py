"""Taking a followed path up again from what a store holds of it: all of its origins, or none.

The stream keeps its position in Spark's checkpoint. Where that is lost, or another engine goes
on, the origins and checkpoints of the store say how far each generation was committed. Every
generation that was followed must be found, each at one file of its own and verified, before any
is read on: taking up some of them would leave a gap that nothing tells of. What stands against it
is reported for all of them together. An origin whose lifecycle is unknown blocks, until it is
settled on request.
"""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass, replace

from loghelm.schema import RefusedError
from loghelm.sources.follow import FAILURES, MAX_ENTRIES, MAX_OPEN, Origin, Verdict, verify


@dataclass(frozen=True)
class Trouble:
    origin_id: str
    code: str
    reason: str


class ResumeError(RefusedError):
    """The gravest trouble gives the code; `parts` has all of them."""

    def __init__(self, parts: list[Trouble]):
        self.parts = sorted(parts, key=lambda p: (FAILURES.index(p.code), p.origin_id))
        super().__init__(self.parts[0].code, "; ".join(f"{p.origin_id or 'path'} {p.code} ({p.reason})" for p in self.parts))


@dataclass(frozen=True)
class Resume:
    """absent: nothing is followed, so a fresh start is right. ready: `origins` with the path each
    has now, the oldest first. `current` tells whether the path is one of them (known) or new."""

    status: str
    origins: tuple[Origin, ...] = ()
    current: str = ""


def stored_origins(store, source_id: str) -> list[Origin]:
    """The origins of a source that are not retired, MAX_ENTRIES at most, with their checkpoints."""
    from pyspark.sql import functions as F

    rows = store.origins().where((F.col("source_id") == source_id) & (F.col("state") != "retired")).orderBy("origin_id").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise RefusedError("limit_reached", f"more than {MAX_ENTRIES} origins of {source_id}")
    return [Origin(r["origin_id"], r["path"], r["device"], r["inode"], r["prefix"] or "", r["offset"] or 0, r["anchor"] or "", r["state"]) for r in rows]


def _files(folder: str) -> list[str]:
    """Regular files of a folder that may be generations; RefusedError beyond MAX_ENTRIES entries."""
    out = []
    with os.scandir(folder) as entries:
        for n, entry in enumerate(entries):
            if n >= MAX_ENTRIES:
                raise RefusedError("limit_reached", folder)
            if entry.is_file(follow_symlinks=False) and not entry.name.endswith(".gz"):
                out.append(entry.path)
    return sorted(out)


def _trouble(o: Origin, verdicts: dict[str, Verdict]) -> Trouble | None:
    """Why an origin can't be taken up at just one file, if so."""
    said = {kind: [v.reason for v in verdicts.values() if v.kind == kind] for kind in ("match", "restart_zero", "insufficient", "different")}
    if len(said["match"]) + len(said["restart_zero"]) == 1:
        return None
    if said["match"] or said["restart_zero"]:
        return Trouble(o.origin_id, "decision", "ambiguous")
    if said["insufficient"]:
        return Trouble(o.origin_id, "decision", said["insufficient"][0])
    changed = [r for r in said["different"] if r != "physical_identity_changed"]  # the file itself, but not its content
    return Trouble(o.origin_id, "content_changed", changed[0]) if changed else Trouble(o.origin_id, "gap", "physical_identity_unavailable")


def resume(origins: list[Origin], path: str, zero_replay: bool = False) -> Resume:
    """How the path is taken up again, or ResumeError. `zero_replay` lets one origin at the path
    itself start again from 0, if its first bytes are the same."""
    followed = [o for o in origins if o.state == "following"]
    parts = [Trouble(o.origin_id, "decision", "lifecycle_unknown") for o in origins if o.state == "unknown"]
    parts += [Trouble(o.origin_id, "decision", "invalid_state") for o in origins if o.state not in ("unknown", "following", "retired")]
    if len(followed) > MAX_OPEN:
        parts.append(Trouble("", "capacity", f"{len(followed)} followed"))
    if parts:
        raise ResumeError(parts)
    if not followed:
        return Resume("absent")
    files = _files(os.path.dirname(os.path.abspath(path)))
    zero = zero_replay and len(followed) == 1
    found: dict[str, str] = {}
    for o in followed:
        verdicts = {f: verify(o, f, zero and os.path.abspath(f) == os.path.abspath(path)) for f in files}
        bad = _trouble(o, verdicts)
        if bad:
            parts.append(bad)
            continue
        found[o.origin_id] = next(f for f, v in verdicts.items() if v.kind in ("match", "restart_zero"))
    for file in {f for f in found.values() if list(found.values()).count(f) > 1}:
        parts += [Trouble(k, "decision", "ambiguous") for k, f in found.items() if f == file]
    try:
        s = os.stat(path, follow_symlinks=False)
        now = (s.st_dev, s.st_ino) if stat.S_ISREG(s.st_mode) else None
    except FileNotFoundError:
        now = None
    known = [o for o in followed if (o.device, o.inode) == now]
    if now is None:
        parts.append(Trouble("", "missing", path))
    elif not known and len(followed) >= MAX_OPEN:
        parts.append(Trouble("", "capacity", "the path is a further file"))
    if parts:
        raise ResumeError(parts)
    order = sorted(followed, key=lambda o: (o in known, os.stat(found[o.origin_id]).st_mtime_ns, o.origin_id))
    return Resume("ready", tuple(replace(o, path=found[o.origin_id]) for o in order), "known" if known else "new")


def settle_unknown(store, source_id: str, path: str, origin_id: str) -> bool:
    """Makes an origin of unknown lifecycle followed, on request, if it is the only one of its source
    that is not retired and the file at the path is verified to be it. True if that changed it;
    one that is followed already is only verified. Positions and facts are not touched."""
    if not origin_id:
        raise RefusedError("invalid_origin")
    open_ = stored_origins(store, source_id)
    if any(o.state not in ("unknown", "following") for o in open_):
        raise RefusedError("decision", "invalid_state")
    if not open_:
        raise RefusedError("decision", "absent")
    if len(open_) > 1 or open_[0].origin_id != origin_id:
        raise RefusedError("decision", "conflict")
    o = open_[0]
    verdict = verify(replace(o, state="following"), path, zero_replay=True)
    if verdict.kind not in ("match", "restart_zero"):
        raise ResumeError([Trouble(o.origin_id, "decision" if verdict.kind == "insufficient" else "content_changed", verdict.reason)])
    if o.state == "following":
        return False
    from loghelm.store.facts_store import ORIGINS

    row = (source_id, o.origin_id, o.path, o.device, o.inode, o.prefix, "following")
    store.commit(origins=store.spark.createDataFrame([row], ORIGINS))
    return True
