"""Settings from a bounded, strict subset of YAML: nested mappings of plain or quoted scalars.

No anchors, aliases, tags, lists, flow style or documents; no key twice; no unknown key; no value
of another type than the setting's. What is absent keeps its default; what is empty is refused.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

from loghelm.schema import RefusedError

MAX_BYTES = 64 * 1024
MAX_DEPTH = 4
MAX_NODES = 128
_LINE = re.compile(r"( *)([A-Za-z_][A-Za-z0-9_]*):(?: +(.*\S))? *\Z")
_UNIT_NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_DURATION = re.compile(r"(?:\d+(?:\.\d+)?(?:ns|us|ms|s|m|h))+\Z")


@dataclass(frozen=True)
class Source:
    id: str
    path: str
    name: str = ""
    start_at: str = "beginning"
    poll_interval: int = 10**9
    rotation_grace: int = 30 * 10**9
    resume_origins: int = 1000
    resume_entries: int = 1000


@dataclass(frozen=True)
class Config:
    storage: dict = field(default_factory=lambda: {"path": "loghelm-store"})
    source: Source | None = None


def invalid(where: str, rule: str) -> RefusedError:
    return RefusedError("invalid_configuration", f"{where}: {rule}")


def mapping(text: str) -> dict:
    """The document as nested dicts of strings."""
    if len(text.encode()) > MAX_BYTES:
        raise invalid("document", "more than 64 KiB")
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    opened: tuple[int, dict, str] | None = None
    nodes = 0
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _LINE.match(line)
        if not m or "\t" in line:
            raise invalid("document", "expected a mapping")
        indent, key, value = len(m[1]), m[2], m[3]
        nodes += 2
        if opened and indent > opened[0]:
            stack.append((indent, opened[1].setdefault(opened[2], {})))
        elif opened:
            raise invalid(opened[2], "empty value")
        while stack[-1][0] > indent:
            stack.pop()
        if len(stack) > 1 and stack[-1][0] != indent or len(stack) == 1 and indent:
            raise invalid(key, "indentation")
        if len(stack) > MAX_DEPTH or nodes > MAX_NODES:
            raise invalid("document", "structure exceeds supported bounds")
        here = stack[-1][1]
        if key in here:
            raise invalid(key, "repeated key")
        opened = None
        if value is None:
            opened = (indent, here, key)
            continue
        quoted = re.fullmatch(r'"([^"\\]*)"|\'([^\']*)\'', value)
        plain = re.split(r" +#", value)[0]
        if not quoted and (plain[:1] in "&*!|>[]{}%@`\"'" or plain in ("null", "~") or ": " in plain):
            raise invalid(key, "unsupported value")
        here[key] = quoted[1] if quoted and quoted[1] is not None else quoted[2] if quoted else plain
    if opened:
        raise invalid(opened[2], "empty value")
    return out


def duration_ns(where: str, text: str) -> int:
    if not _DURATION.match(text):
        raise invalid(where, "expected a duration")
    return round(sum(float(n) * _UNIT_NS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text)))


def decode(text: str, base_dir: str) -> Config:
    if not os.path.isabs(base_dir):
        raise invalid("configuration", "expected an absolute base directory")
    said = mapping(text)
    if set(said) - {"storage", "source"} or not all(isinstance(v, dict) for v in said.values()):
        raise invalid("document", "unknown field")
    c = Config()
    if "storage" in said:
        if set(said["storage"]) != {"path"} or not isinstance(said["storage"]["path"], str) or not said["storage"]["path"].strip():
            raise invalid("storage", "expected a path")
        c = replace(c, storage=dict(said["storage"]))
    c.storage["path"] = os.path.join(base_dir, c.storage["path"])
    if "source" in said:
        c = replace(c, source=_source(said["source"], base_dir))
    return c


def _source(said: dict, base_dir: str) -> Source:
    kinds = {"id": str, "name": str, "path": str, "start_at": str, "poll_interval": "duration", "rotation_grace": "duration", "resume_origins": int, "resume_entries": int}
    got = {}
    for key, value in said.items():
        if key not in kinds or not isinstance(value, str):
            raise invalid("source", "unknown field")
        if kinds[key] == "duration":
            got[key] = duration_ns(f"source.{key}", value)
        elif kinds[key] is int:
            if not re.fullmatch(r"[1-9]\d{0,8}", value):
                raise invalid(f"source.{key}", "expected a positive whole number")
            got[key] = int(value)
        else:
            got[key] = value
    if not got.get("id", "").strip() or not got.get("path", "").strip():
        raise invalid("source", "id and path are required")
    s = Source(**got)
    if s.start_at not in ("beginning", "end"):
        raise invalid("source.start_at", "expected beginning or end")
    if not 10 * 10**6 <= s.poll_interval <= 60 * 10**9:
        raise invalid("source.poll_interval", "expected 10 ms to 1 m")
    if not 10 * 10**6 <= s.rotation_grace <= 24 * 3600 * 10**9:
        raise invalid("source.rotation_grace", "expected 10 ms to 24 h")
    return replace(s, path=os.path.join(base_dir, s.path))


def load(path: str) -> Config:
    with open(path, "rb") as f:
        raw = f.read(MAX_BYTES + 1)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        raise invalid("document", "expected UTF-8") from None
    return decode(text, os.path.dirname(os.path.abspath(path)))
