"""Opaque positions and identities handed to clients: exact codecs, nothing inside is trusted."""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass

from loghelm.schema import RefusedError


def _out(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _in(text: str, code: str) -> bytes:
    try:
        raw = base64.b64decode(text.encode("ascii") + b"=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except (ValueError, UnicodeError):
        raise RefusedError(code) from None
    if _out(raw) != text:  # one spelling only
        raise RefusedError(code)
    return raw


@dataclass(frozen=True)
class SearchCursor:
    """Version byte, digest of the question (32), instant and row id: 49 bytes, 66 characters."""

    question: bytes
    time_utc_ns: int
    event_id: int

    def encode(self) -> str:
        return _out(b"\x01" + self.question + struct.pack(">qq", self.time_utc_ns, self.event_id))

    @classmethod
    def decode(cls, text: str) -> SearchCursor:
        raw = _in(text, "invalid_cursor") if len(text) == 66 else b""
        if len(raw) != 49 or raw[0] != 1:
            raise RefusedError("invalid_cursor")
        t, i = struct.unpack(">qq", raw[33:])
        if i < 1:
            raise RefusedError("invalid_cursor")
        return cls(raw[1:33], t, i)


@dataclass(frozen=True)
class CandidateId:
    """Version byte, revision (32), generation (4), length of the instance (1), then both names."""

    revision: str
    generation: int
    instance: str
    queue_id: str

    def encode(self) -> str:
        name = self.instance.encode()
        if not 0 < len(name) < 256:
            raise RefusedError("invalid_candidate")
        return _out(b"\x01" + bytes.fromhex(self.revision) + struct.pack(">IB", self.generation, len(name)) + name + self.queue_id.encode())

    @classmethod
    def decode(cls, text: str) -> CandidateId:
        raw = _in(text, "invalid_candidate")
        if len(raw) < 40 or raw[0] != 1:
            raise RefusedError("invalid_candidate")
        generation, n = struct.unpack(">IB", raw[33:38])
        try:
            instance, queue = raw[38 : 38 + n].decode(), raw[38 + n :].decode()
        except UnicodeError:
            raise RefusedError("invalid_candidate") from None
        if not instance or len(instance.encode()) != n or not queue:
            raise RefusedError("invalid_candidate")
        return cls(raw[1:33].hex(), generation, instance, queue)


def timeline_cursor(candidate: str, raw_mode: bool, position: int) -> str:
    """Version and mode bytes bound to the candidate by digest, and a position: 35 bytes."""
    bound = hashlib.sha256(b"loghelm-timeline" + bytes([raw_mode]) + candidate.encode()).digest()[:29]
    return _out(bytes([1, raw_mode]) + bound + struct.pack(">I", position))


def timeline_position(text: str, candidate: str, raw_mode: bool) -> int:
    raw = _in(text, "invalid_cursor")
    if len(raw) != 35 or timeline_cursor(candidate, raw_mode, struct.unpack(">I", raw[31:])[0]) != text:
        raise RefusedError("invalid_cursor")
    return struct.unpack(">I", raw[31:])[0]
