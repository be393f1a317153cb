"""Grammars and codecs as column expressions, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


def is_queue_id(c: Column) -> Column:
    """3 to 32 ASCII letters and digits, with a digit or upper-case hexadecimal letters only."""
    return c.rlike(r"\A(?=.{3,32}\z)(?:[A-F]+|[A-Za-z0-9]*[0-9][A-Za-z0-9]*)\z")


def is_field_key(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z][A-Za-z0-9_-]{0,31}\z")


def normal_domain(c: Column) -> Column:
    """The lower-cased ASCII domain, or NULL where the text is none."""
    return F.when((F.length(c) <= 253) & c.rlike(rf"\A{_LABEL}(?:\.{_LABEL})*\z"), F.lower(c))


def address_domain(c: Column) -> Column:
    """The domain of a plain address: one @, not first, no blank, control, bracket or quote."""
    plain = (F.regexp_count(c, F.lit("@")) == 1) & ~c.startswith("@") & ~c.rlike(r'(?U)[\s\p{Cntrl}<>"]')
    return F.when(plain, normal_domain(F.substring_index(c, "@", -1)))


def literal_client(c: Column) -> Column:
    """An exact host[address] token, or ''."""
    good = c.rlike(r"\A[^\[]+\[.+\]\z") & ~c.rlike(r"[ \t\r\n;\x00]")
    return F.when(good, c).otherwise(F.lit(""))


def wire_value(c: Column) -> Column:
    """struct<encoding, value>: the text itself if it is UTF-8, else its base64."""
    raw = c.cast("binary")
    ok = F.is_valid_utf8(c)
    return F.when(c.isNotNull(), F.struct(F.when(ok, F.lit("utf8")).otherwise(F.lit("base64")).alias("encoding"), F.when(ok, c.cast("string")).otherwise(F.base64(raw)).alias("value")))


def framed(*parts: Column) -> Column:
    """Parts joined with their byte lengths (8 bytes, big-endian), for digests that can't alias."""
    out = []
    for p in parts:
        raw = F.coalesce(p.cast("string"), F.lit("")).cast("binary")
        # absent and empty differ: a NULL is framed with a length of all ones
        size = F.when(p.isNull(), F.lit("F" * 16)).otherwise(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0"))
        out += [F.unhex(size), raw]
    return F.concat(*out)


def import_origin_id(source_id: Column, sha256: Column) -> Column:
    """Identity of imported content: same source and same bytes give the same origin."""
    return F.concat(F.lit("import-v1:"), F.sha2(framed(F.lit("import-origin"), source_id, sha256), 256))


def fits_nanoseconds(seconds: Column) -> Column:
    """Whether an instant in decimal seconds fits 64-bit nanoseconds."""
    ns = seconds.cast("decimal(38,9)") * F.lit(10**9)
    return (ns >= F.lit(-(2**63)).cast("decimal(38,0)")) & (ns <= F.lit(2**63 - 1).cast("decimal(38,0)"))
