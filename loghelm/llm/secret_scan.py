"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every whole text is searched for the three base kinds (assign, access, hex) and for further
candidates: tokens with a vendor's prefix, private-key headers, and long tokens that mix upper
case, lower case and digits. The value of each candidate is hashed, and the hashes are counted
over the corpus by distinct repositories (documents) and owners (sources). A value that at
least `copied_owners` owners have, or two owners in at least `copied_repositories` repositories,
is a widely copied example; any other looks live, however often its one owner repeats it. Further candidates become spans only where they look live and lie
outside the base spans; base spans always stay, and are told apart in the columns n_live and
n_copied.

Positions come from the pieces between matches: regexp_extract_all gives the matches from left
to right, split the pieces, and running sums of their lengths the places in code points. Lists
are folded in chunks of CHUNK, so that a text of very many matches costs time in proportion.

Hot values: counts are aggregated before every shuffle, and the join of a value's verdict to
its documents is salted, so a value in a third of all documents fills no single task.

Defined cases: null and empty texts have no spans; a null source is an owner of its own;
repeated rows each give a row, and count as one repository; an empty table gives none; other
columns, of any name, are ignored by secret_scan and kept by redact_secrets. Rows are told apart by
128 bits of hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Scratch, text_or_empty, whole_row

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: tokens with a vendor's prefix, key headers, and long tokens (kept only if they mix classes)
VENDOR = r"(?:gh[opsu]_|github_pat_|glpat-|[rs]k_live_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_.-]{16,}"
MORE = VENDOR + r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/_-]{32,}"
KINDS = ("assign", "access", "hex", "more")
SALTS = 16
CHUNK = 256
BROADCAST_ROWS = 50_000
SPAN = "struct<start:bigint,kind:int,stop:bigint,value:bigint,width:int>"


def _fold(items: Column, state: Column, step) -> Column:
    """The outputs that are not null of step(state, item) -> (state, output), item by item; states
    are bigints, outputs spans. Chunk by chunk, as each append copies what it appends to."""
    none = F.array().cast(f"array<{SPAN}>")
    chunk = lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)), chunk)

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        out = out.cast(SPAN)
        return F.struct(after.cast("bigint").alias("state"), F.when(out.isNotNull(), F.concat(acc["outs"], F.array(out))).otherwise(acc["outs"]).alias("outs"))

    def many(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("outs")), one)
        return F.struct(inner["state"].alias("state"), F.concat(acc["lists"], F.array(inner["outs"])).alias("lists"))

    zero = F.struct(state.cast("bigint").alias("state"), F.array().cast(f"array<array<{SPAN}>>").alias("lists"))
    return F.aggregate(chunks, zero, many, lambda acc: F.flatten(acc["lists"]))


def _found(text: Column, kind: int, pattern: str, group: int, keep) -> Column:
    """Spans of one kind from left to right, where keep(value) holds."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), match.alias("match"), value.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), stop.cast("bigint").alias("stop"), F.xxhash64(x["value"]).alias("value"), F.length(x["value"]).alias("width"))
        return stop, F.when(x["match"].isNotNull() & keep(x["value"]), span)

    return F.when(text.rlike(pattern), _fold(parts, F.lit(0), step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _outside(more: Column, base: Column) -> Column:
    """The spans of more that overlap none of base: no base span that starts before or where one
    starts ends after its start, and none that starts later starts before its end."""
    is_base = lambda x: x["kind"] < 3
    before = _fold(F.array_sort(F.concat(base, more)), F.lit(0), lambda stop, x: (F.when(is_base(x), F.greatest(stop, x["stop"])).otherwise(stop), F.when(is_base(x) | (x["start"] >= stop), x)))
    after = _fold(F.reverse(before), F.lit(1 << 62), lambda start, x: (F.when(is_base(x), x["start"]).otherwise(start), F.when(~is_base(x) & (x["stop"] <= start), x)))
    return F.when((F.size(more) > 0) & (F.size(base) > 0), F.reverse(after)).otherwise(more)


def _telling(value: Column) -> Column:
    """Whether a further candidate counts: with a vendor's prefix, also inside a longer token, and
    as a key header always; any other long token if it mixes classes."""
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return mixed | value.startswith("-----BEGIN") | value.rlike("(?:^|[+/_-])" + VENDOR)


def with_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """secret_base and secret_more (arrays of spans), secret_row (key), secret_owner of every row."""
    text = text_or_empty(text_col)
    base = F.concat(_found(text, 0, ASSIGN, 2, lambda v: F.length(v) >= 6), _found(text, 1, ACCESS, 0, lambda v: F.lit(True)), _found(text, 2, HEX, 0, lambda v: F.lit(True)))
    return docs.select(row_key(id_col, text_col).alias("secret_row"), F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")).alias("secret_owner"), F.array_sort(base).alias("secret_base"), _found(text, 3, MORE, 0, _telling).alias("secret_more"), F.col(id_col).alias("secret_id"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text."""
    text = text_or_empty(text_col)
    return F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(text, F.col(id_col), F.lit(1)).alias("b"))


def _stored(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """with_candidates, written before it is read more than once: each reading would search all texts."""
    out = Scratch(docs.sparkSession).keep(with_candidates(docs, id_col, text_col, source_col))
    return out.withColumn("secret_more", _outside(F.col("secret_more"), F.col("secret_base")))


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners for each candidate's hash, aggregated level by level."""
    spans = found.where((F.size("secret_base") > 0) | (F.size("secret_more") > 0))
    one = spans.select("secret_row", "secret_owner", F.explode(F.array_distinct(F.transform(F.concat("secret_base", "secret_more"), lambda s: s["value"]))).alias("value"))
    one = one.groupBy("value", "secret_owner", "secret_row").agg(F.lit(1).alias("n"))
    own = one.groupBy("value", "secret_owner").agg(F.count(F.lit(1)).alias("repositories"))
    return own.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def with_spans(found: DataFrame, copied_owners: int = 3, copied_repositories: int = 100) -> DataFrame:
    """Adds secret_copied (hashes of widely copied values) and secret_spans (spans to report)."""
    copied = ownership(found).where((F.col("owners") >= copied_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= copied_repositories))).select("value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spans = found.where((F.size("secret_base") > 0) | (F.size("secret_more") > 0))
    pairs = spans.select("secret_row", F.explode(F.array_distinct(F.transform(F.concat("secret_base", "secret_more"), lambda s: s["value"]))).alias("value"))
    pairs = pairs.withColumn("salt", F.pmod("secret_row.a", F.lit(SALTS)).cast("int"))
    per_row = pairs.join(copied, ["value", "salt"]).groupBy("secret_row").agg(F.collect_set("value").alias("secret_copied"))
    out = found.join(per_row, "secret_row", "left").withColumn("secret_copied", F.coalesce("secret_copied", F.array().cast("array<bigint>")))
    live = F.filter("secret_more", lambda s: ~F.array_contains(F.col("secret_copied"), s["value"]))
    return out.withColumn("secret_spans", F.array_sort(F.concat("secret_base", live)))


def _told(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))))


def secret_scan(docs: DataFrame, copied_owners: int = 3, copied_repositories: int = 100, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    out = with_spans(_stored(docs, id_col, text_col, source_col), copied_owners, copied_repositories)
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    n_copied = F.size(F.filter("secret_spans", lambda s: F.array_contains(F.col("secret_copied"), s["value"]))).cast("long")
    return out.select(
        F.col("secret_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told(F.col("secret_base")), 256).alias("base_sha256"),
        _told(F.col("secret_spans")).alias("spans"),
        (F.size("secret_spans") - n_copied).cast("long").alias("n_live"),
        n_copied.alias("n_copied"),
    )


def redact_secrets(docs: DataFrame, copied_owners: int = 3, copied_repositories: int = 100, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the live-looking spans replaced by <secret>; widely copied examples stay.

    Same rows and columns; n_chars, where there is one, follows the new text.
    """
    scratch = Scratch(docs.sparkSession)
    found = _stored(docs, id_col, text_col, source_col).where((F.size("secret_base") > 0) | (F.size("secret_more") > 0))
    live = F.filter("secret_spans", lambda s: ~F.array_contains(F.col("secret_copied"), s["value"]))
    cuts = with_spans(found, copied_owners, copied_repositories).select("secret_row", live.alias("secret_live")).where(F.size("secret_live") > 0)
    cuts = scratch.keep(cuts.groupBy("secret_row").agg(F.first("secret_live").alias("secret_live")))
    if cuts.count() <= BROADCAST_ROWS:  # spans of a checked number of rows; beyond it, both sides are shuffled
        cuts = F.broadcast(cuts)
    text = F.col("secret_text")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        # a span that overlaps the one before only extends what is cut
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).cast("bigint").alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit("<secret>")))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    out = docs.select(whole_row(docs).alias("row"), F.col(text_col).alias("secret_text"), row_key(id_col, text_col).alias("secret_row")).join(cuts, "secret_row", "left")
    cut = F.coalesce(F.size("secret_live") > 0, F.lit(False))
    out = out.select("row", cut.alias("secret_cut"), F.when(cut, F.aggregate("secret_live", zero, step, rest)).otherwise(text).alias("secret_new"))
    made = {text_col: F.col("secret_new")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        made["n_chars"] = F.when(F.col("secret_cut"), F.length("secret_new")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in docs.columns])
