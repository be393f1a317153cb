"""The queries op1_ to op13_ over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.llm.bitslice_topk import bitsliced_topk
from loghelm.llm.common import Scratch
from loghelm.llm.conversation_repair import repair_digests
from loghelm.llm.language_id import identify_language, learn_languages
from loghelm.llm.ngram_join import with_classes
from loghelm.llm.packing import pack_documents
from loghelm.llm.periodic_runs import periodic_runs, planted, run_digests
from loghelm.llm.permutation_ann import permutation_ann
from loghelm.llm.quality import quality_scores
from loghelm.llm.secret_scan import secret_scan
from loghelm.llm.source_mix import mix_sources
from loghelm.llm.suffix_dedup import suffix_dedup
from loghelm.llm.toxicity import learn_grammar, toxicity_scores
from loghelm.llm.warc import archive_digests, read_warc, write_warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(_table(spark, sf_dir, "documents"), width=4, num=85, den=100).drop("class_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"))


def op4_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn_grammar(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_language(docs, learn_languages(docs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), need=200).drop("spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).root
    write_warc(_table(spark, sf_dir, "pages"), folder)
    return archive_digests(read_warc(spark, folder, payloads=False))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(_table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(planted(_table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bitslice_topk, op2_ngram_join, op3_quality, op4_permutation_ann, op5_source_mix, op6_toxicity, op7_language_id, op8_suffix_dedup, op9_packing, op10_secrets, op11_warc, op12_conversation_repair, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_bitslice_topk": OP1_SQL, "op2_ngram_join": OP2_SQL, "op11_warc": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_periodic_runs": OP13_SQL}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


OP11_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), m AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) END AS top FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    fed = f"list_reduce(range(8), lambda c, k: {step}, xor(b, CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda b, x: {fed}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _edited(state: str, cost: int | str, letter: str, line: str) -> str:
    """A state's text (cost of 9 digits, audit, chr(1), lines) with an edit before it."""
    at = f"instr({state}, chr(1))"
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({state}, 10, {at} - 9) || {line} || substr({state}, {at} + 1)"


def _repair_step_sql() -> tuple[str, str]:
    """(the four states after the options of a turn, and after turns inserted before it)."""
    keeps = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    free, role = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    kept_line, end = "role || ':' || text || chr(10)", "chr(10)"
    taken, opened = [], []
    for q in range(4):
        options = [_edited(f"s{q}", 3, "D", "''")]
        options += [f"CASE WHEN NOT gone AND initial = '{c}' THEN {_edited(f's{to}', 'cut', 'K', kept_line)} END" for c, to in keeps[q].items()]
        now = role[free[q]] + ":"
        options.append(f"CASE WHEN NOT gone THEN {_edited(f's{free[q]}', '2 + cut', 'R', f"'{now}' || text || {end}")} END")
        taken.append(f"least({', '.join(options)}) AS s{q}")
        once = _edited(f"s{free[q]}", 2, "I", f"'{now}' || {end}")
        second = free[free[q]]
        twice = _edited(f"({_edited(f's{second}', 2, 'I', f"'{role[second]}:' || {end}")})", 2, "I", f"'{now}' || {end}")
        opened.append(f"least(s{q}, {once}, {twice}) AS s{q}")
    return ", ".join(taken), ", ".join(opened)


_TAKEN, _OPENED = _repair_step_sql()
_TRIMMED = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP12_SQL = f"""
WITH RECURSIVE src AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h
  FROM conversations
), damaged AS (
  SELECT g, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), placed AS (
  SELECT g, turn, role, text, i, left(role, 1) AS initial, right({_TRIMMED}, 1) AS ending,
         row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS seen
  FROM ordered
), faults AS (
  SELECT *, ending = '' AS blank, ending <> '' AND seen > 1 AS again,
         CASE WHEN ending NOT IN ('', '.', '!', '?') AND seen = 1 THEN 1 ELSE 0 END AS cut, ending = '' OR seen > 1 AS gone,
         lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair
  FROM placed
), told AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY g
), walk AS (
  SELECT g, n AS i, '000000000' || chr(1) AS s0, '000000004II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) AS s1,
         '000000002I' || chr(1) || 'assistant:' || chr(10) AS s2, '000000000' || chr(1) AS s3
  FROM told
  UNION ALL
  SELECT g, i, {_OPENED}
  FROM (SELECT w.g, w.i - 1 AS i, {_TAKEN} FROM walk w JOIN faults f ON f.g = w.g AND f.i = w.i WHERE w.i >= 1)
), done AS (
  SELECT g, CAST(left(s0, 9) AS BIGINT) AS cost, substr(s0, 10, instr(s0, chr(1)) - 10) AS audit, substr(s0, instr(s0, chr(1)) + 1) AS lines
  FROM walk WHERE i = 0
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(lines, '') = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM src) o LEFT JOIN told ON told.g = o.g LEFT JOIN done ON done.g = o.g
"""

OP13_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM t
), v AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
      THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END])
      ELSE w END AS w
  FROM m
), s AS (SELECT row, n, unnest(range(n)) AS i, unnest(w) AS x FROM v),
p AS (
  SELECT a.row, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.row = b.row AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), g AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS isle FROM p),
e AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY row, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT row, start, length, min(q) AS period FROM e GROUP BY row, start, length),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT s.row, string_agg(x, ' ' ORDER BY s.i) AS text FROM s ANTI JOIN gone ON s.row = gone.row AND s.i = gone.i GROUP BY s.row),
best AS (
  SELECT x.* FROM r x WHERE NOT EXISTS (
    SELECT 1 FROM r y WHERE y.row = x.row AND (y.length * x.period > x.length * y.period
      OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period)))))
), told AS (
  SELECT row, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY row
)
SELECT v.doc_id, coalesce(told.n, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(told.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM v LEFT JOIN told ON told.row = v.row LEFT JOIN best ON best.row = v.row LEFT JOIN kept ON kept.row = v.row
"""
