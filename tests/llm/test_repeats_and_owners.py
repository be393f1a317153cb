"""Samples and verdicts where rows, ids or owners repeat, and the whole pipeline on awkward tables."""

import zlib

import pytest

import corpus_pipeline
from loghelm.llm import language_id
from loghelm.llm.language_id import identify_language, learn_languages
from loghelm.llm.quality import quality_scores
from loghelm.llm.secret_scan import redact_secrets, secret_scan
from tests.llm.test_small_operators import AWKWARD, DOCS, docs

KEYS = ["ghp_" + x * 10 for x in ("Ab3", "Zy9", "Qw7", "Mn5")]


def test_a_key_of_one_owner_is_live_however_often_it_occurs(spark):
    rows = [(i, f"{i} {KEYS[0]} end", "one") for i in range(120)]
    rows += [(200 + i, f"{i} {KEYS[1]} end", f"s{i % 2}") for i in range(120)]  # two owners, many repositories
    rows += [(400 + i, f"{i} {KEYS[2]} end", f"s{i}") for i in range(3)]  # three owners
    rows += [(500 + i, f"{i} {KEYS[3]} end", f"s{i % 2}") for i in range(20)]  # two owners, few repositories
    df = docs(spark, rows)
    spans = {r.doc_id: (r.spans != "", r.n_live) for r in secret_scan(df).collect()}
    for i, *_ in rows:
        assert spans[i] == ((True, 1) if i < 200 or i >= 500 else (False, 0))
    texts = {r.doc_id: r.text for r in redact_secrets(df).collect()}
    assert all(("<secret>" in t) == (i < 200 or i >= 500) for i, t in texts.items())


@pytest.mark.parametrize("doc_id", [i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 4 != 2][:3])
def test_equal_rows_keep_their_language_and_are_drawn_once(spark, monkeypatch, doc_id):
    french = (doc_id, "le chat est sur la table et il dort bien", "fr")
    rows = [french] * 300 + [(i, f"der Hund {i} liegt unter dem Tisch und schläft gut", "de") for i in range(1000, 1200)]
    df = spark.createDataFrame([(i, t, lang, None, None, None, None) for i, t, lang in rows], DOCS)
    seen = []
    monkeypatch.setattr(language_id, "_clusters", lambda x, k, old=language_id._clusters: (seen.append(len(x)), old(x, k))[1])
    model = learn_languages(df, per_language=20)
    assert sorted(set(model.language)) == ["de", "fr"] and 1 in seen and max(seen) < 60
    got = identify_language(spark.createDataFrame([(9, "la table est bien", None, None, None, None, None)], DOCS), model).first()
    assert got.lang_pred == "fr"


def test_the_scorer_learns_the_same_rows_each_time(spark):
    rows = [(i % 40, f"text number {i} of the table. " * (i % 9 + 1), None) for i in range(400)]
    got = [sorted(map(repr, quality_scores(docs(spark, order), train_rows=25).collect())) for order in (rows, rows[::-1])]
    assert got[0] == got[1]


@pytest.mark.parametrize("kind", ["awkward", "empty", "nulls"])
def test_the_whole_pipeline_on_awkward_tables(spark, tmp_path, kind):
    rows = {"awkward": [*AWKWARD, *[(20 + i, "five words that are copied here again", f"s{i}") for i in range(4)]], "empty": [], "nulls": [(None, None)] * 3}[kind]
    table = spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    if kind == "empty":
        assert out == []
    if kind == "awkward":
        assert {1, 2, 4, 5} <= ids and len(ids & {20, 21, 22, 23}) == 1 and sum(r.doc_id == 3 for r in out) == 1
    for r in out:
        assert r.length >= 1 and r.offset >= 0
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert used.setdefault(r.sequence_id, 0) == r.offset
        used[r.sequence_id] += r.length
    assert all(n <= 2048 for n in used.values())
