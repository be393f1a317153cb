"""Runs of words against a plain scan of every period."""

import hashlib
import random
import re
import zlib

import pytest

from loghelm.llm.periodic_runs import SuffixTree, batch_runs, periodic_runs, planted, run_digests
from tests.llm.test_small_operators import AWKWARD, docs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    kinds, n = rng.randrange(1, 5), rng.randrange(0, 140)
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a, q = rng.randrange(n), rng.randrange(1, 9)
            for i in range(a + q, min(n, a + q * rng.randrange(1, 12))):
                words[i] = words[i - q]
    return [b"w%d" % w for w in words]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_runs_of_many_texts(least, exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        got = list(zip(*[x.tolist() for x in batch_runs(texts, least, exponent)], strict=True))
        assert got == [(i, *run) for i, words in enumerate(texts) for run in plain_runs(words, least, exponent)]


def test_branching_repeats_end_where_a_run_ends_and_are_few():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        word = [rng.randrange(2) for _ in range(60)]
        tree = SuffixTree(np.asarray(word), np.full(60, 60))
        got = [(int(s), int(q)) for a, b in tree.branching_repeats() for s, q in zip(a, b, strict=True)]
        squares = [(i, q) for q in range(1, 31) for i in range(61 - 2 * q) if word[i : i + q] == word[i + q : i + 2 * q] and (i + 2 * q == 60 or word[i + 2 * q] != word[i + q])]
        assert sorted(got) == sorted(squares) and len(got) == len(set(got))
        first, cut, last = tree.nodes()
        assert np.minimum(cut - first, last - cut).sum() <= 60 * np.log2(60)


def test_one_word_repeated_and_a_long_periodic_text():
    assert batch_runs([[b"a"] * 50_000], 6, 4)[1:] == tuple(pytest.approx([x]) for x in (0, 50_000, 1))
    words = [b"%d" % (i % 4_999) for i in range(40_000)]
    assert [x.tolist() for x in batch_runs([words], 6, 4)] == [[0], [0], [40_000], [4_999]]


def test_rows_of_awkward_tables(spark):
    rng = random.Random(5)
    rows = [*AWKWARD, *[(10 + i, " \t".join(w.decode() for w in some_words(rng))) for i in range(60)], (90, "  ".join(["a", "b"] * 9)), (91, "x\x1cy " * 9)]
    rows += [(i, "one two three four five " * 12) for i in range(100, 160)]
    got = run_digests(periodic_runs(planted(docs(spark, rows)))).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = WORDS.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            n = len(words)
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if len(words) < 2_000 else [(0, len(words), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 160))
    assert periodic_runs(docs(spark, [])).collect() == []


def test_general_interface(spark):
    df = spark.createDataFrame([("k", "go go go go go go home", 1)], "key string, body string, runs int")
    (row,) = periodic_runs(df, id_col="key", text="body").collect()
    assert (row.key, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 7, [(0, 6, 1)], "go home")
