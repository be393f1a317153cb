import hashlib
import random
from collections import defaultdict

import numpy as np

from loghelm.llm.suffix_dedup import multikey_order, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string"


def brute(texts, need=200):
    seen = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for i, r in enumerate(raws):
        for s in range(len(r) - need + 1):
            seen[r[s : s + need]].append((i, s))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + need] = b"\1" * need
    out = []
    for r, g in zip(raws, gone):
        kept = bytes(x for x, y in zip(r, g) if not y)
        spans = sum(1 for j in range(len(g)) if g[j] and (j == 0 or not g[j - 1]))
        out.append((len(r), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, ids=None, **kw):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], SCHEMA)
    got = suffix_dedup(df.repartition(3), **kw).collect()
    want = sorted(zip([-1 if i is None else i for i in ids], brute(texts)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(60) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 80)
            cut = rng.randint(0, len(t))
            t = t[:cut] + s[a : a + rng.randint(150, 320)] + t[cut:]
        texts.append(t)
    texts += texts[:6] + [texts[7][:-1] + "!", "ab" * 400, "a" * 700, "a" * 199, "a" * 200, "", None, " " * 450, "xyz" * 100 + text(3) + "xyz" * 100]
    check(spark, texts)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(chr(97 + (i * i) % 26) for i in range(260)) + "end"
    check(spark, [t, t, None, "short"], [1, 1, None, None])
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_leads_shared_by_many_suffixes_are_split(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    head, long_head = text(90), text(190)
    texts = [head + text(rng.randint(0, 160)) for _ in range(40)] + [text(100) + long_head + text(rng.randint(0, 30)) for _ in range(30)]
    tails = [text(3) for _ in range(6)]
    texts += [rng.choice(tails) + long_head + rng.choice(tails) + rng.choice(tails) for _ in range(30)]
    texts += texts[:9] + texts[45:50] * 2 + ["q" * 300, "q" * 260, "q" * 450]
    check(spark, texts, hot=5)
    check(spark, texts, hot=1)


def test_multikey_order_sorts():
    rng = np.random.default_rng(2)
    for m, width, top in ((0, 3, 2), (1, 3, 2), (500, 4, 2), (500, 3, 2**63), (300, 25, 1)):
        words = rng.integers(0, top, (m, width), dtype=np.uint64, endpoint=True).astype(">u8")
        got = [tuple(r) for r in words[multikey_order(words)].tolist()]
        assert got == sorted(got)
