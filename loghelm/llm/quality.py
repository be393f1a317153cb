"""Quality classifier from weak labels.

LABELLERS heuristics each vote good, bad or abstain on a whole text; they overlap and err.
Expectation-maximisation over the counts of vote patterns (3 ** LABELLERS at most, counted over
all documents) estimates how often each labeller votes each way on good and on bad texts, and
the share of good texts, with no true label seen. The posterior of each pattern is the weak
label of its documents. A hashed linear scorer (logistic regression on hashed runs of three
bytes) then learns the posteriors on a sample of TRAIN_ROWS documents, those with the smallest
hashes of id (a documented bound), and scores every whole text, also where all labellers
abstain.

Defined cases: null and empty texts get score 0 and posterior 0; repeated rows are scored each;
very long texts are counted piece by piece; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.bytehash import mix
from loghelm.llm.common import Scratch, text_or_empty

DIMS = 4096
TRAIN_ROWS = 6000
PIECE = 1_000_000
WINDOW = 2000
LABELLERS = ("symbols", "letters", "digits", "word_length", "line_copies", "word_variety", "sentences", "size")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~/"]] = 4
_CLASS[[ord(c) for c in ".!?,;:'\"()-"]] = 5
_STOP = re.compile(r"[.!?](?:\s|$)")


def word_variety(words: list[bytes]) -> float:
    """Share of distinct words: the mean over near-equal windows of WINDOW words at most that
    together cover all words, so that long texts are not counted as poor for their length."""
    m = -(-len(words) // WINDOW)
    cuts = [i * len(words) // m for i in range(m + 1)]
    return sum(len(set(words[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:])) / m


def votes(text: str) -> str:
    """One letter for each labeller: g (good), b (bad) or a (abstain)."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return "b" * len(LABELLERS)
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    dense = max(1, int(n.sum() - n[3]))
    words = raw.split()
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    mean = dense / len(words)
    copies = 1 - len(set(lines)) / len(lines) if lines else 0.0
    variety = word_variety(words)
    stops = len(_STOP.findall(text)) / len(words)

    def between(x: float, good: tuple[float, float], fair: tuple[float, float]) -> str:
        return "g" if good[0] <= x <= good[1] else "a" if fair[0] <= x <= fair[1] else "b"

    return "".join(
        (
            between(n[4] / dense, (0, 0.01), (0, 0.05)),
            between(n[1] / dense, (0.9, 1), (0.75, 1)),
            between(n[2] / dense, (0, 0.03), (0, 0.12)),
            between(mean, (3.5, 9), (2.5, 14)),
            between(copies, (0, 0.1), (0, 0.3)),
            "a" if len(words) < 30 else between(variety, (0.3, 1), (0.15, 1)),
            between(stops, (0.02, 0.34), (0.005, 0.6)),
            "g" if len(words) >= 40 else "a" if len(words) >= 8 else "b",
        )
    )


@dataclass
class LabelModel:
    share: float
    #: rates[labeller, vote, class]: how often it votes so on bad (0) and good (1) texts
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a text with these votes (0 good, 1 bad, 2 abstain) is good."""
        log = np.log(np.asarray([1 - self.share, self.share]))[None, :].repeat(len(patterns), 0)
        for j in range(patterns.shape[1]):
            log = log + np.log(self.rates[j, patterns[:, j]])
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def coded(patterns: list[str]) -> np.ndarray:
    return np.asarray([["gba".index(v) for v in p] for p in patterns], np.int64).reshape(len(patterns), -1)


def fit_labels(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from the majority vote."""
    v = coded(patterns)
    n = counts.astype(float)
    good, bad = (v == 0).sum(axis=1), (v == 1).sum(axis=1)
    post = np.clip((good - 1.5 * bad + 0.5) / np.maximum(1, good + bad) * 0.45 + 0.5, 0.05, 0.95)
    model = None
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post], axis=1)
        rates = np.empty((v.shape[1], 3, 2))
        for j in range(v.shape[1]):
            for vote in range(3):
                rates[j, vote] = w[v[:, j] == vote].sum(axis=0) + 1.0
        rates /= rates.sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip(w[:, 1].sum() / w.sum(), 0.01, 0.99)), rates)
        new = model.posterior(v)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return model


def hashed(text: str) -> np.ndarray:
    """Unit vector of damped counts of hashed runs of three bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS, np.float32)
    for i in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(len(raw), i + PIECE + 2) - i, i).astype(np.uint64)
        if len(b) > 2:
            runs = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
            out += np.bincount((mix(runs) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam over the whole sample."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = ((p - y) / len(y)).astype(np.float32)
        g, gb = x.T @ err + np.float32(decay) * w, float(err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        k = rate * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        w, b = w - k * m / (np.sqrt(s) + 1e-6), b - k * mb / (sb**0.5 + 1e-6)
    return w, float(b)


def quality_scores(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, posterior, score, predicted (1: good) of every row."""
    scratch = Scratch(docs.sparkSession)

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        return texts.map(votes)

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    patterns = scratch.keep(texts.select(vote("text").alias("votes")).groupBy("votes").count()).toPandas().sort_values("votes", ignore_index=True)  # 3 ** LABELLERS rows at most
    model = fit_labels(patterns["votes"].tolist(), patterns["count"].to_numpy()) if len(patterns) else LabelModel(0.5, np.full((len(LABELLERS), 3, 2), 1 / 3))
    chance = dict(zip(patterns["votes"], model.posterior(coded(patterns["votes"].tolist())) if len(patterns) else [], strict=True))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [hashed(t).astype(np.float16).tobytes() for t in f["text"]], "y": [chance.get(votes(t), 0.5) for t in f["text"]]})

    # one row of each of the first ids by hash: the same rows at any run
    ids = texts.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(train_rows)
    sample = texts.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(ids), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).select("text")
    got = sample.mapInPandas(learn, "x binary, y double").toPandas().sort_values(["y", "x"], ignore_index=True)
    if len(got):
        x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
        w, b = fit_scorer(x, got["y"].to_numpy())
    else:
        w, b = np.zeros(DIMS, np.float32), 0.0

    @F.pandas_udf("struct<votes:string,posterior:double,score:double>")
    def score(texts_: pd.Series) -> pd.DataFrame:
        seen = [votes(t) for t in texts_]
        z = np.asarray([float(hashed(t) @ w) + b if t.strip() else -np.inf for t in texts_], float)
        return pd.DataFrame({"votes": seen, "posterior": [chance.get(v, 0.5) if t.strip() else 0.0 for v, t in zip(seen, texts_, strict=True)], "score": 1 / (1 + np.exp(-np.clip(z, -700, 30)))}).assign(score=lambda d: d["score"].where(np.isfinite(z), 0.0))

    out = texts.select("doc_id", score("text").alias("s"))
    return out.select("doc_id", "s.votes", "s.posterior", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"))
