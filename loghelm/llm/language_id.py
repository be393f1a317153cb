"""Language identification by nearest centroid over character n-grams.

A text is lower-cased, everything but letters becomes a gap, and its runs of two and three
characters are counted in DIMS hashed cells. Counts are damped (square root), weighted by the
inverse document frequency learned from the sample, and scaled to length one. Each language has
up to `clusters` centroids, from spherical k-means over its sample. A text belongs to the
language of the centroid with the largest cosine; its score is that cosine. A text further from
its centroid than all but REJECTED of the sample were from theirs is marked as rejected.

Learning reads non-null languages of the training fold only: of the LANGUAGES languages with most
texts (ties to the first in order), a sample of about PER_LANGUAGE texts of each, and of about
SAMPLE texts in all, by hash of id and text. These are documented bounds of the fit. The sample is
drawn by filter, at a rate worked out from counts, so no language meets in one task and no text
is shuffled. Every whole text is scored.

Defined cases: null texts and texts without a letter are `und` with score 0; very long texts are
counted piece by piece; ties go to the language first in order; with nothing to learn from, every
text is `und`; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.bytehash import mix
from loghelm.llm.common import train_fold

DIMS = 4096
PER_LANGUAGE = 1024
LANGUAGES = 256
SAMPLE = 8192
REJECTED = 0.01
PIECE = 200_000

_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed cell occurs among the text's runs of two and three characters."""
    out = np.zeros(DIMS, np.float32)
    low = text.lower()
    for i in range(0, len(low), PIECE):
        # pieces overlap by two characters, so that no run is lost
        codes = np.frombuffer(low[max(0, i - 2) : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        c = np.where(letter, codes, 32).astype(np.uint64)
        gap = np.concatenate([[i == 0], ~letter]) if i == 0 else ~letter
        c = np.concatenate([[np.uint64(32)], c]) if i == 0 else c
        keep = np.ones(len(c), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        c = c[keep]
        two = c[:-1] * np.uint64(0x1000193) + c[1:]
        three = two[:-1] * np.uint64(0x1000193) + c[2:]
        if i:  # runs of two that lie in the overlap were counted before
            two = two[1:]
        for runs in (two, three):
            if len(runs):
                out += np.bincount((mix(runs) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    rows: np.ndarray
    language: list[str]
    least: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _unit(np.sqrt(np.stack([counts(t) for t in texts])) * self.idf)

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(texts) @ self.rows.T
        at = cosine.argmax(axis=1)
        return at, np.clip(cosine[np.arange(len(at)), at], 0, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts."""
    centers = [x.mean(axis=0)]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.argmin((x @ np.stack(centers).T).max(axis=1))])
    c = _unit(np.stack(centers))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, (x @ c.T).argmax(axis=1)


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 3, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, sample: int = SAMPLE) -> Centroids | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & train_fold("id"))
    # rows that are alike count once, and are drawn once
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    most = rows.groupBy("lang", "h").agg(F.lit(1).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "lang").limit(languages).collect()  # `languages` rows
    if not most:
        return None
    share = min(per_language, sample // len(most))
    rate = F.create_map(*[F.lit(x) for r in most for x in (r["lang"], min(1.0, share / r["count"]))])
    drawn = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(F.col("text").isNotNull() & (drawn < F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(0.0)))).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[has_letter(t) for t in f["text"]]]
            if len(f):
                yield pd.DataFrame({"lang": f["lang"].to_numpy(), "x": [np.sqrt(counts(t)).astype(np.float16).tobytes() for t in f["text"]]})

    got = picked.mapInPandas(count, "lang string, x binary").toPandas()  # about `sample` rows
    if not len(got):
        return None
    got = got.sort_values(["lang", "x"], ignore_index=True)
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.05).astype(np.float32)
    x = _unit(x * idf)
    centers, names, least = [], [], []
    for lang, at in got.groupby("lang").indices.items():
        c, own = _clusters(x[at], clusters)
        near = np.einsum("ij,ij->i", x[at], c[own])
        for j in range(len(c)):
            if (own == j).any():
                centers.append(c[j])
                names.append(str(lang))
                least.append(np.quantile(near[own == j], REJECTED))
    return Centroids(idf, np.stack(centers).astype(np.float32), names, np.asarray(least))


def identify_language(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers for each centroid

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        lang, score, rejected = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if m is not None:
            some = np.nonzero([has_letter(t) for t in texts])[0]
            for i in range(0, len(some), 256):
                part = some[i : i + 256]
                at, cosine = m.nearest([texts.iloc[j] for j in part])
                lang[part] = [m.language[j] for j in at]
                score[part] = cosine
                rejected[part] = cosine < m.least[at]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", (~train_fold("doc_id")).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
