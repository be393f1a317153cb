"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause. Negation, reported speech and target each open a
context at their words and keep it open over a number of words (their states count down);
threat opens at an intent or a command and emits at an act of harm while open; insult emits the
weight, learned from labels, of an insulting word or word beginning. Their composition is one
weighted automaton: its states are tuples of theirs, made as they are met, and its arcs, over
sets of word classes, say in which context an insult or an act of harm stands. Whether a clause
has a target may come last, so emissions that wait for it are settled at the clause's end, as
final outputs: a negated or reported insult weighs as such, one in a clause with a target as
aimed, any other as plain, and an act of harm is a threat only with a target, and neither negated
nor reported. The weights emitted are added over matched clauses, never over isolated words of a
text, and a logistic model, learned with them, turns the sums into a score; an aimed insult always
counts for more than a plain one. A clause is walked whole and once, whatever its length.

Learning reads labelled rows of the training fold only, SAMPLE_ROWS of them at most (those with
the smallest hash of id; a documented bound). Counts over that sample find the insult lexicon:
words and word beginnings that at least LEAST_SEEN toxic texts have (near copies count once), and
that are toxic PURITY of the time. Scoring reads every whole text: an Aho-Corasick automaton over the
lexicon finds the places where a clause can match, and only such clauses are walked.

Defined cases: null and empty texts match nothing and get the score of no match; repeated rows
and ids are scored each; null or unjoinable labels teach nothing; with no label of one class the
lexicon is empty and every score is 0; extra columns are ignored by toxicity_scores and kept by
without_toxic.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.bytehash import mix
from loghelm.llm.common import Scratch, text_or_empty, train_fold, whole_row

SAMPLE_ROWS = 24_000
LEAST_SEEN = 5
PURITY = 0.8
STEMS = (4, 5, 6, 7)
WIDER = 1.5

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")

# Fixed words of the grammar, in English, French, German and Spanish.
NEGATION = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split())
REPORTED = frozenset("said says say told tells called calls wrote writes claimed claims quoted quote according allegedly reportedly sagte sagt nannte schrieb laut angeblich dit disait appelle appelé écrit selon dijo dice llamó llama escribió según supuestamente".split())
TARGET = frozenset("you your you're yourself u they them he she him her his people those these du dich dir ihr euch sie tu te toi vous ton ta tes ils elles usted ustedes tú ti vosotros ellos ellas".split())
INTENT = frozenset("will i'll we'll gonna going must should deserve deserves better werde werden wirst sollst verdienst vais va allons dois mérites voy vamos debes mereces".split())
HARM = frozenset("kill killed murder hurt stab shoot strangle burn hang destroy beat rape töten umbringen erschießen verprügeln verbrennen tuer assassiner frapper brûler pendre matar asesinar golpear quemar colgar".split())

#: classes of words, as bits
NEGATES, REPORTS, AIMS, MEANS, HARMS, INSULTS = (1 << i for i in range(6))
CLASS: dict[str, int] = {}
for _bit, _words in ((NEGATES, NEGATION), (REPORTS, REPORTED), (AIMS, TARGET), (MEANS, INTENT), (HARMS, HARM)):
    for _word in _words:
        CLASS[_word] = CLASS.get(_word, 0) | _bit
FEATURES = ("plain", "aimed", "negated", "reported", "threat")
HARM_WEIGHT = 3.0
#: by how much more an aimed insult counts than a plain one, at least
AIMED_MORE = 0.5


@dataclass(frozen=True)
class Context:
    """A transducer that a word of class `opens` sets to `reach`; each later word counts down. It
    tells of each word whether the context is open there."""

    opens: int
    reach: int

    def step(self, state: int, word: int) -> tuple[int, bool]:
        if word & self.opens:
            return self.reach, True
        return max(0, state - 1), state > 0


NEGATION_FST, REPORT_FST, TARGET_FST, THREAT_FST = Context(NEGATES, 3), Context(REPORTS, 12), Context(AIMS, 6), Context(MEANS, 5)


class Composed:
    """The composition of the four contexts with the emitting transducers, arc by arc as needed.

    A state is (negation, report, target, threat, whether a target was met). An arc gives the next
    state, where an insult on it counts (None: settled at the end) and whether an act of harm does.
    """

    START = (0, 0, 0, 0, False)

    def __init__(self) -> None:
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple, word: int) -> tuple:
        found = self.arcs.get((state, word))
        if found is None:
            parts = [fst.step(s, word) for fst, s in zip((NEGATION_FST, REPORT_FST, TARGET_FST, THREAT_FST), state, strict=False)]
            negated, reported, aimed, meant = (open_ for _, open_ in parts)
            insult = "negated" if negated else "reported" if reported else "aimed" if aimed else None
            harm = bool(word & HARMS) and not word & INSULTS and meant and not negated and not reported
            found = (*(s for s, _ in parts), state[4] or bool(word & AIMS)), insult, harm
            self.arcs[state, word] = found
        return found

    def transduce(self, words: list[tuple[int, float]]) -> dict[str, float]:
        """What is emitted over the (classes, insult weight) of a clause's words."""
        out = dict.fromkeys(FEATURES, 0.0)
        state, waiting, harms = self.START, 0.0, 0
        for word, weight in words:
            state, insult, harm = self.arc(state, word)
            if weight:
                if insult is None:
                    waiting += weight
                else:
                    out[insult] += weight
            harms += harm
        # final outputs
        out["aimed" if state[4] else "plain"] += waiting
        if state[4]:
            out["threat"] += HARM_WEIGHT * harms
        return out


@dataclass
class Grammar:
    """The insult transducer's weights, composed with the contexts, and the model over what is emitted."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-30.0, 1.0, 2.0, 0.5, 0.5, 2.0])

    def __post_init__(self) -> None:
        self._automaton = None
        self._composed = Composed()

    def insult(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                w = max(w, self.stems.get(word[:n], 0.0))
        return w

    def _places(self, low: str):
        """Where an insult or an act of harm may begin."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *HARM}:
                a.add_word(w, len(w))
            a.make_automaton()
            self._automaton = a
        if not len(self._automaton):
            return
        for end, n in self._automaton.iter(low):
            at = end - n + 1
            if at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_"):
                yield at

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "coefficients": self.coefficients, "_automaton": None, "_composed": Composed()}

    def clause(self, words: list[str]) -> dict[str, float]:
        """What the automaton emits over one clause."""
        read = []
        for w in words:
            weight = self.insult(w)
            read.append((CLASS.get(w, 0) | (INSULTS if weight else 0), weight))
        return self._composed.transduce(read)

    def features(self, text: str) -> tuple[list[float], list[tuple[int, int]]]:
        """Sums over the matched clauses, and where these clauses are."""
        low = text.lower()
        total = [0.0] * len(FEATURES)
        clauses: list[tuple[int, int]] = []
        places = sorted(set(self._places(low)))
        if not places:
            return total, clauses
        ends = [m.start() for m in CLAUSE_END.finditer(low)]
        done = -1
        for at in places:
            if at <= done:
                continue
            i = bisect_left(ends, at)
            begin, done = ends[i - 1] + 1 if i else 0, ends[i] if i < len(ends) else len(low)
            got = self.clause(WORD.findall(low, begin, done))
            if any(got.values()):
                clauses.append((begin, done))
                total = [t + got[k] for t, k in zip(total, FEATURES, strict=True)]
        return total, clauses

    def score(self, total: list[float]) -> float:
        if not any(total):
            return 0.0 if not self.words and not self.stems else 1 / (1 + math.exp(-max(-30.0, min(30.0, self.coefficients[0]))))
        z = self.coefficients[0] + sum(c * math.log1p(t) for c, t in zip(self.coefficients[1:], total, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _atoms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {"w" + w for w in words if len(w) >= 3} | {"s" + w[:n] for w in words for n in STEMS if len(w) > n}


def _copy_bands(text: str, bands: int = 6, rows: int = 3) -> list[int]:
    """Band hashes of a minhash over runs of three words: near copies share one at least."""
    words = WORD.findall(text.lower())
    runs = pd.util.hash_array(np.asarray([" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))], object))
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    least = np.asarray([mix(runs ^ s).min() for s in seeds], np.uint64).reshape(bands, rows)
    out = mix(least[:, 0] + np.uint64(3) * mix(least[:, 1] + np.uint64(5) * mix(least[:, 2] + np.arange(bands, dtype=np.uint64))))
    return out.view(np.int64).tolist()


def _families(bands: list[list[int]]) -> list[int]:
    """The first row that each row shares a band with, directly or through others."""
    parent = list(range(len(bands)))
    seen: dict[int, int] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in enumerate(bands):
        for band in own:
            a, b = root(i), root(seen.setdefault(band, i))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(bands))]


def _lexicon(found: dict[str, tuple[int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems to keep. A stem stays if it is clearly wider than any word that it begins
    (else the word says more) and no shorter stem does; a word that a stem covers goes."""
    widest: dict[str, int] = {}
    for atom, (n, _) in found.items():
        if atom[0] == "w":
            for k in STEMS:
                widest[atom[1 : k + 1]] = max(n, widest.get(atom[1 : k + 1], 0))
    stems: dict[str, float] = {}
    for atom in sorted((a for a in found if a[0] == "s"), key=len):
        n, weight = found[atom]
        if n >= WIDER * widest.get(atom[1:], 0) and not any(atom[1 : k + 1] in stems for k in STEMS if k < len(atom) - 1):
            stems[atom[1:]] = weight
    words = {a[1:]: w for a, (_, w) in found.items() if a[0] == "w" and not any(a[1 : k + 1] in stems for k in STEMS if len(a) - 1 > k)}
    return words, stems


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior."""
    z = np.column_stack([np.ones(len(x)), np.log1p(x)])
    b = prior.copy()
    pull = np.full(len(b), ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (y - p) - pull * (b - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    b[1:] = np.maximum(b[1:], 0.0)
    plain, aimed = 1 + FEATURES.index("plain"), 1 + FEATURES.index("aimed")
    b[aimed] = max(b[aimed], b[plain] + AIMED_MORE)
    return b


def learn_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_ROWS) -> Grammar:
    """Lexicon and weights from labelled rows of the training fold."""
    said = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & train_fold("id"))
    said = said.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    # `sample` rows at most, and those that repeat their ids; written, as they are read three times
    got = Scratch(docs.sparkSession).keep(rows.join(F.broadcast(said), "id"))

    def banded(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"].astype(str), "bands": [_copy_bands(t) for t in f["text"]]})

    # near copies are one family, or their rare words would look like insults; `sample` rows
    signs = got.mapInPandas(banded, "id string, bands array<long>").orderBy("id").collect()
    spark = docs.sparkSession
    family = spark.createDataFrame(list({r["id"]: f for r, f in zip(signs, _families([r["bands"] for r in signs]), strict=True)}.items()), "id string, family long")
    told = got.select(F.col("id").cast("string").alias("id"), "y", "text").join(F.broadcast(family), "id")

    def count(frames):
        for f in frames:
            yield pd.DataFrame({"y": f["y"].astype(int), "family": f["family"], "atoms": [sorted(_atoms(t)) for t in f["text"]]})

    one = told.mapInPandas(count, "y int, family long, atoms array<string>")
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count_distinct("family").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Grammar()
    atoms = one.select("y", "family", F.explode("atoms").alias("atom")).groupBy("atom", "family").agg(F.max("y").alias("bad"), F.max(1 - F.col("y")).alias("good"))
    atoms = atoms.groupBy("atom").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = atoms.where((F.col("bad") >= LEAST_SEEN) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good"))))
    found = {r["atom"]: (r["bad"], math.log((r["bad"] + 0.5) / (n_bad + 1)) - math.log((r["good"] + 0.5) / (n_good + 1))) for r in kept.collect()}  # at most the atoms of `sample` texts, each in five of them
    grammar = Grammar(*_lexicon(found))

    def emit(frames):
        for f in frames:
            x = [grammar.features(t)[0] for t in f["text"]]
            yield pd.DataFrame({"y": f["y"].astype(float), "x": x})

    seen = got.mapInPandas(emit, "y double, x array<double>").groupBy("y", "x").count().collect()
    n = np.asarray([r["count"] for r in seen])
    x = np.repeat(np.asarray([r["x"] for r in seen], float), n, axis=0)
    y = np.repeat(np.asarray([r["y"] for r in seen], float), n)
    grammar.coefficients = _fit(x, y, np.asarray([-4.0, 2.0, 3.0, 1.0, 1.0, 2.5])).tolist()
    return grammar


def toxicity_udf(grammar: Grammar):
    @F.pandas_udf("struct<score:double,clauses:array<struct<lo:int,hi:int>>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        scores, where = [], []
        for t in texts:
            total, clauses = grammar.features(t or "")
            scores.append(grammar.score(total))
            where.append([{"lo": a, "hi": b} for a, b in clauses])
        return pd.DataFrame({"score": scores, "clauses": where})

    return score


def toxicity_scores(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and clauses (the places of matched clauses)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", (~train_fold("doc_id")).alias("held_out"), toxicity_udf(grammar)("text").alias("t"))
    return rows.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= threshold).cast("int").alias("predicted"), F.col("t.clauses").alias("clauses"))


def without_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs."""
    held = docs.select(whole_row(docs).alias("row"), toxicity_udf(grammar)(text_or_empty(text_col)).alias("told"))
    return held.where(F.col("told.score") < threshold).select("row.*")
