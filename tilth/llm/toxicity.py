"""Toxicity: a subsequence string-kernel support vector machine on words, with Nyström landmarks.

The kernel of two words counts the gapped subsequences of three characters that they share within a span of SPAN,
each occurrence weighing DECAY to the power of its span, so an insult still matches when characters are inserted or
left out. Landmark words give the Nyström features K(x, L) K(L, L)^-1/2, on which a linear machine with squared hinge
loss is trained. Because the kernel has an explicit (hashed) feature map, the trained machine folds into one weight a
subsequence, and scoring a word is a sum over its subsequences, however many landmarks there were.

Labels belong to documents, while insults are words of their sentences: training takes the words that most likely made
a document toxic as its witnesses and learns again from better witnesses. A document's score is a logistic function of
its words' margins: the three largest, and how many words, and which share of them, pass each of three heights. That
function is fitted on margins that a machine trained without the document gave it, so it knows how far margins of
unseen documents fall, and with toxic rows weighing TOXIC_WEIGHT, for labels hold few of them. The machine that scores
is the mean of those that each left a part of the documents out; all have seen as many.

Only the text enters a score. Training takes at most `most_a_class` labelled documents of each label, chosen by a hash
of the id, of at most `most_chars` characters each, and of their clean words the CLEAN_WORDS that are commonest or that
the machine finds most toxic; these are the only samples, and scoring reads every text whole. Defined cases: null or
empty text scores as a text without words; null labels and labels without a document are left out; repeated rows each
give a row, and equal texts equal scores; with labels of one kind only, or no words to learn from, every score is the
share of toxic labels. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import small_batches

SPAN, DECAY, BITS = 7, 0.5, 18
#: Words of a toxic document that train the machine.
WITNESSES = 3
LANDMARKS, ROUNDS, CLEAN_WORDS, PARTS = 300, 2, 8_000, 3
#: The share of toxic documents that a word must be in to be a witness; two at least.
SHARED = 0.006
#: What a toxic row weighs, and the heights of margins that a document's words are counted over.
TOXIC_WEIGHT, HEIGHTS = 8.0, (0.0, 0.3, 0.6)
LONGEST, STRIDE = 32, 16
THRESHOLD = 0.7
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _windows(word: str) -> list[str]:
    """The word, or beyond LONGEST its overlapping windows, which hold all of it."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST + STRIDE, STRIDE)]


def units(text: str | None) -> list[str]:
    """The words of a text as the kernel sees them: small letters, no punctuation around, runs of single characters
    also joined, and what is beyond LONGEST in overlapping windows."""
    out, run = [], []
    for token in (text or "").lower().split():
        word = token if token.isalnum() else EDGE.sub("", token)
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 3:
            out += _windows("".join(run))
        run.clear()
        if word:
            out += _windows(word)
    if len(run) > 3:
        out += _windows("".join(run))
    return out


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: owner word and hashed subsequence of every occurrence, and their weight."""
    joined = [f"\2{w}\3" for w in words]
    size = np.array([len(w) for w in joined])
    codes = np.frombuffer(("".join(joined) + "\0" * SPAN).encode("utf-32-le"), np.uint32)
    n = len(codes) - SPAN
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(n)
    first = codes[:n] * np.uint32(0x9E3779B1)
    for a, b in GAPS:
        at = np.flatnonzero(left > b)
        mixed = (first[at] + codes[at + a] * np.uint32(0x85EBCA6B)) ^ (codes[at + b] * np.uint32(0xC2B2AE35))
        mixed ^= mixed >> np.uint32(15)
        yield owner[at], (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), DECAY ** (b + 1)


def _norms(words: list[str]) -> np.ndarray:
    total = np.zeros(len(words))
    for owner, _, weight in _subsequences(words):
        total += np.bincount(owner, minlength=len(words)) * weight**2
    return np.sqrt(np.maximum(total, 1e-12))


def margins(words: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each word."""
    out = []
    for k in range(0, len(words), 10_000):
        few = words[k : k + 10_000]
        total = np.zeros(len(few))
        for owner, sub, weight in _subsequences(few):
            total += np.bincount(owner, beta[sub], minlength=len(few)) * weight
        out.append(total / _norms(few) + bias)
    return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Landmarks:
    """The landmark words' normalised weights: `rows` a known subsequence, `place` of each hash in them (or -1)."""

    place: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        found = [(owner, sub, np.full(len(sub), weight)) for owner, sub, weight in _subsequences(words)]
        owner, sub, weight = (np.concatenate(x) for x in zip(*found))
        known, at = np.unique(sub, return_inverse=True)
        rows = np.zeros((len(known), len(words)), np.float32)
        np.add.at(rows, (at, owner), weight)
        place = np.full(1 << BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        rows /= _norms(words).astype(np.float32)
        return cls(place, rows)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Words by landmarks."""
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        for owner, sub, weight in _subsequences(words):
            at = self.place[sub]
            owner, at = owner[at >= 0], at[at >= 0]
            if len(owner):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] += np.add.reduceat(self.rows[at], first, axis=0) * np.float32(weight)
        return out / _norms(words)[:, None].astype(np.float32)

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """One weight a hashed subsequence for a weight a landmark."""
        beta = np.zeros(1 << BITS, np.float32)
        beta[self.place >= 0] = (self.rows @ alpha)[self.place[self.place >= 0]]
        return beta


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Squared hinge loss by Newton's steps on the rows within the margin. The last entry is the bias."""
    x = np.empty((len(z), z.shape[1] + 1), z.dtype)
    x[:, :-1], x[:, -1] = z, 1
    w = np.zeros(x.shape[1])
    penalty = np.diag([*[ridge] * z.shape[1], 1e-6])
    for _ in range(20):
        inside = y * (x @ w) < 1
        root = np.sqrt(weight[inside]).astype(x.dtype)
        xs = x[inside]
        xs *= root[:, None]
        new = np.linalg.solve(penalty + xs.T @ xs, xs.T @ (y[inside] * root))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.array([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _summary(values: np.ndarray) -> list[float]:
    """What a document's words' margins tell."""
    if not len(values):
        return [-1.0, -1.0, -1.0, *[0.0] * (2 * len(HEIGHTS) + 1)]
    top = np.sort(np.partition(values, len(values) - 3)[-3:]) if len(values) > 3 else np.sort(np.append(values, [-1.0] * (3 - len(values))))
    over = np.array([(values > h).sum() for h in HEIGHTS], float)
    return [*np.clip(top, -1, 1), *np.log1p(over), *np.sqrt(over / len(values)), np.log1p(len(values))]


@dataclass
class Model:
    """Weights a subsequence with the bias, and the logistic weights; about a megabyte."""

    beta: np.ndarray
    bias: float
    logistic: np.ndarray

    def scores(self, texts: list[str | None], known: dict[str, float], most: int = 100_000) -> np.ndarray:
        split = [units(t) for t in texts]
        new = list(set().union(*split) - known.keys())
        if len(new) + len(known) > most:
            known.clear()
            new = list(set().union(*split))
        known.update(zip(new, margins(new, self.beta, self.bias).tolist()))
        x = np.array([_summary(np.fromiter(map(known.__getitem__, own), float, len(own))) for own in split]).reshape(len(split), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def _constant(share: float) -> Model:
    width = len(_summary(np.zeros(0)))
    return Model(np.zeros(1 << BITS, np.float32), -1.0, np.array([*[0.0] * width, np.log(share / (1 - share))]))


def _trained(docs: list[np.ndarray], y: np.ndarray, words: list[str]) -> tuple[np.ndarray, float]:
    """Weights and bias of a machine from documents, given as numbers of their words."""
    sets = [np.unique(d) for d in docs]
    seen = [np.bincount(np.concatenate([s for s, t in zip(sets, y) if t == label]), minlength=len(words)) for label in (0, 1)]
    odds = np.log((seen[1] + 0.1) / (y == 1).sum()) - np.log((seen[0] + 0.5) / (y == 0).sum())
    strength = odds * np.log1p(seen[1])
    ranked = np.lexsort((np.arange(len(words)), -strength))
    ranked = ranked[seen[1][ranked] > 0]
    common = np.lexsort((np.arange(len(words)), -seen[0]))
    common = common[seen[0][common] > 0]
    of = lambda ids: [words[k] for k in ids]
    chosen = list(dict.fromkeys(of(ranked[: 2 * LANDMARKS // 3]) + of(common[: LANDMARKS // 3])))
    landmarks = Landmarks.of(chosen)
    values, vectors = np.linalg.eigh((landmarks.rows.T @ landmarks.rows).astype(float))
    held = values > 1e-6 * values.max()
    whiten = (vectors[:, held] / np.sqrt(values[held])).astype(np.float32)

    clean = common[(seen[1][common] == 0) | (odds[common] < 1)]
    # only what several toxic documents share, and clean ones hardly have, can be a witness
    many = max(2.0, SHARED * (y == 1).sum())
    suspects = [s[(seen[1][s] >= many) & (odds[s] > 2)] for s, t in zip(sets, y) if t]
    suspected = np.unique(np.concatenate(suspects)) if suspects else np.zeros(0, np.int64)
    del sets
    best = lambda key: np.concatenate([s[np.argsort(-key[s], kind="stable")[:WITNESSES]] for s in suspects])
    witnesses, hard, key = best(strength), clean[:CLEAN_WORDS], strength.copy()
    for _ in range(ROUNDS):
        positive, times = np.unique(witnesses, return_counts=True)
        spread = [m.join(w) for w in of(positive) for m in "*-" if 3 < len(w) <= 12]
        every = of(positive) + spread + of(hard)
        label = np.array([1.0] * (len(positive) + len(spread)) + [-1.0] * len(hard))
        weight = np.concatenate([1.0 + np.log1p(times), np.full(len(spread), 0.5), np.log1p(seen[0][hard])])
        weight[label > 0] *= weight[label < 0].sum() / max(1.0, weight[label > 0].sum())
        z = np.vstack([landmarks.kernel(every[k : k + 1000]) @ whiten for k in range(0, len(every), 1000)])
        w = _machine(z, label, weight)
        beta, bias = landmarks.folded(whiten @ w[:-1]), float(w[-1])
        key[suspected] = margins(of(suspected), beta, bias) + 0.2 * np.minimum(odds[suspected], 5)
        witnesses = best(key)
        value_clean = margins(of(clean), beta, bias)
        hard = clean[np.union1d(np.argsort(-value_clean, kind="stable")[: CLEAN_WORDS // 2], np.arange(min(len(clean), CLEAN_WORDS // 2)))]
    return beta, bias


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled documents."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max() or not any(units(t) for t in texts):
        return _constant(float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)))
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in units(t)], np.int32) for t in texts]
    words = list(place)
    del place

    def summaries(rows: np.ndarray, beta: np.ndarray, bias: float) -> list[list[float]]:
        held = np.unique(np.concatenate([docs[k] for k in rows]))
        value = np.zeros(len(words))
        value[held] = margins([words[k] for k in held], beta, bias)
        return [_summary(value[docs[k]]) for k in rows]

    part = np.empty(len(y), np.int64)  # each label is dealt out evenly
    for label in (0, 1):
        part[y == label] = np.arange((y == label).sum()) % PARTS
    machines, x = [], np.zeros((len(docs), len(_summary(np.zeros(0)))))
    for k in range(PARTS):
        rest, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if not 0 < y[rest].sum() < len(rest) or not any(len(docs[i]) for i in rest):
            rest = np.arange(len(y))  # too few labels to leave a part out
        machines.append(_trained([docs[i] for i in rest], y[rest], words))
        if len(own):
            x[own] = summaries(own, *machines[-1])
    beta = np.mean([m[0] for m in machines], axis=0, dtype=np.float32)
    bias = float(np.mean([m[1] for m in machines]))
    return Model(beta, bias, _logistic(x, y.astype(float), np.where(y == 1, TOXIC_WEIGHT, 1.0)))


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_a_class: int = 2000, most_chars: int = 200_000) -> Model:
    """Learn from the documents with a label whose id passes `learn` (a column expression of id_col), at most so many of
    each label and of texts of at most most_chars characters, so the driver holds a bounded sample. Their ids are the only
    broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & learn).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__label"))
    chosen = None
    for label in (0, 1):
        own = known.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(most_a_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id").where(F.coalesce(F.length("__text"), F.lit(0)) <= most_chars).dropDuplicates(["__id"]).collect()
    rows.sort(key=lambda r: r["__id"])
    return train([r["__text"] for r in rows], [r["__label"] for r in rows])


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with a score between 0 and 1; a column of that name is replaced."""
    df = small_batches(df.drop(out_col))
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            scores = [model.scores(texts.slice(k, 128).to_pylist(), known) for k in range(0, len(texts), 128)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, df.withColumn(out_col, F.lit(0.0)).schema)


def fold(id_col: str = "doc_id"):
    """The remainder that tells learning rows (not 1) from held-out ones (1)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: whether it is held out, its score and the prediction."""
    model = fit(docs, labels, fold() != 1)
    rows = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
