"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers look at each whole text and vote junk, clean or nothing. Expectation-maximisation estimates how
often each labeller votes what for either class, from the histogram of vote patterns over all documents: that
histogram is bounded (3 to the number of labellers) and is all that the driver sees. Posterior labels then train a
logistic scorer on hashed features: byte 4-grams and binned statistics. The scorer decides.

The scorer is fitted on a bounded sample: the `sample` documents of each class whose hash of id and text is smallest.

Edge cases: null and wordless texts have no features, score 0 and are kept; repeated rows and ties get equal scores; an
empty table gives an empty result; all other columns pass through, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knnspark.llm.common import U64, Scratch, mix, prefix_sums, prepare, slices, span_hash, utf8, words

GRAMS, BINS = 1 << 11, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]=_~^\\@+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[ord("."), ord("?"), ord("!")]] = True
#: Of each statistic: name, what counts as clean below, what counts as junk above.
LABELLERS = (
    ("symbols a word", 0.05, 0.22),
    ("upper-case share of letters", 0.08, 0.30),
    ("words that repeat the word before", 0.05, 0.20),
    ("word pairs that occurred before", 0.15, 0.45),
    ("exclamation marks a word", 0.05, 0.25),
    ("share of the commonest word", 0.10, 0.30),
)
STATS = len(LABELLERS)
#: A labeller may call this share of clean documents junk at most; else the model could take one fault for a second clean class.
FALSE_ALARM = 0.001
#: Log odds of junk above which a text is rejected; training weighs both classes alike, so 0 would reject too much.
REJECT = 1.0
#: Fewer words than this say too little to vote on.
FEW = 8


def statistics(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics for each text, and its number of words."""
    a, b, first = words(buf, offsets)
    n = np.diff(first)
    most = np.maximum(n, 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    out = np.zeros((len(n), STATS))
    out[:, 0] = share(_SYMBOL[buf]) / most
    out[:, 1] = share(_UPPER[buf]) / np.maximum(share(_LETTER[buf]), 1)
    out[:, 4] = share(buf == ord("!")) / most
    h = span_hash(prefix_sums(buf), a, b)
    same = np.zeros(len(h) + 1, np.int64)
    same[2:] = np.cumsum(h[1:] == h[:-1])
    pairs = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if y - x > 1:
            out[i, 2] = (same[y] - same[x + 1]) / (y - x)
            out[i, 3] = 1 - len(np.unique(pairs[x : y - 1])) / (y - x - 1)
            out[i, 5] = np.unique(h[x:y], return_counts=True)[1].max() / (y - x)
    return out, n


def votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 for junk, -1 for clean, 0 for neither."""
    low, high = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    out = (stats > high).astype(np.int64) - (stats < low)
    out[n < FEW] = 0
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ 3 ** np.arange(STATS)


def unpack(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(STATS) % 3 - 1


def weak_labels(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of junk for each vote pattern; and P(vote | class): labeller, class, vote + 1.

    A junk vote from any labeller starts a pattern as junk: labellers look for different faults, so a majority would miss all of them.
    """
    p = np.array(sorted(counts), np.int64)
    if not len(p):
        return {}, np.full((STATS, 2, 3), 1 / 3)
    weight, v = np.array([counts[x] for x in p.tolist()], float), unpack(p)
    junk = np.where((v > 0).any(1), 0.9, 0.05)
    rates = np.zeros((STATS, 2, 3))
    for _ in range(rounds):
        for k, share in enumerate((1 - junk, junk)):
            for vote in (-1, 0, 1):
                rates[:, k, vote + 1] = 0.5 + ((v == vote) * (weight * share)[:, None]).sum(0)
            rates[:, k] /= rates[:, k].sum(1, keepdims=True)
        rates[:, 0, 2] = np.minimum(rates[:, 0, 2], FALSE_ALARM)
        prior = min(0.5, max(1e-6, (weight * junk).sum() / weight.sum()))
        log = np.log(rates)
        log[:, :, 1] = 0  # no vote is no evidence
        score = [math.log(x) + sum(log[j, k, v[:, j] + 1] for j in range(STATS)) for k, x in enumerate((1 - prior, prior))]
        then = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(then - junk).max() < 1e-9:
            break
        junk = then
    return dict(zip(p.tolist(), junk.tolist(), strict=True)), rates


def features(buf: np.ndarray, offsets: np.ndarray, stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hashed row for each text: square-rooted shares of byte 4-grams, then one-hot bins of each statistic."""
    rows = len(n)
    out = np.zeros((rows, GRAMS + STATS * BINS), np.float32)
    if len(buf) >= 4:
        x = buf.astype(np.uint32)
        gram = x[:-3] | (x[1:-2] << 8) | (x[2:-1] << 16) | (x[3:] << 24)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        whole = row[:-3] == row[3:]
        at = row[:-3][whole] * GRAMS + (gram[whole] * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
        counts = np.bincount(at, minlength=rows * GRAMS).reshape(rows, GRAMS)
        out[:, :GRAMS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    edges = np.array([0.01, 0.03, 0.08, 0.15, 0.22, 0.3, 0.5])
    bins = np.searchsorted(edges, stats)
    bins[n < FEW] = 0
    out[np.arange(rows)[:, None], GRAMS + np.arange(STATS) * BINS + bins] = 1
    return out


#: The added column; its name clashes with none.
QUALITY = "__quality"


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, (x * self.weights).sum(1) + self.bias, 0.0)  # row by row: no result depends on its batch


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Scorer:
    """Logistic regression by Adam; y: posterior labels. Classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(y):
        return Scorer(w, b)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = y / share + (1 - y) / (1 - share)
    x = x.astype(np.float32)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        g = weight * (p - y) / len(y)
        grad = np.append(x.T @ g.astype(np.float32) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Scorer(w, b)


def _chunks(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple]:
    for b in batches:
        buf, offsets = utf8(b.column(text_col))
        for i, j in slices(offsets, 1_000_000):
            part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield b.slice(i, j - i), part, at, *statistics(part, at)


@dataclass
class Model:
    posterior: dict[int, float]  # of vote patterns
    rates: np.ndarray
    scorer: Scorer


def fit(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, stats, n in _chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(pattern(votes(stats, n)).astype(np.int32))], names=["h", "pattern"])

    voted = scratch.keep(keyed.mapInArrow(vote, "h long, pattern int"))
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    posterior, rates = weak_labels(counts)
    junk = [p for p, x in posterior.items() if x >= 0.5]
    of_class = [voted.filter(F.col("pattern").isin(junk) if k else ~F.col("pattern").isin(junk)).select("h", "pattern").distinct().orderBy("h").limit(sample) for k in (0, 1)]
    chosen = {r["h"]: posterior[r["pattern"]] for part in of_class for r in part.collect()}
    ids = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, at, stats, n in _chunks(batches, "text"):
            x = features(part, at, stats, n)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "x"])

    got = keyed.join(F.broadcast(ids), "h", "left_semi").mapInArrow(feature, "h long, x binary").dropDuplicates(["h"]).orderBy("h").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, GRAMS + STATS * BINS)
    y = np.array([chosen[h] for h in got.column("h").to_pylist()])
    scratch.close()
    return Model(posterior, rates, train(x, y))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, and one struct column `QUALITY`: posterior (weak label), score (log odds of junk), kept.

    A column that is called `QUALITY` already is replaced.
    """
    prepare(docs.sparkSession)
    kind = pa.struct([("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])
    table = np.full(3**STATS, 0.0)
    for p, x in model.posterior.items():
        table[p] = x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, at, stats, n in _chunks(batches, held):
            s = np.concatenate([model.scorer.score(features(part[at[i] : at[j]], at[i : j + 1] - at[i], stats[i:j], n[i:j]), n[i:j]) for i, j in ((k, min(k + 512, len(n))) for k in range(0, len(n), 512))])
            q = pa.StructArray.from_arrays([pa.array(table[pattern(votes(stats, n))]), pa.array(s), pa.array(s <= REJECT)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], q], names=[*b.schema.names[:-1], QUALITY])

    docs = docs.drop(QUALITY)
    held = "__text" + "_" * max([0, *(len(c) for c in docs.columns if c.startswith("__text"))])
    schema = T.StructType([*docs.schema.fields, T.StructField(QUALITY, T.StructType([T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]))])
    return docs.withColumn(held, F.col(text_col)).mapInArrow(run, schema)


def classify(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, sample, id_col, text_col))
