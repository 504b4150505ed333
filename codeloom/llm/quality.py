"""Quality classifier: Bradley-Terry ranking of documents.

A document's score is a linear function of features of its text. Its weights come
from preference pairs (a good and a bad document): the logistic loss on the
difference of their features. The scale is then laid so that the quantile of the
scores at the share of bad documents falls on the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import id_and_text, map_texts, small_batches

THRESHOLD = 0.7
# The classifier is fitted on at most so many labelled documents of each class,
# those with the smallest hashes of their ids.
TRAIN_PER_CLASS = 10_000
PAIRS_PER_DOCUMENT = 8
HELD_OUT = 2  # remainder of crc32(doc_id as text) by 4

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "bars", "stops", "repeats",
    "top_word", "distinct", "lines", "long_words", "controls", "wide",
)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAKS = np.zeros(256, bool)
_BREAKS[[9, 10, 11, 12, 13, 32]] = True
_CONTROLS = np.zeros(256, bool)
_CONTROLS[[*range(0, 9), *range(14, 32), 127]] = True
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:?'\"()-!|"]] = True
_SYMBOLS = ~(_LETTERS | _BREAKS | _CONTROLS | _COMMON)
_SYMBOLS[48:58] = False


def features(text: bytes | None) -> np.ndarray:
    """The features of a whole text; a null text counts as empty."""
    text = text or b""
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, chars = len(words), max(1, len(text))
    folded = [w.lower() for w in words]
    counts: dict[bytes, int] = {}
    for w in folded:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = octets[_LETTERS].sum()
    few = n + 8  # ratios of short texts stay moderate
    return np.array(
        [
            np.log1p(n),
            np.log1p(letters / max(1, n)),
            octets[65:91].sum() / (letters + 16),
            octets[48:58].sum() / (chars + 16),
            octets[_SYMBOLS].sum() / (chars + 16),
            octets[33] / few,
            octets[124] / few,
            (octets[46] + octets[44]) / few,
            sum(map(bytes.__eq__, folded, folded[1:])) / few,
            max(counts.values(), default=0) / few,
            np.log((len(counts) + 8) / few),
            np.log((len(set(lines)) + 4) / (len(lines) + 4)),
            sum(len(w) > 40 for w in words) / few,
            octets[_CONTROLS].sum() / chars,
            octets[128:].sum() / chars,
        ]
    )


@dataclass(frozen=True)
class Model:
    """``score = sigmoid(level + (x - mean) / spread . weights)``, a plain value."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    level: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.spread) @ self.weights + self.level
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, bad_share: float, seed: int = 7) -> Model:
    """Weights from pairs of a good and a bad row; ``bad_share`` is the share of bad
    documents among all labelled ones, at which the quantile is taken.

    Without pairs (a class is missing) nothing is known against any document: all
    score the threshold.
    """
    level = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    spread = (x.std(axis=0) if len(x) else np.zeros(len(FEATURES))) + 1e-6
    weights = np.zeros(len(FEATURES))
    if good.all() or not good.any():
        return Model(mean, spread, weights, level + 1e-9)
    z = (x - mean) / spread
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = PAIRS_PER_DOCUMENT * max(len(better), len(worse))
    apart = z[draw.choice(better, n)] - z[draw.choice(worse, n)]
    for _ in range(30):  # Newton's method on the mean logistic loss with a small ridge
        p = 1 / (1 + np.exp(np.clip(apart @ weights, -500, 500)))
        slope = 1e-4 * weights - apart.T @ p / n
        curve = (apart * (p * (1 - p))[:, None]).T @ apart / n + 1e-4 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    raw = z @ weights
    # weighted quantile: the classes count as in all labels, not as in the sample
    weight = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, bad_share * (1 - 1e-9))), len(order) - 2)
    cut = (raw[order[at]] + raw[order[at + 1]]) / 2
    return Model(mean, spread, weights, level - float(cut))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on ``labels(doc_id, quality)`` outside the held-out fold.

    Labels that contradict each other, are null or belong to no document are left
    out. At most ``2 * TRAIN_PER_CLASS`` rows of features reach the driver.
    """
    known = (
        labels.filter(~held_out() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter(F.col("quality") == F.col("most"))
        .select("doc_id", "quality")
    )
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for quality in (0, 1):
        some = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id")
        some = some.limit(TRAIN_PER_CLASS)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.join(F.broadcast(picked), docs[id_col] == picked["doc_id"], "left_semi")
    rows = (
        map_texts(
            id_and_text(sample, id_col, text_col),
            lambda text: (features(text).tolist(),),
            {"x": "array<double>"},
            pa.schema([("x", pa.list_(pa.float64()))]),
        )
        # of several texts of one id the model always sees the same one
        .groupBy("id")
        .agg(F.min("x").alias("x"))
        .join(F.broadcast(picked), F.col("id") == F.col("doc_id"))
        .select("id", "quality", "x")
        .toArrow()
        .sort_by("id")
    )
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(rows), len(FEATURES))
    good = np.array(rows.column("quality").to_pylist(), np.int64) == 1
    share = totals.get(0, 0) / max(1, sum(totals.values()))
    return fit(x, good, share)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` per row, from the whole text alone."""
    return map_texts(
        id_and_text(docs, id_col, text_col),
        lambda text: (float(model.score(features(text))),),
        {"score": "double"},
        pa.schema([("score", pa.float64())]),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            good = [model.score(features(t)) >= threshold for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
