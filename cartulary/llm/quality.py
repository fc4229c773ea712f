"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text (sizes, shares of kinds of characters, repetition) is cut into quantile bins. Cyclic boosting
fits one shallow tree to one feature at a time and adds it to the feature's lookup table; then pairs of features whose
joint bins explain most of what is left get two-way tables in the same way. A text's score is the logistic of the sum of
its bins' entries, so scoring is a few table look-ups for each row of a slice.

Null and empty texts have the features of an empty text and a score as any other. Texts are measured whole, however
long. Labels of the held-out fold are never read. Without two classes of labels, every score is the share of positive
ones (0.5 if there are none, at least 0.001 and at most 0.999). Ties: of equal cuts the first wins, of equal pairs of
features the first in order. Null ids are not held out and never learned from; repeated rows get equal scores and are
learned from once. An empty table gives no rows. Other columns are kept and never read; one named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.labelled import batches, held_out, training_rows
from cartulary.llm.rows import append_columns, documents, runs, span_hashes, sums, text_view

FIELDS = [T.StructField("score", T.DoubleType())]
_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".?;:,",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@~^_=+<>{}[]\\/",
    "space": b" \t",
    "line": b"\n",
    "wide": range(128, 256),
}
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _lookup(kind) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(kind)] = True
    return table


_TABLES = {name: _lookup(kind) for name, kind in _KINDS.items()}


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each of n owners."""
    key = np.unique((hashes >> np.uint64(20)) | (owner.astype(np.uint64) << np.uint64(44)))
    return np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    data, at = text_view(column)
    n = len(column)
    size = np.diff(at)
    per = np.maximum(size, 1)
    starts, ends = runs(~_SPACE[data], at)
    of = np.searchsorted(at, starts, "right") - 1
    words = np.bincount(of, minlength=n)
    many = np.maximum(words, 1)
    hashes = span_hashes(data, starts, ends)
    same = of[1:] == of[:-1]
    pairs = hashes[1:] * np.uint64(3) + hashes[:-1] if len(hashes) else hashes
    line_starts, line_ends = runs(~_TABLES["line"][data], at)
    line_of = np.searchsorted(at, line_starts, "right") - 1
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    long = ends - starts
    out = [np.log1p(size), np.log1p(words), np.bincount(of, long, minlength=n) / many, np.bincount(of, long <= 3, minlength=n) / many, np.bincount(of, long >= 12, minlength=n) / many]
    out += [sums(table[data].astype(np.int8), at) / per for table in _TABLES.values()]
    out += [_distinct(hashes, of, n) / many, _distinct(pairs[same], of[1:][same], n) / np.maximum(words - 1, 1)]
    out += [_distinct(span_hashes(data, line_starts, line_ends), line_of, n) / lines, np.log1p(size / lines)]
    out += [np.bincount(of[1:], same & (hashes[1:] == hashes[:-1]), minlength=n) / many if len(hashes) else np.zeros(n)]
    first = data[starts] if len(starts) else starts
    out += [np.bincount(of, _TABLES["upper"][first], minlength=n) / many if len(starts) else np.zeros(n)]
    return np.stack(out, 1)


@dataclass
class Additive:
    """Cut points of each feature, tables of single features and of pairs, and the intercept."""

    cuts: list[np.ndarray]
    singles: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, j], "right") for j, cut in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.singles):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-z))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, size of the left part) of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree of a depth that is fitted to gradient and curvature sums of the bins."""
    gain, k = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the best tree that cuts the rows once and then each part's columns once."""
    best = (0.0, np.zeros_like(g))
    for k in range(1, len(g)):
        parts, gain = [], -(g.sum() ** 2) / (h.sum() + 1)
        for part_g, part_h in ((g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))):
            more, c = _best_cut(part_g, part_h)
            gain += part_g.sum() ** 2 / (part_h.sum() + 1) + max(more, 0)
            parts.append(np.concatenate([np.full(c, _leaf(part_g[:c].sum(), part_h[:c].sum())), np.full(len(part_g) - c, _leaf(part_g[c:].sum(), part_h[c:].sum()))]))
        if gain > best[0]:
            best = (gain, np.concatenate([np.tile(parts[0], (k, 1)), np.tile(parts[1], (len(g) - k, 1))]))
    return best


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1) -> Additive:
    """Cyclic boosting of single features, then of the pairs with the largest remaining gain."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(y) else np.empty(0) for j in range(x.shape[1])]
    coarse = 4
    model = Additive(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(share / (1 - share))), coarse)
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.singles):
            p = 1 / (1 + np.exp(-z))
            step = rate * shallow_tree(np.bincount(b[:, j], y - p, len(table)), np.bincount(b[:, j], p * (1 - p), len(table)), 2)
            table += step
            z += step[b[:, j]]
    small = b // coarse
    sides = [int(s.max()) + 1 for s in (np.arange(len(t)) // coarse for t in model.singles)]

    def tables(i, j):
        p = 1 / (1 + np.exp(-z))
        at, shape = small[:, i] * sides[j] + small[:, j], (sides[i], sides[j])
        return [np.bincount(at, v, sides[i] * sides[j]).reshape(shape) for v in (y - p, p * (1 - p))]

    gains = sorted(((cross_tree(*tables(i, j))[0], i, j) for i in range(len(sides)) for j in range(i) if min(sides[i], sides[j]) > 1), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j, np.zeros((sides[i], sides[j]))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * cross_tree(*tables(i, j))[1]
            table += step
            z += step[small[:, i], small[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 12000) -> Additive:
    """Fits the model on about ``sample_docs`` labelled documents at most."""
    known, texts = training_rows(docs, labels, "quality", sample_docs)
    parts = [features(column) for column in batches(texts)]
    x = np.concatenate(parts) if parts else features(pa.array([""]))[:0]
    return fit(x, known.astype(float))


def score(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``score``, the probability of good quality."""

    def make():
        return lambda part: [pa.array(model.score(features(part.column(part.schema.get_field_index(text)))))]

    return append_columns(docs, text, FIELDS, make)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    scored = score(rows, train(rows, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
