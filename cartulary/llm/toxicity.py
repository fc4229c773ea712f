"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in its hashed words and their beginnings; a document's is the noisy-or of its
sentences'. The weights are trained from document labels alone, by gradient descent on a bounded sample, for features
that positive documents have more often than chance gives. Scoring the sentences then locates the offending ones.

Null and empty texts have no sentence and score the noisy-or of none, 0. Whole texts are scored, however long, in
vectorised passes over their bytes. Of sentences with equal scores the first is the worst. Labels of the held-out fold
are never read; without any label every score is 0 (to rounding). Null ids are not held out and never learned from;
repeated rows get equal scores and are learned from once. An empty table gives no rows. Other columns are kept and
never read; those named as a new one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.labelled import batches, held_out, training_rows
from cartulary.llm.rows import append_columns, documents, runs, span_hashes, text_view

BUCKETS, PREFIXES = 1 << 20, (5, 6, 7, 8, 9, 10)
FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("n_sentences", T.LongType()),
    T.StructField("n_offending", T.LongType()),
    T.StructField("worst_sentence", T.StringType()),
]
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its sentence, text of each sentence, byte starts, byte ends): of sentences with words.

    The features are the words and their beginnings of some sizes in bytes, which catch inflected words.
    """
    data, at = text_view(column)
    starts, ends = runs(_WORD[data], at)
    of_text = np.searchsorted(at, starts, "right") - 1
    number = np.concatenate(([0], np.cumsum(_STOP[data])))[starts] + of_text  # grows with each stop and each text
    _, first, sentence = np.unique(number, return_index=True, return_inverse=True)
    last = np.concatenate((first[1:], [len(starts)])) - 1 if len(first) else first
    owners, hashes = [sentence], [span_hashes(_LOWER[data], starts, ends)]
    for size in PREFIXES:
        some = ends - starts >= size
        owners.append(sentence[some])
        hashes.append(span_hashes(_LOWER[data], starts[some], starts[some] + size) ^ np.uint64(size))
    owner, hashes = np.concatenate(owners), np.concatenate(hashes)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), owner, of_text[first], starts[first], ends[last] if len(first) else ends[:0]


@dataclass
class NoisyOr:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n sentences from their features."""
        z = np.bincount(sentence, self.weights[words], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def combine(p: np.ndarray, of_text: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or over the sentences of each of n texts."""
    return 1 - np.exp(np.bincount(of_text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def telling(labels: np.ndarray, texts: pa.Array, most: int, least_docs: int) -> np.ndarray:
    """Which buckets occur in positive documents clearly more often than chance would have it: ``most`` of them."""
    done = 0
    positive, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for column in batches(texts):
        words, sentence, of_text, _, _ = sentences(column)
        key = np.unique(of_text[sentence] * BUCKETS + words)
        every += np.bincount(key % BUCKETS, minlength=BUCKETS)
        positive += np.bincount(key[labels[done + key // BUCKETS] > 0] % BUCKETS, minlength=BUCKETS)
        done += len(column)
    chance = np.maximum(every * labels.mean(), 1e-9) if len(labels) else every
    z = np.where(positive >= least_docs, (positive - chance) / np.sqrt(np.maximum(chance, 1e-9)), 0)
    order = np.argsort(-z, kind="stable")[:most]
    return order[z[order] >= 4]


def fit(labels: np.ndarray, texts: pa.Array, steps: int = 250, rate: float = 0.05, decay: float = 1e-4, least_docs: int = 6, most_features: int = 4096) -> NoisyOr:
    """Learns from labelled texts by full-batch Adam on the documents' log loss."""
    model = NoisyOr(np.zeros(BUCKETS), -30.0)
    used = telling(labels, texts, most_features, least_docs)
    if not len(used):
        return model
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    words, of_sentence, of_doc, n_sentences, n_docs = [], [], [], 0, 0
    for column in batches(texts):
        w, s, t, _, _ = sentences(column)
        kept = place[w] >= 0
        words.append(place[w[kept]])
        of_sentence.append(s[kept] + n_sentences)
        of_doc.append(t + n_docs)
        n_sentences += len(t)
        n_docs += len(column)
    words, of_sentence, of_doc = map(np.concatenate, (words, of_sentence, of_doc))
    labels = labels.astype(float)
    b = np.log(min(max(labels.mean(), 1e-3), 0.5) / max(1.0, n_sentences / n_docs))
    w = np.zeros(len(used))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of_sentence, w[words], minlength=n_sentences) + b, -30, 30)))
        p = np.minimum(p, 1 - 1e-9)
        none = np.exp(np.bincount(of_doc, np.log1p(-p), minlength=n_docs))
        pull = np.where(labels > 0, -none / np.maximum(1 - none, 1e-6), 1.0)
        gradient = np.clip(pull[of_doc] * p, -1, 1)
        g = np.append(np.bincount(words, gradient[of_sentence], minlength=len(used)) / n_docs + decay * np.sign(w), gradient.sum() / n_docs)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights[used], model.bias = w, float(b)
    return model


def score(docs: DataFrame, model: NoisyOr, text: str = "text", offending: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with ``FIELDS``: sentences at ``offending`` or more are counted, the worst is located.

    ``worst_sentence`` is start:end in UTF-8 bytes of the sentence with the highest probability, the first of equals;
    null without sentences.
    """
    used = np.flatnonzero(model.weights)
    values = model.weights[used]
    bias = model.bias

    def make():
        own = NoisyOr(np.zeros(BUCKETS), bias)
        own.weights[used] = values

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column, n = part.column(part.schema.get_field_index(text)), part.num_rows
            words, sentence, of_text, starts, ends = sentences(column)
            p = own.sentence_scores(words, sentence, len(of_text))
            _, at = text_view(column)
            order = np.lexsort((-np.arange(len(p)), p, of_text))
            last = order[np.concatenate((np.flatnonzero(np.diff(of_text[order])), [len(order) - 1]))] if len(order) else order
            worst: list[str | None] = [None] * n
            for k in last.tolist():
                worst[of_text[k]] = f"{starts[k] - at[of_text[k]]}:{ends[k] - at[of_text[k]]}"
            return [pa.array(combine(p, of_text, n)), pa.array(np.bincount(of_text, minlength=n)), pa.array(np.bincount(of_text[p >= offending], minlength=n)), pa.array(worst, pa.string())]

        return work

    return append_columns(docs, text, FIELDS, make)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 12000) -> NoisyOr:
    """Fits the model on at most ``sample_docs`` labelled documents, and ``labelled.MOST_BYTES`` of text."""
    return fit(*training_rows(docs, labels, "toxic", sample_docs))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    scored = score(rows, train(rows, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_sentence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
