"""Secret scans: pattern rules plus character Markov models compared by log-likelihood ratio.

Three pattern rules give the base spans. On every other long run of token characters, or what base spans leave of one,
two first-order Markov models, one of random strings and one of ordinary identifiers, are compared; where the mean
log-likelihood ratio per character passes a threshold, it is one more span. Both models are trained from labelled samples: the values that the rules
find and seeded random strings against the words of the corpus, joined as identifiers join them.

Null and empty texts have no spans; an empty table gives no rows, and its models are trained from random strings and
three built-in words. Long texts are scanned whole, in one walk over their runs and base spans. Rows are judged one by
one, so repeated rows and ids get equal results. A ratio that equals the threshold is no secret. Positions count code
points, with exclusive ends. Other columns are kept and never read; those named as a new one are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.rows import append_columns, bounded_sample, runs, text_view

# The base rules, in the order in which their kinds sort.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"passw", b"secret", b"token", b"api", b"akia")
LEAST_HEX = 24

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
#: The shortest length from which held-out joined words are flagged at most once in 1,000, and below which dates
#: (2024-01-15), hours (2024-01-15T10) and phone numbers (212-555-0037) lie, which the models flag.
LEAST_RUN = 14
FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_markov", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]
_CODES, _IS_HEX = np.zeros(256, np.uint8), np.zeros(256, bool)
_CODES[[ord(c) for c in ALPHABET]] = range(1, len(ALPHABET) + 1)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the pattern rules, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def codes(token: str) -> np.ndarray:
    return np.array([0, *(CODE[c] for c in token)])


def transitions(tokens: list[str]) -> np.ndarray:
    """Log probabilities of a character after another (0: the start), add-half smoothed."""
    counts = np.full((len(ALPHABET) + 1,) * 2, 0.5)
    for token in tokens:
        c = codes(token)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


class MarkovRatio:
    """Log-likelihood ratio, per character, of random strings against ordinary identifiers."""

    def __init__(self, secrets: list[str], ordinary: list[str], threshold: float = 0.35):
        self.table = transitions(secrets) - transitions(ordinary)
        self.threshold = threshold

    def score(self, token: str) -> float:
        c = codes(token)
        return float(self.table[c[:-1], c[1:]].mean())

    def is_secret(self, token: str) -> bool:
        return self.score(token) > self.threshold


def outside(start: int, end: int, covered: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """(parts of start:end outside the sorted disjoint spans ``covered``, the first of which to look at next).

    ``at`` is that of the call before, with a smaller start: a walk over a text passes each span once.
    """
    while at < len(covered) and covered[at][1] <= start:
        at += 1
    parts, k = [], at
    while k < len(covered) and covered[k][0] < end:
        if start < covered[k][0]:
            parts.append((start, covered[k][0]))
        start = max(start, covered[k][1])
        k += 1
    if start < end:
        parts.append((start, end))
    return parts, at


def union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The sorted disjoint spans that cover sorted ones."""
    covered: list[tuple[int, int]] = []
    for a, _, b in spans:
        if covered and a <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(b, covered[-1][1])
        else:
            covered.append((a, b))
    return covered


def labelled_samples(texts: list[str], size: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """(secrets, ordinary identifiers): what the rules find in the texts and random strings; joined words of the texts."""
    rng = random.Random(seed)
    words, secrets = set(), []
    for text in texts:
        spans = base_spans(text)
        secrets += ["".join(c for c in text[a:b] if c in CODE) for a, kind, b in spans if kind]
        covered, at = union(spans), 0
        for m in re.finditer(r"[A-Za-z]+", text):
            parts, at = outside(m.start(), m.end(), covered, at)
            if parts == [m.span()]:
                words.add(m[0])
    words = sorted(words)[:: max(1, len(words) // (5 * size))] or ["name", "value", "index"]
    alphabets = ("0123456789abcdef", ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62])
    secrets = secrets[: size // 2] + ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))) for _ in range(size)]
    ordinary = list(words)
    for _ in range(size):
        some = [rng.choice(words) for _ in range(rng.randint(2, 6))]
        joined = (
            "_".join(some), "-".join(some), "/".join(some), "".join(some), "_".join(some).upper(), "".join(w.capitalize() for w in some),
            f"{'_'.join(some)}_{rng.randint(0, 2030)}", rng.choice("-=_+/") * rng.randint(20, 60),
        )
        ordinary.append(rng.choice(joined))
    return secrets, ordinary


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 2000, sample_bytes: int = 32 << 20) -> MarkovRatio:
    """Fits the two models on a sample of at most ``sample_docs`` documents and ``sample_bytes``, drawn by a hash."""
    sample = bounded_sample(docs.select(doc_id, text), doc_id, text, sample_docs, sample_bytes)
    return MarkovRatio(*labelled_samples(sorted(r[0] or "" for r in sample.select(text).collect())))


def find_spans(text: str, model: MarkovRatio) -> list[tuple[int, int, int]]:
    """All spans of one text: the base spans, then Markov spans of what these leave of each run."""
    found = base_spans(text)
    more, covered, at = [], union(found), 0
    for m in RUN.finditer(text):
        if m.end() - m.start() >= LEAST_RUN:
            parts, at = outside(m.start(), m.end(), covered, at)
            more += [(a, 3, b) for a, b in parts if b - a >= LEAST_RUN and model.is_secret(text[a:b])]
    return sorted(found + more)


def candidates(data: np.ndarray, at: np.ndarray, model: MarkovRatio) -> np.ndarray:
    """Which texts may hold a span, and a few others: for the rest the walk over their runs would find nothing.

    Texts with a key word or a run that a base rule may take; and, where base spans leave the runs whole, those with a run
    whose mean ratio, from running sums over all bytes at once, isn't clearly below the threshold.
    """
    maybe = np.zeros(len(at) - 1, bool)
    if not len(data):
        return maybe
    lower = data.tobytes().lower()
    for word in KEYWORDS:
        i = lower.find(word)
        while i >= 0:
            row = int(np.searchsorted(at, i, "right")) - 1
            maybe[row] = True
            i = lower.find(word, int(at[row + 1]))
    starts, ends = runs(_IS_HEX[data], at)
    maybe[np.searchsorted(at, starts[ends - starts >= LEAST_HEX], "right") - 1] = True
    starts, ends = runs(_CODES[data] > 0, at)
    long = ends - starts >= LEAST_RUN
    starts, ends = starts[long], ends[long]
    codes = _CODES[data]
    total = np.concatenate(([0.0], np.cumsum(model.table[codes[:-1], codes[1:]])))  # at i: the ratios up to the pair that ends at i
    mean = (total[ends - 1] - total[starts] + model.table[0, codes[starts]]) / (ends - starts)
    maybe[np.searchsorted(at, starts[mean > model.threshold - 1e-6], "right") - 1] = True
    return maybe


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, model: MarkovRatio, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the counts, digest and spans of ``FIELDS``."""
    nothing = hashlib.sha256(b"").hexdigest()

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(part.schema.get_field_index(text))
            data, at = text_view(column)
            n = part.num_rows
            counts = np.zeros((n, 4), np.int64)
            digests, said = [nothing] * n, [""] * n
            for i in np.flatnonzero(candidates(data, at, model)).tolist():
                spans = find_spans(column[i].as_py(), model)
                counts[i] = np.bincount([kind for _, kind, _ in spans], minlength=4)
                digests[i] = hashlib.sha256(_say([s for s in spans if s[1] < 3]).encode()).hexdigest()
                said[i] = _say(spans)
            return [*map(pa.array, counts.T), pa.array(digests, pa.string()), pa.array(said, pa.string())]

        return work

    return append_columns(docs, text, FIELDS, make)


def redact(docs: DataFrame, model: MarkovRatio, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each span (joined where they overlap) replaced by ``mark``; null texts stay null."""

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(part.schema.get_field_index(text))
            out = column.to_pylist()
            for i in np.flatnonzero(candidates(*text_view(column), model)).tolist():
                said, pieces, end = out[i], [], 0
                for a, _, b in find_spans(said, model):
                    if a >= end:
                        pieces += [said[end:a], mark]
                    end = max(end, b)
                out[i] = "".join([*pieces, said[end:]])
            return [pa.array(out, pa.string())]

        return work

    return append_columns(docs, text, [T.StructField(text, T.StringType())], make).select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return scan(rows, train(rows)).select("doc_id", *[F.col(f.name) for f in FIELDS])
