"""Language ID by hyperdimensional profiles.

Every letter symbol has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors,
each rotated by its place; a text's vector bundles (sums) its trigram vectors, weighted by the root of their counts;
a language's prototype bundles the unit vectors of its documents. The prediction is the language whose prototype has
the largest cosine with the text.

Learning uses rows with a language and, in the query, only those whose crc32 of the id leaves no remainder 2 modulo 4:
at most ``sample_docs`` distinct ones and ``sample_bytes`` of text, drawn by a hash of id and text. A text that is null
or has no letter gets ``und`` and score 0; so does every text if no row with a language can be learned from. Ties go to
the smaller name. Long texts are counted whole, piece by piece. Repeated rows get equal predictions and are learned from
once; an empty table gives no rows. Other columns are kept and never used; those named as a new one are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.rows import append_columns, bounded_sample, slices

SYMBOLS, DIMENSION, SEED = 64, 1024, 11
#: Texts and trigrams whose weights are held at once.
ROWS, CODES = 512, 4096
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


@functools.cache
def symbols() -> np.ndarray:
    """Symbol of each code point: 0 for no letter, 1 to 26 for a to z in either case, a hash for other letters."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 0x9E3779B1 % (1 << 32) % (SYMBOLS - 27)
    return table


@functools.cache
def letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSION))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    v = letters()
    a, b, c = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v
    return (a[codes >> 12] * b[(codes >> 6) & 63] * c[codes & 63]).astype(np.float32)


def trigrams(text: str, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams around the letters of a text, their numbers); long texts are counted piece by piece."""
    table = symbols()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = None
    for a in range(0, len(points), piece):
        s = np.zeros(min(piece, len(points) - a) + 2, np.int64)
        low, high = max(0, a - 1), min(len(points), a + piece + 1)
        s[1 - (a - low) : 1 - (a - low) + high - low] = table[points[low:high]]
        keys = ((s[:-2] << 12) | (s[1:-1] << 6) | s[2:])[s[1:-1] > 0]
        if len(points) <= piece:
            return np.unique(keys, return_counts=True)
        total = np.bincount(keys, minlength=SYMBOLS**3) + (0 if total is None else total)
    codes = np.empty(0, np.int64) if total is None else np.flatnonzero(total)
    return codes, codes if total is None else total[codes]


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the texts, which of the texts have a letter).

    Computed for ROWS texts and CODES trigrams at once, so that memory stays bounded whatever the texts are.
    """
    counted = [trigrams(x or "") for x in texts]
    some = np.array([len(codes) > 0 for codes, _ in counted], bool)
    out = np.zeros((len(texts), DIMENSION), np.float32)
    for at in range(0, len(texts), ROWS):
        part = counted[at : at + ROWS]
        rows = np.repeat(np.arange(len(part)), [len(codes) for codes, _ in part])
        codes, columns = np.unique(np.concatenate([codes for codes, _ in part]), return_inverse=True)
        values = np.sqrt(np.concatenate([n for _, n in part]))
        for low in range(0, len(codes), CODES):
            here = (columns >= low) & (columns < low + CODES)
            weights = np.zeros((len(part), min(CODES, len(codes) - low)), np.float32)
            weights[rows[here], columns[here] - low] = values[here]
            out[at : at + ROWS] += weights @ trigram_vectors(codes[low : low + CODES])
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, some


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 20000, sample_bytes: int = 256 << 20) -> tuple[list[str], np.ndarray]:
    """(languages, their unit prototypes), from a bounded sample of the rows that have a language."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = bounded_sample(rows, "doc_id", "text", sample_docs, sample_bytes).select("lang", "text")

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                vectors, some = profiles(part.column(1).to_pylist())
                named = np.array(part.column(0).to_pylist())
                for name in set(named[some].tolist()):
                    total[name] = total.get(name, 0) + vectors[some & (named == name)].sum(0, dtype=np.float64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.float64()))], names=["lang", "bundle"])

    summed: dict[str, np.ndarray] = {}
    for name, vector in sorted(map(tuple, rows.mapInArrow(bundle, "lang string, bundle array<double>").collect())):
        summed[name] = summed.get(name, 0) + np.array(vector)
    names = sorted(summed)
    matrix = np.array([summed[x] / max(np.linalg.norm(summed[x]), 1e-9) for x in names]).reshape(len(names), DIMENSION)
    return names, matrix.astype(np.float32)


def predict(docs: DataFrame, prototypes: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, the cosine with the prototype (0 to 1)."""
    names, matrix = prototypes

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            vectors, some = profiles(part.column(part.schema.get_field_index(text)).to_pylist())
            if not names:
                return [pa.array(["und"] * part.num_rows), pa.array(np.zeros(part.num_rows))]
            cosines = vectors @ matrix.T
            best = cosines.argmax(1)
            score = np.where(some, np.clip(cosines.max(1), 0, 1), 0.0).astype(np.float64)
            return [pa.array([names[b] if ok else "und" for b, ok in zip(best, some)]), pa.array(score)]

        return work

    return append_columns(docs, text, FIELDS, make)


def op7(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out"))
    prototypes = train(rows.where("not held_out"))
    return predict(rows.drop("lang"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
