"""Document fingerprints from prefix polynomial hashes.

Prefix arrays of a polynomial in the code points, modulo a Mersenne prime and for two bases, give the hash of any span in
constant time. Equal hashes stand for equal spans, and longest common extensions follow by binary search on their length.

A text's fingerprint is its length, the hash of the whole, and the smallest hashes of its spans of 16 code points (of 4
or 1 for short texts) in order. Equal texts have equal fingerprints. The likeness of two fingerprints is 1 if they are equal,
else the share of common spans, 2 J / (1 + J) for the Jaccard similarity J estimated from the smallest hashes; further
copies of a span in a text count as spans of their own. Where a short and a long text have no size of spans in common, the
long one's spans of the short one's size are taken for the comparison; they are not part of its fingerprint.

Each text is also compared with the next document's in ascending order of ids (after the last, the first; rows with one
id in the order of 64-bit hashes of their texts) and with its own edited text, whose last quarter is replaced by the next's beginning. The
order is made by dealing ranges of ids, one for 2,000 rows up to 100,000 ranges, larger ones beyond; the first document
of a range is sent to the range before it too, so no task holds more than a range and a row, which it reads slice by
slice. An id that fills several ranges is cut by the hashes of its texts; only its equal texts are always together.

A null text is empty. A row with a null id has no next: its text is not edited and ``near_next`` is 0. The only row of a
table is its own next. Repeated rows have equal fingerprints. Long texts are hashed whole. Ties: a span's further copies
are told apart by their number only, so their order doesn't matter. Only the columns for id and text are read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.rows import mix, slices

PRIME = (1 << 31) - 1
BASES = (1_000_003_999 % PRIME, 48_271)
KEPT = 64
#: (size of the spans, sizes of the texts from and below which they are used): neighbours overlap, so that a text can be
#: compared with one of nearly its size.
SCALES = ((16, 64, 1 << 62), (4, 16, 128), (1, 1, 32))
ROWS_A_RANGE, MOST_RANGES = 2000, 100_000
_TABLES: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, by doubling."""
    table = _TABLES.get(base, np.ones(1, np.int64))
    while len(table) < n:
        table = np.concatenate((table, reduced(table * pow(base, len(table), PRIME))))
    _TABLES[base] = table
    return table[:n]


class SpanIndex:
    """Hashes of the spans of a sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n, self.prefix, self.back = len(points), [], []
        for base in BASES:
            terms = reduced((points.astype(np.int64) + 1) * powers(base, self.n))
            self.prefix.append(reduced(np.concatenate((np.zeros(1, np.int64), np.cumsum(terms)))))
            self.back.append(powers(pow(base, -1, PRIME), self.n + 1))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans; equal spans have equal ones wherever they are."""
        both = [reduced((p[end] - p[start] + PRIME) * b[start]) for p, b in zip(self.prefix, self.back)]
        return (both[0] << 31) | both[1]

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.hash(i, i + size) == self.hash(j, j + size)

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The size of the longest equal spans at i and j, ``most`` at the most, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i, j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def sketches(index: SpanIndex, at: np.ndarray) -> list[tuple]:
    """(size, hash, smallest span hashes of each scale) of consecutive texts."""
    whole = index.hash(at[:-1], at[1:])
    out = []
    for a, n, h in zip(at.tolist(), np.diff(at).tolist(), whole.tolist()):
        spans = []
        for size, least, most in SCALES:
            spans.append(_spans(index, a, n if least <= n < most else 0, size))
        out.append((n, h, *spans))
    return out


def _spans(index: SpanIndex, a: int, n: int, size: int) -> np.ndarray:
    k = np.arange(a, a + max(0, n - size + 1))
    return _smallest(mix(index.hash(k, k + size).astype(np.uint64)))


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The KEPT smallest values, sorted, with a hash of its own for each further copy of a span."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    place = np.arange(len(hashes))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    hashes = mix(hashes + copy.astype(np.uint64)) >> np.uint64(32)
    if len(hashes) > KEPT:
        hashes = np.partition(hashes, KEPT)[:KEPT]
    return np.sort(hashes).astype(np.uint32)


def _shared(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:KEPT]
    j = sum(h in x and h in y for h in least) / len(least)
    return 2 * j / (1 + j)


def likeness(a, b, index: SpanIndex, at: tuple[int, int]) -> float:
    """From 0 to 1; 1 only for equal fingerprints or sets of spans. ``at``: where the two texts start in the index."""
    if a[:2] == b[:2]:
        return 1.0
    if not (a[0] and b[0]):
        return 0.0
    for k in range(2, 2 + len(SCALES)):
        if len(a[k]) and len(b[k]):
            return _shared(a[k], b[k])
    shorter = min(a, b, key=lambda x: x[0])
    size = next(SCALES[k][0] for k in range(len(SCALES)) if len(shorter[2 + k]))
    return _shared(*(_spans(index, start, x[0], size) for start, x in zip(at, (a, b))))


def said(fingerprint) -> str:
    n, whole, *spans = fingerprint
    return f"{n:x}.{whole:016x}." + ".".join(s.astype(">u4").tobytes().hex() for s in spans)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _work(ids: list, texts: list[str], nexts: list[str | None]) -> pa.RecordBatch:
    """One row for each text from it and the next one."""
    own, following = [_points(x) for x in texts], [None if x is None else _points(x) for x in nexts]
    quarter = [len(p) // 4 for p in own]
    edited = [p if f is None or not q else np.concatenate((p[: len(p) - q], f[:q])) for p, f, q in zip(own, following, quarter)]
    changed = [x if y is None or not q else x[: len(x) - q] + y[:q] for x, y, q in zip(texts, nexts, quarter)]
    parts = [*own, *edited, *(np.empty(0, np.uint32) if f is None else f for f in following)]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    index = SpanIndex(np.concatenate(parts))
    prints, n = sketches(index, at), len(texts)
    mine, other, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
    sizes, starts = np.diff(at), at[:-1]
    same = [index.extension(starts[:n], starts[k * n : (k + 1) * n], np.minimum(sizes[:n], sizes[k * n : (k + 1) * n])) for k in (1, 2)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(sizes[:n]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array(map(said, mine)), pa.array(map(said, other)),
            pa.array([likeness(mine[k], other[k], index, (starts[k], starts[n + k])) for k in range(n)]),
            pa.array([0.0 if nexts[k] is None else likeness(mine[k], after[k], index, (starts[k], starts[2 * n + k])) for k in range(n)]),
            pa.array(same[0]), pa.array(same[1]),
        ],
        names=SCHEMA.names,
    )


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("prefix_edited", T.LongType()),
        T.StructField("prefix_next", T.LongType()),
    ]
)


def _stream(batches):
    """Rows (range, kind, id, text) sorted; kind 0: in the chain, 1: only the next of the row before, 2: not in it."""
    held = None
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            rows = list(zip(*(part.column(k).to_pylist() for k in range(4))))
            if held is not None:
                rows.insert(0, held)
            held = rows.pop()
            yield from _linked([*rows, held], len(rows))
    if held is not None:
        yield from _linked([held], 1)


def _linked(rows: list[tuple], n: int):
    some = [(row[2], row[3], rows[k + 1][3] if row[1] == 0 and k + 1 < len(rows) else None) for k, row in enumerate(rows[:n]) if row[1] != 1]
    if some:
        yield _work(*map(list, zip(*some)))


class Ranges:
    """Ranges of documents in the order of their ids, and of the hashes of their texts within one id.

    ``cuts`` are the ids at which ranges begin. An id that is there k times fills about k ranges: it is cut by hashes into
    k, and the ids between it and the next cut have one more. Such ranges may be empty; ``settle`` is told which aren't.
    """

    def __init__(self, cuts: list[int]):
        self.ids, self.parts = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.hot = self.parts > 1
        each = self.parts + self.hot
        self.offset = np.cumsum(each) - each
        self.used = self.offset[~self.hot]
        self.first: dict[int, tuple[int, int]] = {}

    def settle(self, first: dict[int, tuple[int, int]]) -> None:
        """Takes the first (id, hash) of each range around a hot id that isn't empty."""
        self.first = first
        self.used = np.sort(np.concatenate((self.used, np.array(list(first), np.int64))))

    def __len__(self) -> int:
        return len(self.used)

    def place(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range before empty ones are left out, whether it is around a hot id)."""
        k = np.maximum(np.searchsorted(self.ids, ids, "right") - 1, 0)
        parts = self.parts[k]
        share = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(11)  # in the order of the hashes, 53 bits
        sub = np.minimum((share * (parts / 2.0**53)).astype(np.int64), parts - 1)
        return self.offset[k] + np.where(self.hot[k], np.where(self.ids[k] == ids, sub, parts), 0), self.hot[k]

    def deal(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, whether the document is the range's first)."""
        where, hot = self.place(ids, hashes)
        head = ~hot & (ids == self.ids[np.maximum(np.searchsorted(self.ids, ids, "right") - 1, 0)])
        for k in np.flatnonzero(hot).tolist():
            head[k] = self.first.get(int(where[k])) == (ids[k], hashes[k])
        return np.searchsorted(self.used, where), head


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of ``SCHEMA`` for each row of ``docs``; ``prefix_*`` are the sizes of the longest common beginnings."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.where("id is not null").select("id")
    count = int(min(MOST_RANGES, max(1, rows.count() // ROWS_A_RANGE)))
    least, cuts = ids.agg(F.min("id"), F.percentile_approx("id", [k / count for k in range(1, count)] or [0.5], max(10_000, 10 * count))).first()
    ranges = Ranges([0] if least is None else [least, *(cuts if count > 1 else [])])

    @F.pandas_udf("struct<range: long, other: boolean>")
    def placed(column, hashes):
        import pandas as pd

        return pd.DataFrame(dict(zip(("range", "other"), ranges.place(column.to_numpy(np.int64), hashes.to_numpy(np.int64)))))

    @F.pandas_udf("struct<range: long, other: boolean>")
    def dealt(column, hashes):
        import pandas as pd

        return pd.DataFrame(dict(zip(("range", "other"), ranges.deal(column.to_numpy(np.int64), hashes.to_numpy(np.int64)))))

    rows = rows.withColumn("hash", F.xxhash64("text"))
    if ranges.hot.any():
        around = rows.where("id is not null").select("id", "hash", placed("id", "hash").alias("p")).where("p.other")
        firsts = around.groupBy("p.range").agg(F.min(F.struct("id", "hash")).alias("x")).collect()
        ranges.settle({r.range: (r.x.id, r.x.hash) for r in firsts})
    n = max(1, len(ranges))
    rows = rows.withColumn("p", dealt(F.coalesce("id", F.lit(int(ranges.ids[0]))), "hash"))
    chained = F.array(F.struct(F.col("p.range").alias("range"), F.lit(0).alias("kind")))
    head = F.array(F.struct(F.pmod(F.col("p.range") - 1, F.lit(n)).alias("range"), F.lit(1).alias("kind")))
    apart = F.array(F.struct(F.pmod(F.col("hash"), F.lit(n)).alias("range"), F.lit(2).alias("kind")))
    kinds = F.when(F.col("id").isNull(), apart).when(F.col("p.other"), F.concat(chained, head)).otherwise(chained)
    rows = rows.select("id", "text", "hash", F.explode(kinds).alias("t")).select("t.range", "t.kind", "id", "text", "hash")
    rows = rows.repartition("range").sortWithinPartitions("range", "kind", "id", "hash", "text").drop("hash")
    # in a range the rows of kind 0 come first, then those of kind 1, the first of which follows the last of kind 0
    return rows.mapInArrow(_stream, SCHEMA)


def op3(docs: DataFrame) -> DataFrame:
    return fingerprinted(docs.select("doc_id", "text"))
