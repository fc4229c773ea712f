"""Shared plumbing: Arrow batches cut into bounded slices, byte views of text columns, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.sources.lake import discard, stored

#: Bytes and rows of text worked on at once; bound the memory of the vectorised steps whatever the batch holds.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096
DRAW, SAMPLE_FILES = "__draw", 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the len+1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of about ``most`` bytes of text and SLICE_ROWS rows each, one row at least."""
    _, at = text_view(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = min(n, row + SLICE_ROWS, max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make()`` gives, kept by this worker for its next tasks until one of another operator runs in it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    _KEPT["used"] = True
    return _KEPT[key]


def forget() -> None:
    """Frees what an operator before kept, unless it was asked for since."""
    if not _KEPT.pop("used", False):
        _KEPT.clear()


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """Appends columns computed from ``text`` in Arrow slices, keeping every row and other column.

    ``make`` runs once for each partition and returns a function from a slice of the rows to the new columns. A column
    of the input that has the name of a new one is replaced; ``text`` itself may be replaced too.
    """
    new = {f.name for f in fields}
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in new or c == text])
    names = [c for c in kept.columns if c not in new]
    schema = T.StructType([kept.schema[c] for c in names] + fields)

    def run(batches):
        work = make()
        forget()
        for batch in batches:
            for part in slices(batch, text):
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *work(part)], names=[*names, *(f.name for f in fields)])

    return kept.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, text: str, most: int, most_bytes: int) -> DataFrame:
    """At most ``most`` distinct rows and ``most_bytes`` of text, the same rows on each run, as a stored table.

    Rows are drawn by a 64-bit hash of key and text: the smallest ones, so that rows with one id, or none, are drawn
    apart. Equal keys with equal texts are one row. A threshold from the number of rows lets about a quarter more rows
    than needed pass, which are written once; it is raised while less than half of them do, as among many copies. So the
    sample is never empty unless the table is, or every text is larger than the whole bound; such texts are left out.
    ``df`` keeps its columns.
    """
    count, rows = df.count(), df.withColumn(DRAW, F.xxhash64(key, text, F.lit("sample")))
    share = (1.25 * most + 100) / max(1, count)
    while True:
        some = rows if share >= 1 else rows.where(F.col(DRAW) < int((share - 0.5) * 2**64))
        some = stored(some.dropDuplicates([DRAW]).coalesce(SAMPLE_FILES))
        found = 0 if some.isEmpty() else some.count()
        if share >= 1 or found >= most // 2:
            break
        share *= min(1000, 2 * most / max(1, found))
        discard(some)
    # numbers and sizes of a bounded number of rows: the last one that fits
    fits = F.coalesce(F.octet_length(text), F.lit(0)) <= most_bytes
    sizes = some.where(fits).select(DRAW, F.coalesce(F.octet_length(text), F.lit(0)).alias("size")).orderBy(DRAW).limit(most).collect()
    ends = np.cumsum([r.size for r in sizes])
    last = sizes[int(np.searchsorted(ends, most_bytes, "right")) - 1][DRAW] if sizes else None
    return some.where(fits & (F.col(DRAW) <= F.lit(last).cast("long"))).drop(DRAW)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, x in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial; equal spans have equal hashes anywhere."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values, none of them across a bound in ``at``."""
    bounds = np.zeros(len(inside) + 1, bool)
    bounds[at] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | bounds[:-1]))
    return starts, np.flatnonzero(inside & (~after | bounds[1:])) + 1


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive ranges, empty ones included."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[at[1:]] - total[at[:-1]]
