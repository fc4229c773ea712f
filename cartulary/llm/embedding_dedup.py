"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors at distance d differ in a projection by a normal
number of deviation d, so near pairs fall into each other's window, centred on the vector, in most projections, and other
pairs in few: pairs with at least ``LEAST_COLLISIONS`` collisions of ``WINDOWS`` are verified by their cosine in double
precision. The window and the count are set so that they miss a pair at the threshold with a probability of 1.4e-05.

To avoid touching all pairs, vectors are first dealt into cells of a few further projections each, in several tables (up to
``FULL_CELL`` distinct vectors in the largest label, into one cell a label); no projection is sorted, and the windows filter
all pairs of a tile;
cells have more projections, and there are more tables, the more vectors a label has, so that the work for a vector
stays about the same and a pair at the threshold shares a cell in some table with a probability of 1 - 10**-5. Cells are
compared in tiles of bounded size. A pair counts in the first cell that it shares. A tile gives each vector's number of
new links and a spanning forest of the links, never the pairs.

Equal vectors of a label are one class throughout, so copies are never paired. Vectors of one label but of different
lengths never link. Null labels, null or zero vectors and such with null or non-finite parts link with nothing, nor do
null ids; their component is their own id and they are kept. Repeated rows count once. A cosine that equals the threshold
links. Ids and labels of any type that can be ordered are taken; other columns are never read, and an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm import tiles
from cartulary.llm.graph import components
from cartulary.llm.rows import mix
from cartulary.sources.lake import discard, stored

WINDOWS, LEAST_COLLISIONS = 24, 10
CELL, MISS, FULL_CELL = 8.0, 1e-5, 2000  # the width of a cell in distances of linked vectors at most


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, count))


def layout(most: int, cosine: float) -> tuple[int, int]:
    """(projections of a cell, tables) for the vectors of the largest label."""
    apart = math.sqrt(2 - 2 * cosine)
    together = 1 - math.sqrt(2 / math.pi) / CELL  # two linked vectors in one projection's cell
    by_chance = min(0.9, CELL * apart / math.sqrt(4 * math.pi) + 0.02)
    depth = max(0, math.ceil(math.log(max(1.0, most / FULL_CELL)) / -math.log(by_chance)))
    return depth, math.ceil(math.log(MISS) / math.log(1 - together**depth)) if depth else 1


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def projected(classes: DataFrame, cosine: float, depth: int, tables: int) -> DataFrame:
    """(id, label, keys): a hash of the vector's cell in each table, with its length and the table."""
    width = CELL * math.sqrt(2 - 2 * cosine)

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                shift = np.random.default_rng(3).uniform(0, width, tables * depth)
                grid = np.floor((unit_vectors(rows.column(2), size) @ directions(size, tables * depth, 2) + shift) / width)
                grid = grid.astype(np.int64).astype(np.uint64).reshape(len(grid), tables, depth)
                keys = mix(np.full((len(grid), tables), size, np.uint64) << np.uint64(32) | np.arange(tables, dtype=np.uint64))
                for k in range(depth):
                    keys = mix(keys ^ (grid[:, :, k] + np.uint64(k)))
                offsets = pa.array(np.arange(len(grid) + 1) * tables, pa.int32())
                keys = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), keys], names=["id", "label", "keys"])

    rows = classes.select("id", "label", "embedding")
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("keys", T.ArrayType(T.LongType()))])
    found = rows.mapInArrow(run, schema)
    return found.select("id", F.transform("keys", lambda k: F.xxhash64("label", k)).alias("keys"))


def _tile(cosine: float):
    """Of a tile's rows: how many other vectors each is newly linked with, and the edges of a spanning forest.

    A pair is new in the first cell that it shares. Rows of several kinds (label, length or table), which meet only by
    an equality of hashes, are told apart.
    """
    reach = 1.25 * math.sqrt(2 - 2 * cosine)

    def links(size: int, table: int, side: np.ndarray, vectors: pa.Array, keys: np.ndarray, copies: np.ndarray):
        unit = unit_vectors(vectors, size)
        windows = (unit @ directions(size, WINDOWS, 1)).astype(np.float32)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        near, counts, other = np.zeros((len(side), len(side)), bool), np.zeros(len(side)), windows[right]
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            hits = np.zeros((len(some), len(right)), np.uint8)
            for k in range(WINDOWS):
                hits += np.abs(windows[some, k][:, None] - other[:, k]) <= reach
            enough = hits >= LEAST_COLLISIONS
            columns = np.flatnonzero(enough.any(0))
            i, j = np.nonzero(enough[:, columns] & (unit[some] @ unit[right[columns]].T >= cosine))
            i, j = some[i], right[columns[j]]
            new = (i != j) & ~(keys[i, :table] == keys[j, :table]).any(1)
            i, j = i[new], j[new]
            near[i, j] = near[j, i] = True
            counts += np.bincount(i, copies[j], len(side))
            if side[0]:  # a tile of two parts: the other direction isn't met
                counts += np.bincount(j, copies[i], len(side))
        return counts.astype(np.int64), tiles.forest(near)

    def run(batches):
        for rows in tiles.groups(batches):
            rows = rows.combine_chunks()
            column = {n: rows.column(n).combine_chunks() for n in rows.column_names}
            column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
            kinds = [column["label"].dictionary_encode().indices.to_numpy(), column["embedding"].value_lengths().to_numpy(), column["t"].to_numpy()]
            _, kind = np.unique(np.stack(kinds, 1), axis=0, return_inverse=True)
            for k in range(int(kind.max()) + 1):
                here = np.flatnonzero(kind.ravel() == k)
                part = {n: c.take(pa.array(here)) for n, c in column.items()}
                keys = part["keys"].flatten().to_numpy().reshape(len(here), -1)
                counts, edges = links(int(kinds[1][here[0]]), int(kinds[2][here[0]]), part["side"].to_numpy(), part["embedding"], keys, part["copies"].to_numpy())
                some = np.flatnonzero(counts)
                a, b = np.array(edges, np.int64).reshape(-1, 2).T
                ids = part["id"]
                first = pa.concat_arrays([ids.take(pa.array(some)), ids.take(pa.array(a))])
                second = pa.concat_arrays([pa.nulls(len(some), ids.type), ids.take(pa.array(b))])
                yield pa.RecordBatch.from_arrays([first, second, pa.array(np.concatenate((counts[some], np.zeros(len(a), np.int64))))], names=["a", "b", "n"])

    return run


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``rows``."""
    rows = rows.select(F.col(vec_id).alias("id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    classes = stored(rows.where("sound").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    posted = stored(projected(classes, cosine, *layout(most, cosine)))
    cells = posted.select("id", F.posexplode("keys").alias("t", "key"))
    cells = cells.join(cells.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")
    payload = posted.join(classes, "id")
    dealt = tiles.dealt(cells.join(payload, "id").select("key", "size", "id", "t", "copies", "keys", "label", "embedding"), "key", "size", "id")
    dealt = tiles.gathered(dealt, "key")
    kind = classes.schema["id"].dataType
    found = stored(dealt.mapInArrow(_tile(cosine), T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())])))

    beside = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("beside"))
    grouped = components(found.where("b is not null"), "a", "b")
    linked = classes.join(beside, "id", "left").join(grouped.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("sound"))
    discard(posted)
    rows = rows.join(linked.where("n > 0"), ["label", "embedding", "sound"], "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4(rows: DataFrame) -> DataFrame:
    return near_duplicates(rows.select("vec_id", "embedding", "label"))
