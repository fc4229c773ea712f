"""Comparing the members of groups in blocks of bounded size, however large a group is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1024


def dealt(rows: DataFrame, key: str, size: str, own: str) -> DataFrame:
    """Deals each group of ``rows`` to tiles: of two of its parts of about TILE rows each, or of one part against itself.

    ``size`` is the number of rows in the row's group and ``own`` an id whose hash gives the row's part. Adds ``i`` and
    ``j``, the parts, and ``side``: 0 in a tile of one part, else 1 and 2.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / TILE)).cast("int")
    mine = F.pmod(F.xxhash64(own), parts).cast("int")
    every = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"), F.when(k == mine, 0).when(mine < k, 1).otherwise(2).alias("side")))
    kept = [c for c in rows.columns if c not in (key, size)]
    return rows.select(key, *kept, F.explode(every).alias("__t")).select(key, "__t.i", "__t.j", "__t.side", *kept)


def dealt_between(rows: DataFrame, key: str, first: str, sizes: tuple[str, str], own: str) -> DataFrame:
    """Deals each group of ``rows`` to tiles of a part of the rows that are ``first`` and a part of the others.

    ``sizes`` are the numbers of rows of the two kinds in the row's group. Columns as in ``dealt``; sides are 1 and 2.
    """
    ours, theirs = (F.greatest(F.lit(1), F.ceil(F.col(c) / TILE)).cast("int") for c in sizes)
    mine = F.pmod(F.xxhash64(own), F.when(F.col(first), ours).otherwise(theirs)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col(first), theirs).otherwise(ours) - 1)
    every = F.transform(others, lambda k: F.struct(F.when(F.col(first), mine).otherwise(k).alias("i"), F.when(F.col(first), k).otherwise(mine).alias("j"), F.when(F.col(first), 1).otherwise(2).alias("side")))
    kept = [c for c in rows.columns if c not in (key, first, *sizes)]
    return rows.select(key, *kept, F.explode(every).alias("__t")).select(key, "__t.i", "__t.j", "__t.side", *kept)


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each tile together, sorted by tile."""
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after another, from batches sorted by their first three columns."""
    held: list[pa.RecordBatch] = []
    tile = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and tile != tuple(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            tile = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a spanning forest of a symmetric matrix of links: they join what the links join."""
    edges, new = [], np.ones(len(near), bool)
    for start in np.flatnonzero(near.any(1)).tolist():
        if not new[start]:
            continue
        new[start], front = False, np.array([start])
        while len(front):
            reached = np.flatnonzero(near[front].any(0) & new)
            edges += zip(front[near[np.ix_(front, reached)].argmax(0)].tolist(), reached.tolist())
            new[reached], front = False, reached
    return edges
