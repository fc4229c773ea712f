"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set has its distinct word shingles; its signature has the smallest of each of ``COORDINATES`` hashes.
Documents are posted under each coordinate-value pair. Similar sets match in most coordinates: pairs are kept above
``MATCHES`` matching ones, which a pair at the similarity of 0.8 misses with a probability of about one in a million. A
pair with so many matches has one among any ``PREFIX`` coordinates, so only these are posted (prefix); it is counted in
full under its first common coordinate and skipped under the others. Links are confirmed on the full sets.

Documents with equal sets are one class throughout. In each posting list every member is first tried against the list's
smallest id, which gives as many pairs as postings and joins groups of copies, however large; then only pairs of
different components are left to look at. Of lists longer than a tile the largest component is set against the rest, and
the rest is split by bands of set sizes. All are compared in tiles of bounded size, as arrays: a first round finds the documents with candidates, a second confirms them on their full sets within the tile, and only a
spanning forest of the links leaves it. Components of all links follow.

Null and empty texts, and null ids, link with nothing: their component is their own id and they are kept. Repeated ids
are one node. A similarity that equals the threshold links. Long texts are shingled whole; lists and tiles count their
shingles. Only the columns for id and text are read, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import tiles
from cartulary.llm.graph import components
from cartulary.llm.rows import forget, mix, runs, slices, span_hashes, text_view
from cartulary.sources.lake import discard, stored

COORDINATES, MATCHES = 32, 14
PREFIX = COORDINATES - MATCHES + 1
#: Ids that are broadcast at most, and shingles that count as one more row in the size of a list.
BROADCAST_IDS, SHINGLES_A_ROW, DOCS_A_TASK = 1 << 20, 512, 50_000
_RNG = np.random.default_rng(23)
_SCALE = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, end to end; offsets). A text of fewer than n words is one shingle."""
    data, at = text_view(column)
    starts, ends = runs(~_SPACE[data], at)
    word = span_hashes(_LOWER[data], starts, ends)
    of = np.searchsorted(at, starts, "right") - 1
    count = np.bincount(of, minlength=len(column))
    first = np.concatenate(([0], np.cumsum(count)))
    whole = np.flatnonzero((count > 0) & (count < n))
    head = np.flatnonzero(np.arange(len(word)) + n <= first[of + 1]) if len(word) else np.empty(0, np.int64)
    hashes = np.full(len(head), n, np.uint64)
    for k in range(n):
        hashes += word[head + k] * _PLACE[k]
    short = count[whole].astype(np.uint64)
    for k in range(n - 1):
        some = count[whole] > k
        short[some] += word[first[whole[some]] + k] * _PLACE[k]
    hashes, owner = mix(np.concatenate((hashes, short))), np.concatenate((of[head], whole))
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(column)))))


def _minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 64-bit minima, one for each coordinate, for each set that isn't empty."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint64)
    for c in range(COORDINATES):
        out[:, c] = np.minimum.reduceat(hashes * _SCALE[c] + _SHIFT[c], starts)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(id, n_shingles, two hashes of the set, signature, keys) of each row; only id and n_shingles for an empty set.

    The signature has the upper 32 bits of the minima, to count matches. The keys, of the first PREFIX coordinates, are
    whole: unlike sets then share one by chance about as rarely as 64-bit hashes are equal, at any size of the corpus.
    """

    def run(batches):
        forget()
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = shingle_sets(part.column(1), n)
                some = np.diff(at) > 0
                starts = at[:-1][some]
                sums = [np.zeros(len(some), np.uint64) for _ in range(2)]
                minima = np.empty((0, COORDINATES), np.uint64)
                if len(starts):
                    sums[0][some] = np.add.reduceat(mix(hashes), starts)
                    sums[1][some] = np.add.reduceat(mix(hashes ^ _SHIFT[0]), starts)
                    minima = _minima(hashes, at)
                signed = np.full(len(some), None, object)
                signed[some] = [row.tobytes() for row in (minima >> np.uint64(32)).astype(np.uint32)]
                sums = [pa.array(s.view(np.int64), mask=~some) for s in sums]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))) * PREFIX, pa.int32()), pa.array(np.ascontiguousarray(minima[:, :PREFIX]).view(np.int64).ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *sums, pa.array(signed, pa.binary()), keys], names=["id", "n_shingles", "set_a", "set_b", "signature", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, signature binary, keys array<long>")


def full_sets(docs: DataFrame, doc_id: str, text: str, n: int, ids: DataFrame) -> DataFrame:
    """(id, sorted distinct shingle hashes) of the documents with these ids.

    Up to BROADCAST_IDS ids are broadcast, so the documents aren't shuffled; beyond, both sides are dealt by id.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = shingle_sets(part.column(1), n)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["id", "shingles"])

    ids = ids.distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    The members tried against one ``a`` are dealt to parts of about TILE rows, each with a's own set, however many they are.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / tiles.TILE).alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("member"), F.col("b").alias("id"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("a", "part", F.lit(0).alias("member"), F.col("a").alias("id"))
    dealt = heads.union(members).join(sets, "id").select("a", "part", "member", "id", "shingles").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches):
        a = part = None
        heads: list[np.ndarray] = []
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(4)]
            at, every = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            found = []
            for k, key in enumerate(zip(*(x.tolist() for x in keys))):
                own = every[at[k] : at[k + 1]]
                if key[:2] != (a, part):
                    (a, part), heads = key[:2], []
                if not key[2]:
                    heads.append(own)
                for head in heads if key[2] else ():
                    place = np.minimum(np.searchsorted(head, own), len(head) - 1)
                    common = int((head[place] == own).sum())
                    if 100 * common >= percent * (len(head) + len(own) - common):
                        found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def postings(classes: DataFrame, *columns: str) -> DataFrame:
    """(key, c, columns) of each class under each of its first PREFIX coordinates ``c`` and its value there."""
    each = classes.select(*columns, F.posexplode("keys").alias("c", "v"))
    return each.select(F.xxhash64("c", "v").alias("key"), "c", *columns)


def _size():
    """Rows of a list, or more if their sets are long."""
    return F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / SHINGLES_A_ROW))


def listed(rows: DataFrame) -> DataFrame:
    """The rows of the lists (``key``) with several components, with the list's ``size``."""
    lists = rows.groupBy("key").agg(_size().alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return rows.join(lists.select("key", "size"), "key")


def divided(posted: DataFrame, percent: int, tasks: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of all lists, dealt to tiles; the stored tables that they are made from).

    In a list longer than a tile, the largest component is set against the other rows only, in as many tiles as these
    need. If the others are many, they are compared by bands of set sizes: sets of a band (``above`` is false) among
    themselves and with those of the band below (``above`` is true), as sets farther apart can't be similar.
    """
    columns = ["key", "c", "id", "n", "component"]
    rows = stored(listed(posted.select(*columns)).coalesce(tasks))
    long = rows.where(F.col("size") > tiles.TILE).drop("size")
    owners = long.groupBy("key", "component").agg(_size().alias("own"))
    owners = owners.groupBy("key").agg(F.max_by("component", F.struct("own", "component")).alias("largest"), F.max("own").alias("ours"), (F.sum("own") - F.max("own")).alias("theirs"))
    long = stored(long.join(owners, "key").withColumn("first", F.col("component") == F.col("largest")).drop("largest").coalesce(tasks))
    between = tiles.dealt_between(long, "key", "first", ("ours", "theirs"), "id").withColumn("above", F.lit(False))

    rest = listed(long.where("not first").select(F.xxhash64("key", F.lit("rest")).alias("key"), *columns[1:]))
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("long")
    bands = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("above")), F.struct((band + 1).alias("band"), F.lit(True).alias("above"))))
    banded = rest.where(F.col("size") > tiles.TILE).select("*", bands.alias("b"))
    banded = listed(banded.select(F.xxhash64("key", "b.band").alias("key"), *columns[1:], "b.above"))
    few = [x.where(F.col("size") <= tiles.TILE).withColumn("above", F.lit(False)) for x in (rows, rest)]
    every = few[0].unionByName(few[1]).unionByName(banded)
    return tiles.dealt(every, "key", "size", "id").unionByName(between), [rows, long]


def _candidates(percent: int):
    """The rows of a tile that may link: alike, in size and coordinates, to one of another component.

    A pair is counted under its first common coordinate only.
    """

    def find(table: pa.Table) -> np.ndarray:
        side, comps, sizes, above = (table.column(c).to_numpy() for c in ("side", "component", "n", "above"))
        left, right, some = np.flatnonzero(side != 2), np.flatnonzero(side != 1), np.zeros(len(side), bool)
        if len(np.unique(comps)) > 1:
            signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            before = int(table.column("c")[0].as_py())
            for at in range(0, len(left), 128):
                part = left[at : at + 128][:, None]
                i, j = np.nonzero((comps[part] != comps[right]) & ~(above[part] & above[right]) & (100 * np.minimum(sizes[part], sizes[right]) >= percent * np.maximum(sizes[part], sizes[right])))
                i, j = left[at + i], right[j]
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    same = signed[p] == signed[q]
                    good = (same.sum(1) >= MATCHES) & ~same[:, :before].any(1)
                    some[p[good]] = some[q[good]] = True
        return some

    def run(batches):
        for table in tiles.groups(batches):
            yield from table.filter(pa.array(find(table))).to_batches()

    return run


def _linked(percent: int):
    """Links of a tile's rows, confirmed on their full sets: the edges of a spanning forest, which joins what links join."""

    def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        rows, several = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), count[inverse] > 1
        rows, columns = rows[several], place[inverse[several]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        total = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
            a, b = np.searchsorted(columns, [at, at + 2048])
            part = np.zeros((len(sets), 2048), np.float32)
            part[rows[a:b], columns[a:b] - at] = 1
            total += part[left] @ part[right].T
        return total

    def run(batches):
        for table in tiles.groups(batches):
            side, ids, comps = (table.column(c).to_numpy() for c in ("side", "id", "component"))
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            shingles = table.column("shingles").combine_chunks()
            shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
            size = shingles.value_lengths().to_numpy()
            sets = np.split(shingles.flatten().to_numpy(), np.cumsum(size)[:-1])
            both = common(sets, left, right)
            good = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (comps[left][:, None] != comps[right])
            near = np.zeros((len(sets), len(sets)), bool)
            near[np.ix_(left, right)] = good
            edges = tiles.forest(near | near.T)
            a, b = (np.array([ids[e[k]] for e in edges], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def links(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes of equal sets with their smallest id, components (node, component) of linked classes)."""
    signed = stored(signatures(docs, doc_id, text, n))
    tasks = 1 + signed.count() // DOCS_A_TASK  # small tables go to few files, those of more work for a row to more
    some = signed.where("id is not null and n_shingles > 0")
    classes = some.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = stored(classes.coalesce(tasks))

    posted = postings(classes, "id")
    lists = posted.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    one, two = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab")
    tried = posted.join(lists, "key").where("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct().join(two, "b")
    tried = tried.join(one, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    matches = sum((F.substring("s_a", 4 * c + 1, 4) == F.substring("s_b", 4 * c + 1, 4)).cast("int") for c in range(COORDINATES))
    tried = stored(tried.where(matches >= MATCHES).select("a", "b").coalesce(tasks))
    found = stored(confirmed(tried, full_sets(docs, doc_id, text, n, tried.select(F.col("a").alias("id")).union(tried.select("b"))), percent).coalesce(8 * tasks))
    grouped = components(found, "a", "b")

    owned = classes.join(grouped.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows, used = divided(postings(owned, "id", "n", "component"), percent, tasks)
    rows = rows.join(classes.select("id", "signature"), "id")
    dealt = tiles.gathered(rows.select("key", "i", "j", "side", "id", "component", "n", "above", "signature", "c"), "key")
    dealt = stored(dealt.mapInArrow(_candidates(percent), dealt.schema).coalesce(8 * tasks))
    some = dealt.select("key", "i", "j", "side", "id", "component").join(full_sets(docs, doc_id, text, n, dealt.select("id")), "id")
    some = tiles.gathered(some.select("key", "i", "j", "side", "id", "component", "shingles"), "key")
    every = stored(found.union(some.mapInArrow(_linked(percent), "a long, b long")).distinct().coalesce(tasks))
    linked = components(every, "a", "b")
    discard(tried, found, grouped, *used, dealt, every)
    return signed, classes, linked


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: shingles of ``words`` words, similarity of ``percent`` or more."""
    signed, classes, linked = links(docs, doc_id, text, words, percent)
    classes = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes = classes.where("copies > 1 or component <> id").select("set_a", "set_b", "component")
    rows = signed.drop("signature", "keys").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=4)
