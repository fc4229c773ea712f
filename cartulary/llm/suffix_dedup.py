"""Suffix-array dedup: bytes inside strings of ``least`` bytes that also start in an earlier document are removed.

Longest-previous-factor arrays decide: suffixes are sorted, the previous and next smaller positions in suffix order (in
the order of the documents) give each suffix's earlier candidates, and a match of ``least`` bytes or more with one of
them makes the suffix's first ``least`` bytes a later copy. The first copy stays.

One suffix array over a corpus would be one task's work, so the suffixes are dealt out first. Every string of ``least``
bytes has a smallest hash among the strings of ``SEED`` bytes in it, and equal strings have the same one; neighbouring
strings mostly share it, so a text falls into stretches of strings with one smallest hash (``stretches``). Three passes
over units of documents, each a bounded number of bytes, follow:

1. each unit sends the distinct hashes of its stretches, and about how many contents each has, to buckets; a bucket
   answers, in their order, which of them other units have as well, and which have more than ``HOT`` contents in all;
2. each unit sends its stretches with a shared hash, the earliest copy of each content only, to the hash's bucket.
   Stretches of a hot hash are first cut finer, by their two smallest hashes, so they spread over the buckets. In a bucket
   equal stretches, compared byte by byte, are one class, which its first document stands for; the suffix array and the
   longest previous factors of those that differ decide. Intervals of later copies go back;
3. each unit joins the intervals and cuts them out.

Units, buckets and messages are bounded and grow in number with the corpus; a passage in a third of the documents is in a
bucket once for each unit, and a hash in many passages is cut finer (a text of more than about 32 bytes, in very many
different surroundings, still brings them to one bucket). A suffix array has a bounded number of suffixes:
those of a larger group are dealt by a hash of their first ``least`` bytes, which keeps equal ones together.

A document earlier in the order is one with a smaller id, judged on the input: overlaps count; equal ids are no order, so
rows with one id don't affect each other, and repeated rows stay as they are. Null texts are empty. Rows with null ids
neither lose bytes nor make others lose them. Texts are taken as UTF-8 bytes, whole and however long: a unit holds at
least one text. Only the columns for id and text are read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.rows import mix, span_hashes, text_view

LEAST, SEED = 50, 16
NONE = np.uint64((1 << 64) - 1)
#: Strings in a stretch at most: the stretches of a text that repeats itself are mostly equal then.
LONGEST = 64
SPLIT = 1 << 20
#: Contents of a hash from which its stretches are cut finer, and suffixes that are sorted at once.
HOT, SORTED = 1 << 16, 1 << 17
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- suffix arrays and longest previous factors ---------------------------------------------------------------------


def suffix_order(data: np.ndarray, positions: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at the positions by their first ``depth`` bytes, equal ones by place; those bytes)."""
    windows = np.lib.stride_tricks.sliding_window_view(data, depth)[positions]
    keys = np.ascontiguousarray(windows).view(f"S{depth}").ravel()
    return np.argsort(keys, kind="stable"), windows


def smaller_before(rank: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller rank, or -1; by following pointers all at once."""
    found = np.arange(len(rank)) - 1
    open_ = np.flatnonzero((found >= 0) & (rank[found] >= rank))
    while len(open_):
        found[open_] = found[found[open_]]
        ahead = found[open_]
        open_ = open_[(ahead >= 0) & (rank[ahead] >= rank[open_])]
    return found


def previous_factors(data: np.ndarray, positions: np.ndarray, document: np.ndarray, depth: int) -> np.ndarray:
    """Longest previous factors, up to ``depth`` bytes, of the suffixes at the positions.

    A factor is previous if it starts in a document with a smaller number. The best candidates are the nearest suffixes
    of smaller documents on either side in suffix order.
    """
    order, windows = suffix_order(data, positions, depth)
    rank = document[order]
    sides = smaller_before(rank), len(rank) - 1 - smaller_before(rank[::-1])[::-1]
    sorted_windows, best = windows[order], np.zeros(len(order), np.int64)
    for side in sides:
        some = np.flatnonzero((side >= 0) & (side < len(rank)))
        differ = sorted_windows[some] != sorted_windows[side[some]]
        best[some] = np.maximum(best[some], np.where(differ.any(1), differ.argmax(1), depth))
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


# --- stretches ------------------------------------------------------------------------------------------------------


def stretches(data: np.ndarray, at: np.ndarray, hot: np.ndarray = np.empty(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of the stretches of the texts: the strings of LEAST bytes in data[start:end] share it.

    Those with a hash in ``hot``, which is sorted, share the two smallest hashes instead, and have a hash of both.
    """
    found = []
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SPLIT, "right")) - 1)
        found.append(_stretches(data[at[row] : at[end]], at[row : end + 1] - at[row], row, at[row], hot))
        row = end
    return tuple(map(np.concatenate, zip(*found))) if found else tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))


def windowed(values: np.ndarray, width: int, merge) -> np.ndarray:
    """``merge`` of each ``width`` neighbouring values (in the last axis), for a merge that may see a value twice."""
    size, n = 1, values.shape[-1] - width + 1
    while 2 * size <= width:
        values = merge(values[..., :-size], values[..., size:])
        size *= 2
    return merge(values[..., :n], values[..., width - size : width - size + n])


def _two_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two smallest different values of two pairs of such; the largest integer stands for none."""
    least, other = np.minimum(a[0], b[0]), np.maximum(a[0], b[0])
    other[other == least] = NONE
    return np.stack((least, np.minimum(other, np.minimum(a[1], b[1]))))


def _stretches(data, at, row, offset, hot):
    n = len(data) - LEAST + 1
    if n < 1:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    seeds = mix((words[: len(data) - SEED + 1] * _FIRST) ^ ((words[SEED - 8 :] + _SECOND) * _SECOND))
    width = LEAST - SEED + 1
    # minima are small: mixed once more, they spread over the buckets
    least = mix(windowed(seeds, width, np.minimum))
    if len(hot):
        some = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        if some.any():
            first, second = windowed(np.stack((seeds, np.full(len(seeds), NONE))), width, _two_least)
            least[some] = mix(mix(first[some]) ^ (second[some] * _FIRST + _SECOND))
    room = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n) >= LEAST  # the string ends in its text
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (room[1:] != room[:-1])
    first = at[:-1]
    cut[first[first < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n) + LEAST - 1
    kept = room[starts]
    starts, ends = starts[kept], ends[kept]
    pieces = -(-(ends - starts - LEAST + 1) // LONGEST)
    step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
    starts = np.repeat(starts, pieces) + step
    ends = np.minimum(np.repeat(ends, pieces), starts + LONGEST + LEAST - 1)
    return least[starts], np.searchsorted(at, starts, "right") - 1 + row, starts + offset, ends + offset


def classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each stretch, equal for equal stretches only; which have an equal stretch with a smaller id)."""
    content = span_hashes(data, start, start + size)
    if not len(content):
        return content, np.zeros(0, bool)
    order = np.lexsort((ids, content))
    _, head, group = np.unique(content[order], return_index=True, return_inverse=True)
    first = np.empty(len(order), np.int64)
    first[order] = order[head][group]
    # equal hashes are compared, 8 bytes at once; a stretch that differs from the first of its hash is a class of its own
    words = np.lib.stride_tricks.sliding_window_view(data, 8).view(np.uint64)[:, 0]
    cuts = np.searchsorted(np.cumsum(size), np.arange(1, size.sum() // SPLIT + 1) * SPLIT)
    for part in np.split(np.arange(len(start)), cuts):
        part = part[first[part] != part]
        like = size[part] == size[first[part]]
        part, unlike = part[like], part[~like]
        n = -(-size[part] // 8)
        step = 8 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        step = np.minimum(step, np.repeat(size[part] - 8, n))
        differ = words[np.repeat(start[part], n) + step] != words[np.repeat(start[first[part]], n) + step]
        if differ.any() or len(unlike):
            other = np.union1d(unlike, part[np.unique(np.repeat(np.arange(len(part)), n)[differ])])
            content[other], first[other] = mix(content[other] + other.astype(np.uint64) + np.uint64(1)), other
    return content, ids > ids[first]


class Unit:
    """The documents of a unit, by id and text, and their stretches."""

    def __init__(self, table: pa.Table):
        table = table.select(["id", "text"]).combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        self.table = table
        column = table.column("text")
        self.data, self.at = text_view(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        ids = table.column("id")
        self.known = ~ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()

    def stretches(self, hot: np.ndarray = np.empty(0, np.uint64)):
        hashes, text, start, end = stretches(self.data, self.at, hot)
        known = self.known[text]
        return hashes[known], text[known], start[known], end[known]

    def shared_inside(self, hashes, text) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes, sorted; which of them two ids of the unit have)."""
        order = np.argsort(hashes)
        h, d = hashes[order], self.ids[text[order]]
        distinct, first = np.unique(h, return_index=True)
        low, high = (f.reduceat(d, first) if len(first) else d for f in (np.minimum, np.maximum))
        return distinct, low < high


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _message(bucket: list, unit: int, kind: int, blobs: list) -> pa.Table:
    n = len(bucket)
    return pa.table([pa.array(bucket, pa.int64()), pa.array([unit] * n, pa.int64()), pa.array([kind] * n, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "unit", "kind", "blob"])


SCHEMA = "bucket long, unit long, kind long, blob binary"


def ask(n_buckets: int):
    """Pass 1 of a unit: its distinct hashes, 5 bytes each, and the logarithm of their contents' number, to each bucket."""

    def run(key, table):
        unit = Unit(table)
        hashes, _, start, end = unit.stretches()
        content = span_hashes(unit.data, start, end)
        order = np.lexsort((content, hashes))
        hashes, content = hashes[order], content[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (content[1:] != content[:-1])
        distinct, contents = np.unique(hashes[new], return_counts=True)
        contents = np.minimum(255, np.floor(16 * np.log2(contents))).astype(np.uint8)
        cuts = np.searchsorted(_bucket(distinct, n_buckets), np.arange(n_buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        short = distinct.view(np.uint8).reshape(-1, 8)[:, :5]
        blobs = [np.uint64(cuts[b + 1] - cuts[b]).tobytes() + short[cuts[b] : cuts[b + 1]].tobytes() + pa.compress(contents[cuts[b] : cuts[b + 1]].tobytes(), "zstd", asbytes=True) for b in some]
        return _message(some.tolist(), key[0].as_py(), 0, blobs)

    return run


def answer(most: int):
    """A bucket's answer to pass 1, in the order sent: whether another unit has the hash, and whether it is hot."""

    def run(key, table):
        units, blobs = table.column("unit").to_pylist(), table.column("blob").to_pylist()
        sizes = [int(np.frombuffer(b, "<u8", 1)[0]) for b in blobs]
        short = np.zeros((sum(sizes), 8), np.uint8)
        short[:, :5] = np.frombuffer(b"".join(b[8 : 8 + 5 * n] for b, n in zip(blobs, sizes)), np.uint8).reshape(-1, 5)
        contents = np.frombuffer(b"".join(pa.decompress(b[8 + 5 * n :], n, "zstd", asbytes=True) for b, n in zip(blobs, sizes)), np.uint8)
        _, inverse, count = np.unique(short.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        shared, hot = count[inverse] > 1, (np.bincount(inverse, 2.0 ** (contents / 16)) > most)[inverse]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        parts = [_message([key[0].as_py()], u, 0, [np.packbits(shared[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes()]) for u, a, b in zip(units, cuts, cuts[1:])]
        return pa.concat_tables(parts)

    return run


_RECORD = np.dtype([("hash", "<u8"), ("id", "<i8"), ("size", "<u4"), ("copies", "<u4")])
_PLACE = np.dtype([("text", "<u4"), ("start", "<u4")])
_SPAN = np.dtype([("text", "<u4"), ("start", "<u4"), ("size", "<u4")])


def send(n_buckets: int):
    """Pass 2 of a unit: stretches with shared hashes to their buckets; spans settled inside the unit as kind 1.

    A content is sent once, for the smallest id that has it, with all its places in that document.
    """

    def run(key, table, answers):
        number = key[0].as_py()
        unit = Unit(table)
        hashes, text, start, end = unit.stretches()
        distinct, inside = unit.shared_inside(hashes, text)
        buckets, hot = _bucket(distinct, n_buckets), np.zeros(len(distinct), bool)
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
            a, z = np.searchsorted(buckets, [b, b + 1])
            flags = np.frombuffer(blob, np.uint8).reshape(2, -1)
            inside[a:z] |= np.unpackbits(flags[0], count=z - a).astype(bool)
            hot[a:z] = np.unpackbits(flags[1], count=z - a).astype(bool)
        if hot.any():
            hashes, text, start, end = unit.stretches(distinct[hot])
        # finer hashes weren't asked for: all of them are sent
        known = np.minimum(np.searchsorted(distinct, hashes), max(0, len(distinct) - 1))
        shared = (inside[known] | (distinct[known] != hashes)) if len(distinct) else np.zeros(0, bool)
        hashes, text, start, end = hashes[shared], text[shared], start[shared], end[shared]
        content, later = classes(unit.data, start, end - start, unit.ids[text])
        spans = np.empty(int(later.sum()), _SPAN)
        spans["text"], spans["start"], spans["size"] = text[later], (start - unit.at[text])[later], (end - start)[later]
        own = _message([number % n_buckets], number, 1, [spans.tobytes()]) if len(spans) else _message([], number, 1, [])

        hashes, text, start, end, content = hashes[~later], text[~later], start[~later], end[~later], content[~later]
        order = np.lexsort((content, hashes))
        hashes, text, start, end, content = hashes[order], text[order], start[order], end[order], content[order]
        places = np.empty(len(order), _PLACE)
        places["text"], places["start"] = text, start - unit.at[text]
        new = np.ones(len(order), bool)
        new[1:] = (content[1:] != content[:-1]) | (hashes[1:] != hashes[:-1])
        head = np.append(np.flatnonzero(new), len(order))
        one = head[:-1]
        records = np.empty(len(one), _RECORD)
        records["hash"], records["id"], records["size"], records["copies"] = hashes[one], unit.ids[text[one]], (end - start)[one], np.diff(head)
        cuts = np.searchsorted(_bucket(records["hash"], n_buckets), np.arange(n_buckets + 1))
        some, blobs = np.flatnonzero(np.diff(cuts)), []
        for b in some:
            part = records[cuts[b] : cuts[b + 1]]
            body = [unit.data[a:z] for a, z in zip(start[one[cuts[b] : cuts[b + 1]]].tolist(), end[one[cuts[b] : cuts[b + 1]]].tolist())]
            body = pa.compress(np.concatenate(body).tobytes(), "zstd", asbytes=True)
            blobs.append(np.uint64(len(part)).tobytes() + part.tobytes() + places[head[cuts[b]] : head[cuts[b + 1]]].tobytes() + body)
        return pa.concat_tables([own, _message(some.tolist(), number, 0, blobs)])

    return run


def _received(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, places, bytes) of a message of pass 2."""
    records = np.frombuffer(blob, _RECORD, int(np.frombuffer(blob, "<u8", 1)[0]), 8)
    at = 8 + records.nbytes
    places = np.frombuffer(blob, _PLACE, int(records["copies"].sum()), at)
    body = pa.decompress(blob[at + places.nbytes :], int(records["size"].sum(dtype=np.int64)), "zstd", asbytes=True)
    return records, places, np.frombuffer(body, np.uint8)


def later_windows(data: np.ndarray, start: np.ndarray, windows: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, from where in it, number of windows) of each run of strings with a previous factor of LEAST bytes.

    Of more than ``most`` strings, those whose hashes leave the same rest are sorted at once.
    """
    owner = np.repeat(np.arange(len(start)), windows)
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    positions, parts = start[owner] + step, -(-len(owner) // most)
    if parts > 1:
        part = (span_hashes(data, positions, positions + LEAST) % np.uint64(parts)).astype(np.int64)
    copy = np.zeros(len(owner), bool)
    for k in range(parts):
        some = np.flatnonzero(part == k) if parts > 1 else np.arange(len(owner))
        copy[some] = previous_factors(data, positions[some], ids[owner[some]], LEAST) >= LEAST
    head, tail = copy.copy(), copy.copy()
    head[1:] &= ~(copy[:-1] & (owner[1:] == owner[:-1]))
    tail[:-1] &= ~(copy[1:] & (owner[1:] == owner[:-1]))
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    return owner[a], step[a], step[b] - step[a] + 1


def settle(most: int):
    """A bucket's answer to pass 2: spans that are later copies, for each unit; ``most`` suffixes are sorted at once."""

    def run(key, table):
        kinds, units = table.column("kind").to_numpy(), table.column("unit").to_numpy()
        out = [table.filter(pa.array(kinds == 1))]
        parts = [_received(b) for b, k in zip(table.column("blob").to_pylist(), kinds) if k == 0]
        if not parts:
            return out[0]
        records, places, data = (np.concatenate([p[k] for p in parts]) for k in range(3))
        unit = np.repeat(units[kinds == 0], [len(p[0]) for p in parts])
        del parts
        size = records["size"].astype(np.int64)
        start = np.cumsum(size) - size
        content, later = classes(data, start, size, records["id"])

        # the stretches that are left: those whose hash has several contents go into a suffix array
        left = np.flatnonzero(~later)
        _, hash_of = np.unique(records["hash"][left], return_inverse=True)
        pair = np.unique(np.stack([hash_of, content[left].view(np.int64)], 1), axis=0)[:, 0] if len(left) else left
        several = np.bincount(pair)[hash_of] > 1 if len(left) else np.zeros(0, bool)
        left, hash_of = left[several], hash_of[several]
        order = np.lexsort((records["id"][left], hash_of))
        left, hash_of = left[order], hash_of[order]
        windows = size[left] - LEAST + 1
        spans = [(np.flatnonzero(later), np.zeros(int(later.sum()), np.int64), size[later])]  # (record, from where in it, size)
        total, begin = np.cumsum(windows), 0
        while begin < len(left):  # whole hashes, of about most suffixes at once or one hash
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right"))
            end = int(np.searchsorted(hash_of, hash_of[min(end, len(left) - 1)], "left"))
            end = end if end > begin else int(np.searchsorted(hash_of, hash_of[begin], "right"))
            if total[-1] - (total[begin - 1] if begin else 0) <= most:
                end = len(left)
            some = left[begin:end]
            which, step, count = later_windows(data, start[some], windows[begin:end], records["id"][some], most)
            spans.append((some[which], step, count + LEAST - 1))
            begin = end
        record, offset, length = (np.concatenate([s[k] for s in spans]) for k in range(3))
        copies = records["copies"].astype(np.int64)
        first, many = (np.cumsum(copies) - copies)[record], copies[record]
        which = np.repeat(np.arange(len(record)), many)
        place = places[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[which]]
        unit = unit[record[which]]
        order = np.argsort(unit, kind="stable")
        found = np.empty(len(order), _SPAN)
        found["text"], found["start"], found["size"] = place["text"][order], place["start"][order] + offset[which[order]], length[which[order]]
        unit = unit[order]
        for u in np.unique(unit).tolist():
            a, b = np.searchsorted(unit, [u, u + 1])
            out.append(_message([key[0].as_py()], u, 1, [found[a:b].tobytes()]))
        return pa.concat_tables(out)

    return run


def removed(unit: Unit, blobs: list[bytes]) -> np.ndarray:
    """Which bytes of the unit's data lie in a span."""
    change = np.zeros(len(unit.data) + 1, np.int64)
    for blob in blobs:
        spans = np.frombuffer(blob, _SPAN)
        start = unit.at[spans["text"]] + spans["start"]
        np.add.at(change, start, 1)
        np.add.at(change, start + spans["size"], -1)
    return np.cumsum(change[:-1]) > 0


def cut(key, table, spans):
    """Pass 3 of a unit: the digest of each document's remaining bytes."""
    unit = Unit(table)
    gone = removed(unit, spans.column("blob").to_pylist())
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    begins = unit.at[:-1][unit.at[:-1] < len(gone)]
    first[begins] = gone[begins]
    counts = [np.concatenate(([0], np.cumsum(x)))[unit.at] for x in (gone, first)]
    kept, data = unit.data[~gone].tobytes(), unit.at - counts[0]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(data.tolist(), data[1:].tolist())]
    return pa.table([unit.table.column("id"), pa.array(np.diff(unit.at)), pa.array(np.diff(counts[0])), pa.array(np.diff(counts[1])), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keep(key, table, spans):
    """Pass 3 of a unit: the remaining text of each document; a cut inside a character drops its other bytes."""
    unit = Unit(table)
    gone = removed(unit, spans.column("blob").to_pylist())
    texts = [unit.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(unit.at.tolist(), unit.at[1:].tolist())]
    return pa.table([unit.table.column("id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", finish=cut, schema: str = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot: int = HOT, at_once: int = SORTED) -> DataFrame:
    """A row for each row of ``docs``: with ``finish=cut`` what was removed, with ``finish=keep`` (and its schema) the rest."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # units and buckets grow with the root of the corpus, so that the messages between them keep their size
    unit_bytes = max(1 << 20, int(60 * math.sqrt(total)))
    units = max(1, math.ceil(total / unit_bytes))
    n_buckets = max(1, units // 2)
    unit = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(units))
    units = rows.withColumn("unit", unit).repartition("unit")  # one shuffle of the texts, which the three passes share
    asked = units.groupBy("unit").applyInArrow(ask(n_buckets), SCHEMA)
    answers = asked.groupBy("bucket").applyInArrow(answer(hot), SCHEMA)
    sent = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(send(n_buckets), SCHEMA)
    spans = sent.groupBy("bucket").applyInArrow(settle(at_once), SCHEMA)
    return units.groupBy("unit").cogroup(spans.groupBy("unit")).applyInArrow(finish, schema)


def op2(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"))
