"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Distinct marked words (the space before a word is part of it) are sorted, which lays them out as a depth-first walk of
their trie; the forward states of the characters that a word shares with the one before it are reused. For a unigram
model the forward state of a prefix is its best score and last piece. For a BPE model, whose merges no sum of scores
expresses, it is the last piece of the prefix's encoding: a piece may follow another only if merging the two characters
by characters gives just these two pieces, and exactly one last piece of each prefix passes, so the walk gives the same
ids as the merges do. Pieces never hold a space after another character, so words can be encoded one by one.

The vocabulary is read from a model file on the driver and shipped as a table of bounded size. Its path is a parameter;
where none is given, it is the session's ``spark.cartulary.pieceModel``, else that of the public vocabularies here.

Characters outside the vocabulary fall back to bytes. Null and empty texts have no tokens. Decoding gives the text back,
except that U+2581, the mark of a space, comes back as a space. Texts of any length are encoded whole. Of equal scores
the leftmost merge, or the shorter last piece, wins. Repeated rows get equal tokens; an empty table gives no rows. Other
columns are kept; those named as a new one are replaced.
"""

from __future__ import annotations

import array
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cartulary.llm.rows import append_columns, kept

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words met lately that a worker keeps with their ids, besides as many met before; words longer than LONG aren't kept.
CACHED, LONG = 250_000, 64
NEVER = float("inf")
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    """Pieces, scores and kinds of a model: what encoding and decoding need, without the library."""

    pieces: list[str]
    scores: list[float]
    byte_of: dict[int, int]
    is_bpe: bool
    ordinary: set[int]
    unknown: int = 0
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {self.pieces[i]: i for i in sorted(self.ordinary)}
        self.ranks = {piece: -self.scores[i] for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        ends: dict[str, set[int]] = {}  # sizes of the pieces of three characters or more by their last three
        for piece in self.ids:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.ends = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in ends.items()}
        self.key = hash((self.is_bpe, *self.pieces, *self.scores))
        self.least = min((self.scores[i] for i in self.ordinary), default=0.0)


def model_path(spark: SparkSession, path: str | None = None) -> str:
    """The model to read: the one given, the session's, or the default; an error if the file isn't there."""
    path = path or spark.conf.get("spark.cartulary.pieceModel", MODEL)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no piece model at {path}: set spark.cartulary.pieceModel")
    return path


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        data = f.read()
    model, spec = sentencepiece.SentencePieceProcessor(model_proto=data), proto.ModelProto.FromString(data)
    every = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in every]
    byte_of = {i: int(pieces[i][1:-1], 16) for i in every if model.is_byte(i)}
    ordinary = {i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return Vocabulary(pieces, [model.get_score(i) for i in every], byte_of, spec.trainer_spec.model_type == 2, ordinary, model.unk_id())


def merged(vocabulary: Vocabulary, text: str) -> list[str]:
    """Merges of adjacent symbols, best score first and leftmost among equals: for short strings."""
    rank, symbols = vocabulary.ranks.get, list(text)
    ranks = [rank(a + b, NEVER) for a, b in zip(text, text[1:])]
    while ranks and (best := min(ranks)) < NEVER:
        k = ranks.index(best)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        del ranks[k]
        if k:
            ranks[k - 1] = rank(symbols[k - 1] + symbols[k], NEVER)
        if k < len(ranks):
            ranks[k] = rank(symbols[k] + symbols[k + 1], NEVER)
    return symbols


class PrefixViterbi:
    """Segments sorted words, reusing the forward states of shared prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pairs, self.alone, self.sizes = vocabulary, {}, {}, list(map(len, vocabulary.pieces))

    def _stands(self, piece: int) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        if (known := self.alone.get(piece)) is None:
            known = self.alone[piece] = merged(self.v, self.v.pieces[piece]) == [self.v.pieces[piece]]
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives just these; a character outside the vocabulary is -1."""
        if len(self.pairs) > 2 * CACHED:
            self.pairs.clear()
        both = [self.v.pieces[k] for k in (left, right)]
        known = self.pairs[left * len(self.sizes) + right] = self._stands(right) and (left < 0 or merged(self.v, "".join(both)) == both)
        return known

    def _last_piece(self, word: str, i: int, last: list[int]) -> int:
        """Last piece of the encoding of word[:i], of two characters or fewer: the longest that passes."""
        if i > 1 and (piece := self.v.ids.get(word[i - 2 : i])) is not None:
            if i == 2:
                passes = self._stands(piece)
            elif (passes := self.pairs.get(last[i - 2] * len(self.sizes) + piece)) is None:
                passes = self._follows(last[i - 2], piece)
            if passes:
                return piece
        return self.v.ids.get(word[i - 1], -1)

    def _segment_bpe(self, words: list[str]) -> Iterator[list[int]]:
        """For each prefix the last piece of its encoding; the encoding of a word follows from the last to the first."""
        piece_of, ends, pair, count, sizes = self.v.ids.get, self.v.ends.get, self.pairs.get, len(self.sizes), self.sizes
        last, before = [-1], ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for size in ends(word[i - 3 : i], ()) if i > 2 else ():
                    if size <= i and (piece := piece_of(word[i - size : i])) is not None:
                        if size == i:
                            passes = self._stands(piece)
                        elif (passes := pair(last[i - size] * count + piece)) is None:
                            passes = self._follows(last[i - size], piece)
                        if passes:
                            last.append(piece)
                            break
                else:
                    last.append(self._last_piece(word, i, last))
            ids, i = [], len(word)
            while i:
                if (piece := last[i]) < 0:
                    ids += reversed(self._ids(word[i - 1]))
                    i -= 1
                else:
                    ids.append(piece)
                    i -= sizes[piece]
            ids.reverse()
            yield ids
            before = word

    def _unigram_piece(self, word: str, i: int, last: list[str]) -> str:
        """Last piece of the best encoding of word[:i]; an unknown character costs 10 more than any piece."""
        best, chosen = None, ""
        for size in range(1, min(i, self.v.longest) + 1):
            piece = word[i - size : i]
            k = self.v.ids.get(piece)
            if k is None and size > 1:
                continue
            score = self.scores[i - size] + (self.v.least - 10 if k is None else self.v.scores[k])
            if best is None or score > best:
                best, chosen = score, piece
        self.scores[i:] = [best]
        return chosen

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the words, which must be sorted, one after another."""
        return self._segment_bpe(words) if self.v.is_bpe else self._segment_unigram(words)

    def _segment_unigram(self, words: list[str]) -> Iterator[list[int]]:
        last, before, ids = [""], "", self.v.ids
        self.scores = [0.0]
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            del self.scores[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                last.append(self._unigram_piece(word, i, last))
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            pieces.reverse()
            found = [ids.get(x) for x in pieces]
            yield [k for x in pieces for k in self._ids(x)] if None in found else found
            before = word

    def _ids(self, piece: str) -> list[int]:
        if (k := self.v.ids.get(piece)) is not None:
            return [k]
        if not self.v.byte_ids:
            return [self.v.unknown]
        return [self.v.byte_ids[b] for b in piece.encode()]


def words_of(text: str | None) -> list[str]:
    """The words of a text: each with the mark of a space before it, joined, they are the text with marks for spaces."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.search, self.v = PrefixViterbi(vocabulary), vocabulary
        self.recent, self.older = {}, {}  # words and their ids, as bytes: those met lately, and those met before
        said = [bytes([vocabulary.byte_of[i]]) if i in vocabulary.byte_of else p.replace(MARK, " ").encode() if i in vocabulary.ordinary else b"" for i, p in enumerate(vocabulary.pieces)]
        said[vocabulary.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(x) for x in said])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(said), np.uint8)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        words = [words_of(x) for x in texts]
        every = list(itertools.chain.from_iterable(words))
        distinct, new = dict.fromkeys(every), []
        for w in distinct:
            if (known := self.recent.get(w)) is None and (known := self.older.get(w)) is not None:
                self.recent[w] = known
            if known is None:
                new.append(w)
            distinct[w] = known
        new.sort()
        for w, ids in zip(new, self.search.segment([MARK + w for w in new])):
            distinct[w] = known = array.array("i", ids).tobytes()
            if len(w) <= LONG:
                self.recent[w] = known
        if len(self.recent) > CACHED:
            self.recent, self.older = {}, self.recent
        found = list(map(distinct.__getitem__, every))
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)))
        of_text = ends[np.concatenate(([0], np.cumsum([len(some) for some in words], dtype=np.int64)))]
        return np.frombuffer(b"".join(found), np.int32), of_text

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of consecutive ranges of ids."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)].tobytes()
        cut = ends[at].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cut, cut[1:])]


def _codec(vocabulary: Vocabulary) -> Codec:
    """The codec of this worker, which keeps its words from one task to the next."""
    return kept(("codec", vocabulary.key), lambda: Codec(vocabulary))


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("round_trip", T.BooleanType()),
]


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``n_tokens``, ``token_ids`` and whether decoding them gives the text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path(docs.sparkSession, model)))

    def make():
        codec = _codec(shared.value)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            ids, at = codec.encode(texts)
            back = codec.decode(ids, at)
            return [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array([a == (b or "") for a, b in zip(back, texts)])]

        return work

    return append_columns(docs, text, FIELDS, make)


def decode(rows: DataFrame, ids: str = "token_ids", into: str = "decoded", model: str | None = None) -> DataFrame:
    """The rows with the text of their ids; null ids give null, ids outside the vocabulary are an error."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model_path(rows.sparkSession, model)))
    kept = rows.drop(into)
    schema = T.StructType([*kept.schema, T.StructField(into, T.StringType())])

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            some = [x or [] for x in column.to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in some], dtype=np.int64)))
            texts = codec.decode(np.array([k for x in some for k in x], np.int64), at)
            texts = [None if x is None else t for x, t in zip(column.to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def op6(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text")).drop("text")
