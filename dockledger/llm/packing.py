"""Packing of tokenised documents by their length histogram, shortest pack first."""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import PART, laid_out, saved, sized

CAPACITY = 2048
END_ID = 1
# Words whose ids a Python worker keeps between tasks, besides those of the last block. A word takes about
# 50 bytes. More words save time where a worker does little else; they change no id.
CACHED_WORDS = 1_000_000
# Bytes of text encoded in one go.
BLOCK_BYTES = 8 << 20
# By tokenizer: itself, the words and their ids.
_kept: dict[str, tuple[object, list[pa.Array]]] = {}


_SYMBOLS = r"([!-&(-/:-@\[-`{-~]*)"
_WORD = re.compile(rf"([^\W\d_]+){_SYMBOLS}")
_ASCII_WORD = rf"^(?P<letters>[A-Za-z]+){_SYMBOLS.replace('(', '(?P<symbols>', 1)}$"


def _parts(word: str) -> tuple[str, str]:
    """Letters as the tokenizer normalises them, and ASCII symbols after them that it surely parts from them.

    Other words come back whole. It normalises first, and then a mark at the letters' end would be one piece with the
    symbols. Alphabets up to U+052F are told, others not: newer letters depend on the version of Unicode. An apostrophe
    may begin a piece with letters, and a capital sigma is lower-cased by its place.
    """
    found = _WORD.fullmatch(word)
    if not found:
        return word, ""
    letters, symbols = found.groups()
    if letters.isascii():
        return letters.lower(), symbols
    composed = unicodedata.normalize("NFC", letters)
    plain = composed.lower()
    if not letters.isalpha() or not plain.isalpha() or max(plain) >= "\u0530":
        return word, ""
    if "\u03a3" in composed or not unicodedata.is_normalized("NFC", plain):
        return letters, symbols
    return plain, symbols


def _all_parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """:func:`_parts` of each word."""
    found = pc.extract_regex(words, _ASCII_WORD)
    letters, symbols = pc.struct_field(found, "letters"), pc.struct_field(found, "symbols")
    base = pc.if_else(found.is_valid(), pc.ascii_lower(letters), words)
    symbols = pc.if_else(found.is_valid(), symbols, pa.scalar("", words.type))
    other = pc.invert(pc.string_is_ascii(words))
    parts = [_parts(w) for w in words.filter(other).to_pylist()]
    return tuple(
        pc.replace_with_mask(some, other, pa.array([p[i] for p in parts], words.type))
        for i, some in enumerate((base, symbols))
    )


def _found(words: pa.Array, known: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Where each word is among the known ones followed by the unknown, and the unknown."""
    at = pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False)
    unknown = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
    at = np.where(unknown, len(known) + np.cumsum(unknown) - 1, at).astype(np.int64)
    return pa.array(at), words.filter(pa.array(unknown))


class WordEncoder:
    """Ids of texts by a tokenizer that never joins characters across a space or line end.

    Words are encoded once and kept; new words of a block of texts are encoded in one call, with
    a mark of one known id between them. The ids are those of encoding the whole text.
    """

    MARK = "\x01"

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        if path not in _kept:
            _kept[path] = (Tokenizer.from_file(path), [pa.array([], pa.large_string()), pa.array([], pa.large_binary())])
        self.tokenizer, self.known = _kept[path]
        self.cached = cached
        (self.mark,) = self._ids(self.MARK)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learned(self, new: pa.Array) -> pa.Array:
        """Ids of words that are not kept yet."""
        marked = pc.match_substring(new, self.MARK)
        if pc.any(marked).as_py():
            order = pa.array(np.argsort(np.argsort(marked.to_numpy(zero_copy_only=False), kind="stable")))
            alone = [np.array(self._ids(w), "<u4").tobytes() for w in new.filter(marked).to_pylist()]
            plain = self._learned(new.filter(pc.invert(marked)))
            return pa.concat_arrays([plain, pa.array(alone, pa.large_binary())]).take(order)
        ids, ends, words = [], [np.zeros(1, np.int64)], new.to_pylist()
        for i in range(0, len(words), 2000):
            some = np.array(self._ids(f" {self.MARK} ".join(words[i : i + 2000])), dtype="<u4")
            marks = np.flatnonzero(some == self.mark)
            ids.append(some[some != self.mark])
            ends.append(ends[-1][-1] + np.append(marks - np.arange(len(marks)), len(ids[-1])))
        raw = np.concatenate([np.empty(0, "<u4"), *ids])
        buffers = [None, pa.py_buffer(4 * np.concatenate(ends)), pa.py_buffer(raw)]
        return pa.Array.from_buffers(pa.large_binary(), len(words), buffers)

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        known, ids = self.known
        at, new = _found(words, known)
        if len(new):
            base, symbols = _all_parts(new)
            pieces = pc.unique(pa.concat_arrays([base, symbols]))
            piece_at, unknown = _found(pieces, known)
            learned = self._learned(unknown)
            of_pieces = pa.concat_arrays([ids, learned]).take(piece_at)
            both = [of_pieces.take(pc.index_in(p, value_set=pieces)) for p in (base, symbols)]
            made = pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary()))
            whole = pc.invert(pc.is_in(new, value_set=pieces))
            out = pa.concat_arrays([ids, made]).take(at)
            self.known[:] = [
                pa.concat_arrays([known, unknown, new.filter(whole)]), pa.concat_arrays([ids, learned, made.filter(whole)])
            ]
        else:
            out = ids.take(at)
        if len(self.known[0]) > self.cached:
            self.known[:] = [words, out]
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null texts are empty."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._of_words(coded.dictionary).take(coded.indices)
        _, ends, raw = ids.buffers()
        if raw is None:
            return [b""] * len(texts)
        bounds = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip(bounds, bounds[1:])]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, cached_words: int = CACHED_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: each document's ids and an end id.

    A document is cut into full pieces and a rest. A null or empty text is its end id alone.
    ``tokenizer`` is the path of a tokenizers file that every executor can read. ``with_ids``
    adds the ids themselves; else a piece carries their checksum only. ``cached_words`` and ``block_bytes`` bound
    a worker's memory and change no row.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[doc_id].dataType
    fields = [
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, cached_words)
        for batch in sized(batches, 1, block_bytes):
            ids = [x + end for x in encoder.encode(batch.column(1))]
            of, rows = [], []
            for k, raw in enumerate(ids):
                for at in range(0, len(raw), 4 * capacity):
                    piece = raw[at : at + 4 * capacity]
                    of.append(k)
                    rows.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, piece))
            columns = [batch.column(0).take(pa.array(of, pa.int64()))]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[4], "<i4") for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, T.StructType(fields))


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Shortest-pack-first packing of a length histogram.

    Lengths go longest first, each piece into the open sequence with the most room, or
    into a new one if none has room. Sequences with the same pattern of lengths are one
    range with a count, so the work depends on ``capacity``, not on the number of pieces.

    Returns the runs, one row each, in the order of the pieces sorted by falling length:
    position of the run's first piece, first sequence, pieces per sequence, offset of
    the first piece, length. Piece i of a run lies in sequence first + i // per at offset
    + (i % per) * length. Also returns the number of sequences.
    """
    open_packs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = position = 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_packs:
                open_packs[gap] = []
                heapq.heappush(gaps, -gap)
            open_packs[gap].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        left = histogram[length]
        while left:
            if not gaps or -gaps[0] < length:
                per = capacity // length
                for n, each in ((left // per, per), (1, left % per)):
                    if n and each:
                        runs.append((position, sequences, each, 0, length))
                        keep(capacity - each * length, sequences, n)
                        position, sequences = position + n * each, sequences + n
                left = 0
                continue
            gap = -gaps[0]
            first, n = open_packs[gap].pop()
            if not open_packs[gap]:
                del open_packs[gap]
                heapq.heappop(gaps)
            # How many pieces go into these before another sequence has more room.
            each = (gap - max(length, -gaps[0] if gaps else 0)) // length + 1
            each = min(each, max(1, left // n))
            filled = min(n, left // each)
            runs.append((position, first, each, capacity - gap, length))
            keep(gap - each * length, first, filled)
            keep(gap, first + filled, n - filled)
            position += filled * each
            left -= filled * each
    return np.array(runs, dtype=np.int64).reshape(-1, 5), sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset`` in it.

    ``pieces`` has doc_id, start and length (1 to ``capacity``), and any other columns,
    which are kept; columns called like the new ones are replaced. The pieces are sorted once over all
    partitions by falling length, so a piece's rank follows from the counts of the partitions
    before it, and a length that holds most pieces is spread like any other. The driver sees one count per length and per
    partition. The packing patterns, whose number depends on ``capacity`` alone, go to the tasks. Offsets
    are gapless in each sequence. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    laid = laid_out(pieces, [F.desc("length"), F.asc("doc_id"), F.asc("start")])
    histogram = dict(laid.groupBy("length").count().collect())
    runs, _ = pack_histogram(histogram, capacity)
    counts, at, firsts = dict(laid.groupBy(PART).count().collect()), 0, {}
    for part in sorted(counts):
        firsts[part], at = at, at + counts[part]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            if at is None:
                at = firsts[batch.column(names.index(PART))[0].as_py()]
            where = at + np.arange(batch.num_rows)
            at += batch.num_rows
            run = np.searchsorted(runs[:, 0], where, side="right") - 1
            i = where - runs[run, 0]
            sequence = runs[run, 1] + i // runs[run, 2]
            offset = runs[run, 3] + (i % runs[run, 2]) * runs[run, 4]
            kept = [n for n in names if n != PART]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(n)) for n in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    out = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return laid.mapInArrow(place, out)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, cached_words: int = CACHED_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Tokenise whole documents once, cut them and pack the pieces."""
    pieces = token_pieces(docs, tokenizer, capacity, cached_words=cached_words, block_bytes=block_bytes)
    return pack_pieces(saved(pieces, "pieces"), capacity)
