"""Benchmark passages in documents: edit distance by shared runs of words and exact checks.

Texts are sequences of words: runs of letters and digits in lower case. A passage is a run of
a document's words at most ``edits`` word edits from an item.

1. Of n words at most k of which are edited, a run of (n - k) / (k + 1) words stays whole. Only
   places that share such a run with an item go on; no match is lost here.
2. Sellers' alignment against the words around each such run gives the exact distance. Nothing between the two
   steps can lose a match, wherever in the item its edits lie.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import fresh, sized

# Word edits allowed, as a share of an item's words.
EDITS = 0.2
# Items that a task searches at once; a larger benchmark takes several passes.
ITEMS = 20_000
# Bytes of text searched in one go, and words whose hashes a Python worker keeps between them.
BLOCK_BYTES = 1 << 20
_WORD = re.compile(r"\w+")
_CACHED = 50_000
_hashes: dict[str, int] = {}
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text; never zero."""
    words = _WORD.findall(text.lower())
    if len(_hashes) > _CACHED:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w) | 1
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    out = words[: len(words) - size + 1]
    for k in range(1, size):
        out = _mix(out * _PRIME + words[k : len(words) - size + 1 + k])
    return out


def allowed(n: int, edits: float = EDITS) -> int:
    return int(n * edits + 1e-9)


def whole_run(n: int, k: int) -> int:
    """Words of the longest run that k edits must leave whole in n words."""
    return max(1, -(-(n - k) // (k + 1)))


def best_alignment(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edits from the item to any run of ``words``, and the end of the first such run."""
    columns = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (words != word), row[1:] + 1)))
        row = np.minimum.accumulate(new - columns) + columns
    end = int(np.argmin(row))
    return int(row[end]), end


@dataclass
class Items:
    """A bounded block of benchmark items, with what the search looks up."""

    ids: list[int]
    words: list[np.ndarray]
    edits: float
    limits: list[int] = field(init=False)
    grams: dict = field(init=False)

    def __post_init__(self):
        self.limits = [allowed(len(w), self.edits) for w in self.words]
        where = defaultdict(lambda: defaultdict(list))
        for j, w in enumerate(self.words):
            size = whole_run(len(w), self.limits[j])
            for at, g in enumerate(_grams(w, size).tolist()):
                where[size][g].append((j, at))
        self.grams = {}
        for size, found in where.items():
            keys = np.array(sorted(found), dtype=np.uint64)
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.grams[size] = (keys, seen, [found[k] for k in keys.tolist()])

    def _places(self, words: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """First and last start of a match around each shared run, by text and item."""
        out: dict[tuple[int, int], list] = defaultdict(list)
        for size, (keys, seen, where) in self.grams.items():
            if len(words) < size:
                continue
            grams = _grams(words, size)
            at = np.flatnonzero(seen[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            for p, k in zip(at[keys[place] == grams[at]].tolist(), place[keys[place] == grams[at]].tolist()):
                doc = int(np.searchsorted(ends, p, side="right"))
                if p + size > ends[doc]:
                    continue
                first = int(ends[doc - 1]) if doc else 0
                for j, offset in where[k]:
                    limit = self.limits[j]
                    low, high = max(first, p - offset - limit), min(p, p - offset + limit)
                    out[doc, j].append((low, max(low, high)))
        return out

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, first word of the match, words, edits), the best match of each item."""
        found: list[list] = [[] for _ in texts]
        words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        for (doc, j), spans in self._places(words, ends).items():
            match = self._verify(words, int(ends[doc - 1]) if doc else 0, int(ends[doc]), j, sorted(set(spans)))
            if match:
                found[doc].append((self.ids[j], *match))
        return [sorted(f) for f in found]

    def _verify(self, words, first: int, last: int, j: int, spans: list[tuple[int, int]]):
        item, limit, best, at = self.words[j], self.limits[j], None, 0
        while at < len(spans):
            start, stop = spans[at]
            while at < len(spans) and spans[at][0] <= start + len(item):
                stop, at = max(stop, spans[at][1]), at + 1
            low = max(first, start - limit)
            around = words[low : min(last, stop + len(item) + 2 * limit)]
            if np.isin(item, around).sum() < len(item) - limit:
                continue  # each word that is not there takes an edit
            edits, end = best_alignment(item, around)
            if edits <= limit and (best is None or edits < best[2]):
                back, length = best_alignment(item[::-1], around[:end][::-1])
                best = (low + end - length - first, length, edits)
        return best


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, items: int = ITEMS, out: str = "leaks",
) -> DataFrame:
    """Add an array of the items found in each text: (item_id, at, n, edits), at and n in words.

    ``benchmark`` has item_id and text. Items are read in blocks of at most ``items``; each
    block searches all documents, so tasks hold a bounded number of items. Items without a word and items with a null
    text or id are never found; items with equal texts are found each. A null
    text holds nothing. Whole texts are searched. No row moves. A column called like ``out`` is replaced.
    """
    known = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    blocks = max(1, -(-known.count() // items))
    match = T.ArrayType(T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("edits", T.IntegerType()),
    ]))
    docs = docs.drop(out)
    (column,) = fresh(docs.columns, "__found")
    found = docs.withColumn(out, F.array().cast(match))
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        pairs = sorted((r["item_id"], r["text"]) for r in mine)
        pairs = [(i, w) for i, t in pairs if len(w := word_hashes(t))]
        if not pairs:
            continue
        table = Items([i for i, _ in pairs], [w for _, w in pairs], edits)
        schema = T.StructType([*found.schema.fields, T.StructField(column, match)])
        at = found.columns.index("text")

        def search(batches: Iterator[pa.RecordBatch], table=table, schema=schema, at=at) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([
                ("item_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("edits", pa.int32())
            ]))
            for batch in sized(batches, at, BLOCK_BYTES):
                texts = [word_hashes(t or "") for t in batch.column(at).to_pylist()]
                rows = [
                    [dict(zip(("item_id", "at", "n", "edits"), m)) for m in found] for found in table.search(texts)
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=schema.names)

        found = found.mapInArrow(search, schema)
        found = found.withColumn(out, F.concat(out, column)).drop(column)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it, with the place and the edits."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.item_id", "m.at", "m.n", "m.edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    (name,) = fresh(docs.columns, "__leaks")
    return find_leaks(docs, benchmark, out=name).where(F.size(name) == 0).drop(name)
