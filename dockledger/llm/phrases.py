"""Phrases that stand together more often than their parts, counted once in each distinct chunk of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.ranges import saved, slices
from dockledger.operators.skew import attach

# What parts a text into pieces, and the one of them that stands for all.
_STOPS, _CUT = b".,;:!?\x0a\x0b\x0c\x0d", b"\n"
_LOWER = bytes.maketrans(
    bytes(range(65, 91)) + _STOPS + b"\t", bytes(range(97, 123)) + _CUT * len(_STOPS) + b" "
)
# Longest filter of frequent phrases that tasks are sent: 2^29 bits, 64 MB.
MAX_FILTER_BITS = 29
# Chunks, or texts, that a task works on at a time.
CHUNKS, TEXTS = 131_072, 1_024

_COUNTED = "lang string, phrase string, n long"


def text_words(texts: list[bytes | None]) -> pa.Array:
    """The words of texts in lower case (A to Z), with a cut in front of each piece and at the end."""
    pieces = _CUT.join([b"", *[t or b"" for t in texts], b""])
    split = pc.split_pattern(pa.array([pieces.translate(_LOWER).replace(_CUT, b" \n ")], pa.large_binary()), b" ")
    words = split.flatten().cast(pa.binary())
    return words.filter(pc.not_equal(words, b""))


def joined(words: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of words as phrases."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.take(pa.array(at)))
    return pc.binary_join(lists, b" ")


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in the order of their first use, and for each word its place among them."""
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def chunk_bounds(hashes: np.ndarray, cut: np.ndarray, overlap: int, every: int) -> tuple[np.ndarray, ...]:
    """Start and end of each chunk among the words, and whether it is the last of its piece.

    ``hashes`` has a 64-bit hash for each word, ``cut`` says which are no words but end a piece; the last
    one is. A chunk ends with a window of ``overlap`` words whose hash is divisible by ``every``, and the next
    one starts with that window: where a text repeats, its chunks repeat, whatever stands
    around it. Each run of up to ``overlap`` + 1 words lies in a chunk whole, and starts in front of
    the closing window of just one, or in the last.
    """
    n = len(hashes)
    at = np.arange(n)
    end = np.minimum.accumulate(np.where(cut, at, n)[::-1])[::-1]
    first = ~cut & np.concatenate([[True], cut[:-1]])
    padded, window = np.append(hashes, np.zeros(overlap, np.uint64)), np.zeros(n, np.uint64)
    for i in range(overlap):
        window = (window ^ padded[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    window ^= window >> np.uint64(29)
    inside = ~cut & ~first & (end - at > overlap)
    starts = np.flatnonzero(first | inside & (window % np.uint64(every) == 0))
    ends = end[starts]
    following = np.append(starts, n)[1:]
    last = following >= ends
    return starts, np.where(last, ends, following + overlap), last


def _sent(lang: str, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
    """Counts of one language's phrases as an Arrow batch."""
    return pa.RecordBatch.from_arrays(
        [pa.repeat(lang, len(phrases)), phrases.cast(pa.string()), n], names=["lang", "phrase", "n"]
    )


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang")
    for lang in langs.unique().to_pylist():
        yield lang, batch.filter(pc.equal(langs, lang))


def chunk_dictionary(docs: DataFrame, longest: int = 5, every: int = 16) -> DataFrame:
    """The distinct chunks of all texts by language, with the number of times the parse holds each."""
    overlap = longest - 1

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            for lang, texts in _by_lang(batch):
                words = text_words(texts.column("text").cast(pa.binary()).to_pylist())
                names, ids = numbered(words)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))[ids]
                starts, ends, last = chunk_bounds(hashes, ids == 0, overlap, every)
                for is_last in (False, True):
                    which = last == is_last
                    counts = joined(words, starts[which], (ends - starts)[which]).value_counts()
                    out = _sent(lang, counts.field("values"), counts.field("counts"))
                    yield out.append_column("last", pa.repeat(is_last, out.num_rows))

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    chunks = texts.mapInArrow(parsed, f"{_COUNTED}, last boolean")
    return chunks.groupBy("lang", "phrase", "last").agg(F.sum("n").alias("n"))


class Chunks:
    """Chunks of one language as numbers: words, and for each place what may start there and how often."""

    def __init__(self, lang: str, batch: pa.RecordBatch, overlap: int):
        split = pc.split_pattern(batch.column("phrase"), " ")
        last, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "n"))
        self.lang, sizes = lang, pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.names, self.ids = numbered(split.flatten().cast(pa.binary()))
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(sizes, sizes) - place
        self.starts = place < np.repeat(sizes - np.where(last, 0, overlap), sizes)
        self.weight = np.repeat(weight, sizes)

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of the language and the word at each place, as Spark's xxhash64 makes it."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), 42)
        made = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names.to_pylist()), np.uint64, len(self.names))
        return made[self.ids]

    def groups(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of its phrase of ``size`` words, two or more, and a place for each number."""
        code, first = self.ids[at], at
        for i in range(1, size):
            code = code * len(self.names) + self.ids[at + i]
            _, index, code = np.unique(code, return_index=True, return_inverse=True)
            first = at[index]
        return code, first

    def counted_words(self) -> pa.RecordBatch:
        """The distinct words that start a phrase, with their occurrences."""
        n = np.zeros(len(self.names), np.int64)
        np.add.at(n, self.ids[self.starts], self.weight[self.starts])
        held = np.flatnonzero(n)
        return _sent(self.lang, self.names.take(pa.array(held)), pa.array(n[held]))

    def counted(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """The distinct phrases of ``size`` words that start at these places, with their occurrences."""
        code, first = self.groups(at, size)
        n = np.zeros(len(first), np.int64)
        np.add.at(n, code, self.weight[at])
        words = self.names.take(pa.array(self.ids[first[:, None] + np.arange(size)].ravel()))
        starts = np.arange(len(first)) * size
        return _sent(self.lang, joined(words, starts, np.full(len(first), size)), pa.array(n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together, so that a block's chunks share their words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNKS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _each(chunks: DataFrame, overlap: int, count: Callable[[Chunks], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What a function makes of all chunks, a block of one language at a time."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for lang, some in _by_lang(block):
                yield from count(Chunks(lang, some, overlap))

    return chunks.select("lang", "phrase", "last", "n").mapInArrow(counted, schema)


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


class Frequent:
    """Which hashes may be of something frequent: one bit for each, set by all that are.

    A bit set by another hash costs work and never changes a count. The number of bits follows the number
    of hashes (about 64 each) up to a fixed bound, beyond which more of them pass.
    """

    def __init__(self, hashes: DataFrame, max_bits: int = MAX_FILTER_BITS):
        self.bits = min(max(hashes.count() * 64, 1 << 18).bit_length(), max_bits)
        slot = F.pmod("hash", F.lit(1 << self.bits)) + 1
        rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
        ).collect()
        marks = np.zeros(max(1 << (self.bits - 3), 4096), np.uint8)
        for row in rows:
            part = np.frombuffer(bytes(row["bits"]), np.uint8)
            marks[(row["bucket"] - 1) * len(part) :][: len(part)] = part
        self.marks = hashes.sparkSession.sparkContext.broadcast(marks.tobytes())

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes & np.uint64((1 << self.bits) - 1)
        marks = np.frombuffer(self.marks.value, np.uint8)
        return (marks[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """One hash for the word at each place and the word behind it."""
    behind = np.append(hashes[1:], np.uint64(0))
    return hashes ^ (behind << np.uint64(1) | behind >> np.uint64(63))


def _known_pairs(chunks: Chunks, word: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Places where two words that may be frequent follow each other, and the hash of the pair at each place."""
    hashes = chunks.hashes()
    ok = word.passes(hashes)
    return (chunks.left >= 2) & ok & np.append(ok[1:], False), _pair_hashes(hashes)


def _count_pairs(word: Frequent) -> Callable[[Chunks], Iterator[pa.RecordBatch]]:
    """Hashes of pairs of words that may both be frequent, with the occurrences of each."""
    def count(chunks: Chunks) -> Iterator[pa.RecordBatch]:
        known, pairs = _known_pairs(chunks, word)
        at = known & chunks.starts
        hashes, place = np.unique(pairs[at], return_inverse=True)
        n = np.zeros(len(hashes), np.int64)
        np.add.at(n, place, chunks.weight[at])
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return count


def _count_longer(word: Frequent, pair: Frequent, longest: int) -> Callable[[Chunks], Iterator[pa.RecordBatch]]:
    """Phrases of two words and more, all of whose pairs may be frequent."""
    def count(chunks: Chunks) -> Iterator[pa.RecordBatch]:
        known, pairs = _known_pairs(chunks, word)
        joint = known & pair.passes(pairs)
        held = joint
        for size in range(2, longest + 1):
            yield chunks.counted(np.flatnonzero(held & chunks.starts), size)
            held = held & np.append(joint[size - 1 :], np.zeros(min(size - 1, len(joint)), bool))

    return count


def frequent_phrases(
    docs: DataFrame, longest: int = 5, least: int = 100, every: int = 16
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences, and the words of each language.

    Returns (lang, phrase, size, a) and (lang, n). Three passes over the chunk dictionary count words, then
    hashes of pairs of frequent words, then phrases of pairs whose hash is frequent, as text. A phrase
    is never more frequent than its parts, and a hash never less than a pair that has it, so nothing is lost.
    """
    overlap, frequent = longest - 1, F.col("n") >= least
    chunks = saved(chunk_dictionary(docs, longest, every), "chunks")

    def one(chunks: Chunks) -> Iterator[pa.RecordBatch]:
        yield chunks.counted_words()

    words = saved(_summed(_each(chunks, overlap, one, _COUNTED), "lang", "phrase"), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = words.where(frequent)
    if longest > 1:
        word = Frequent(found.select(F.xxhash64("lang", "phrase").alias("hash")))
        pairs = _summed(_each(chunks, overlap, _count_pairs(word), "hash long, n long"), "hash").where(frequent)
        pair = Frequent(saved(pairs.select("hash"), "pairs"))
        more = _summed(_each(chunks, overlap, _count_longer(word, pair, longest), _COUNTED), "lang", "phrase")
        found = found.unionByName(saved(more.where(frequent), "phrases"))
    size = F.size(F.split("phrase", " "))
    return found.select("lang", "phrase", size.alias("size"), F.col("n").alias("a")), totals


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, cover: int = 100, every: int = 16
) -> DataFrame:
    """The phrases of each language whose parts meet most above chance, ranked from 1.

    Texts are lower-cased (A to Z), parted at punctuation and line ends into pieces, and those at blanks
    into words. A phrase of 2 to ``longest`` words needs ``least`` occurrences (a), overlapping
    ones included. Of its cuts in two parts with l and r occurrences, the one with the lowest score
    floor(1000 * a * n / (l * r)) counts, n being the words of the language; among equal scores the
    first. A phrase is dropped if one with one more word around it has ``cover`` percent of its
    occurrences (a longer one has no more than that). ``top`` phrases of a language stay: highest score, then highest
    a, then least phrase in UTF-8 order, so there are no ties.

    A null text is empty; a null language is ``und``. Texts without words give nothing, as
    does an empty table; repeated rows count each. Other columns are ignored. A task holds 512 texts
    and counts for about 400,000 phrases; a chunk is a part of a text between two triggers,
    in a text that never triggers a whole piece.
    """
    counted, totals = frequent_phrases(docs, longest, least, every)
    candidates = counted.where("size > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        found = counted.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        cuts = attach(cuts, found, ["lang", part], "inner")
    cuts = cuts.join(F.broadcast(totals) if totals.count() < 10_000 else totals, "lang")
    wide = {c: f"cast({c} as decimal(20, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inside = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    longer = candidates.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy(
        "lang", "phrase"
    ).agg(F.max("a").alias("around"))
    left = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a"))
    )
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "rank", F.row_number().over(
            Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ).cast("long"),
    )
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
