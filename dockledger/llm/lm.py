"""Documents scored by the cross-entropy difference of two bigram models."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import fresh, slices

# Slots of words and of word pairs, as powers of two: the shared vocabulary.
WORD_BITS = 18
PAIR_BITS = 20
# Weight of the pair estimate; count added to each word slot.
PAIR_WEIGHT = 0.7
ADDED = 0.1
# Ids of target documents that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CACHED = 250_000
_slots: dict[str, int] = {}


def tokens(text: str) -> np.ndarray:
    """Word slots of a text: words and single symbols, in their case."""
    found = _TOKEN.findall(text)
    if len(_slots) > _CACHED:
        _slots.clear()
    for w in set(found).difference(_slots):
        _slots[w] = xxhash.xxh64_intdigest(w) >> 64 - WORD_BITS
    return np.fromiter(map(_slots.__getitem__, found), np.int64, len(found))


def pairs(words: np.ndarray) -> np.ndarray:
    """Pair slots: each word after the one before it, the first after the text's start."""
    before = np.concatenate(([0], words[:-1] + 1)) if len(words) else words
    mixed = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class Counts:
    """What one corpus holds: tokens of each word slot, tokens of each pair slot, texts."""

    words: np.ndarray
    pairs: np.ndarray
    texts: int
    total: int = field(init=False)

    def __post_init__(self):
        self.total = int(self.words.sum())

    def losses(self, w: np.ndarray, p: np.ndarray, own: bool) -> np.ndarray:
        """Negative log probability of each token, in nats.

        ``own``: the text is part of the corpus; its counts are taken off, so that no
        text is scored by what it says itself.
        """
        word_counts, pair_counts = self.words[w].astype(float), self.pairs[p].astype(float)
        total, texts = float(self.total), float(self.texts)
        if own:
            _, at, n = np.unique(w, return_inverse=True, return_counts=True)
            word_counts -= n[at]
            _, at, n = np.unique(p, return_inverse=True, return_counts=True)
            pair_counts -= n[at]
            total, texts = total - len(w), texts - 1
        # The word before a token, or the start of the text, was seen this often.
        seen = np.concatenate(([texts], word_counts[:-1]))
        single = (word_counts + ADDED) / (total + ADDED * len(self.words))
        paired = np.where(seen > 0, np.minimum(pair_counts / np.maximum(seen, 1), 1.0), single)
        return -np.log(PAIR_WEIGHT * paired + (1 - PAIR_WEIGHT) * single)


def _count_table(docs: DataFrame, target: str) -> DataFrame:
    """(slot, background, target): word slots first, then pair slots, then the number of texts."""
    first, size = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), dtype=np.int64)
        for batch in slices(batches):
            for text, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = tokens(text or "")
                if not len(w):
                    continue
                slots = np.concatenate((w, first + pairs(w), [size - 1]))
                for row in range(1 + bool(mine)):
                    np.add.at(sums[row], slots, 1)
        used = np.flatnonzero(sums[0])
        for i in range(0, len(used), 100_000):
            some = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(sums[0][some]), pa.array(sums[1][some])],
                names=["slot", "background", "target"],
            )

    rows = docs.select("text", target).mapInArrow(counted, "slot int, background long, target long")
    return rows.groupBy("slot").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target: str) -> tuple[Counts, Counts]:
    """The background model, of all documents, and the target model, of those where ``target`` is true.

    Each task sends its counts of the slots it met, summed by slot over the cluster. The driver gets one
    row per slot at most, a number set by WORD_BITS and PAIR_BITS. Every token counts, rare words too.
    """
    got = _count_table(docs, target).toArrow()
    slot = got.column("slot").to_numpy()
    out = []
    for name in ("background", "target"):
        sums = np.zeros((1 << WORD_BITS) + (1 << PAIR_BITS) + 1, dtype=np.int64)
        sums[slot] = got.column(name).to_numpy()
        out.append(Counts(sums[: 1 << WORD_BITS], sums[1 << WORD_BITS : -1], int(sums[-1])))
    return out[0], out[1]


def score(docs: DataFrame, models: tuple[Counts, Counts], target: str) -> DataFrame:
    """Add n_tokens, target_loss, background_loss (per token) and score, their difference.

    A higher score means more like the target. Texts without tokens, null texts too, have losses and a score of 0.
    Columns called like the new ones are replaced; all others stay.
    """
    names = ["n_tokens", "target_loss", "background_loss", "score"]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([
        *docs.schema.fields, T.StructField("n_tokens", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in names[1:]),
    ])
    at, flag = docs.columns.index("text"), docs.columns.index(target)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, wanted = sent.value
        for batch in slices(batches):
            rows = []
            for text, mine in zip(batch.column(at).to_pylist(), batch.column(flag).to_pylist()):
                w = tokens(text or "")
                if len(w):
                    p = pairs(w)
                    near, far = wanted.losses(w, p, bool(mine)).mean(), background.losses(w, p, True).mean()
                    rows.append((len(w), near, far, far - near))
                else:
                    rows.append((0, 0.0, 0.0, 0.0))
            columns = [pa.array([r[0] for r in rows], pa.int64())]
            columns += [pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(scored, schema)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents; the target is every document whose labels all say good quality.

    Labels with a null id or quality are left out. Documents with a null id are never target. Rows that share an
    id are documents of their own.
    """
    good = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("q")).where("q > 0").select("doc_id")
    )
    (target,) = fresh(docs.columns, "__target")
    good = good.withColumn(target, F.lit(True))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    marked = docs.join(good, "doc_id", "left").withColumn(target, F.coalesce(target, F.lit(False)))
    models = fit(marked, target)
    return score(marked, models, target).drop(target)


def lm_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of each document and what it is made of."""
    return cross_entropy_difference(docs.select("doc_id", "text"), labels).drop("text")
