"""Removal of byte strings that occur before, by prefix doubling over documents.

The positions of all texts are named by the bytes that follow them. Names double in length inside a
text: the name of 2h bytes is made of the names of h bytes at a position and h further on.
Spark sorts positions by their names at growing lengths; a position whose name is unique
goes no further. Names are 64-bit hashes, so ranks of equal strings are equal without a global
count, and two of them together tell strings apart.

* Length 32. Every window of ``length`` bytes is named by the smallest 32-byte name in it.
  Neighbouring windows mostly share it; such a run of windows is one row, about one for
  35 bytes. A run whose name occurs once holds no repeated window. Runs of one name are compared as a
  whole (up to 168 bytes): all but the first of equal runs repeat. A name with one kind of run is
  settled, unless the run is periodic.
* Length 89. What is left, the ends of longer matches, is cut into blocks of 12 windows, named by the
  bytes that they share, and ranked in the same way.
* Length 100. What is left then is ranked window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.ranges import laid_out, saved, slices

LENGTH = 100
# Windows of a block in the second round.
BLOCK = 12
_SHORT, _LONG = 32, 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


# One odd random-looking number for each byte value and each doubling.
_BYTE = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_STEP = _mixed(_mixed(np.arange(1001, 1033, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def _pair(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    return _mixed(x * _STEP[level] + y)


def _names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of 32 and of 64 bytes at every position that has so many."""
    name, size, short = _BYTE[raw], 1, None
    while size < _LONG:
        name = _pair(name[: len(name) - size], name[size:], size.bit_length())
        size *= 2
        if size == _SHORT:
            short = name
    return short, name


def _named(long: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes from each position of ``at``."""
    out, step = long[at], _LONG
    while step < length - _LONG:
        out = _pair(out, long[at + step], 8)
        step += _LONG
    return _pair(out, long[at + length - _LONG], 9)


def _whole(long: np.ndarray, at: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Names of all bytes of so many windows from each position of ``at``."""
    last = at + counts + length - 1 - _LONG
    out = long[at] + counts.astype(np.uint64) * _STEP[30]
    for _ in range(-(-(2 * length) // _LONG) - 1):
        at = np.minimum(at + _LONG, last)
        out = _pair(out, long[at], 10)
    return out


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum over each ``width`` neighbours."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = pick(out[: len(out) - step], out[step:])
        size += step
    return out


def _repeating(short: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Smallest names that a run of windows may hold more than once, as periodic text does."""
    edge = np.zeros(width - 1, dtype=np.uint64)
    of_windows = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    at = np.flatnonzero(short == of_windows)
    at = at[np.argsort(short[at], kind="stable")]
    names = short[at]
    return names[1:][(names[1:] == names[:-1]) & (np.diff(at) < 2 * width)]


def _runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest short name.

    Returns that name, the name of the whole run, its first window, the number of windows, and whether
    windows inside the run may be equal.
    """
    short, long = _names(raw)
    width = length - _SHORT + 1
    least = _sliding(short, width, np.minimum)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [len(least)])))
    if counts.max() > width:  # periodic text
        parts = -(-counts // width)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * width
        counts = np.minimum(np.repeat(counts, parts) - nth * width, width)
    whole = _whole(long, starts, counts, length)
    return least[starts], whole, starts, counts, np.isin(least[starts], _repeating(short, least, width))


def _later(doc: np.ndarray, at: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Which rows have a row with the same names in an earlier document or place."""
    order = np.lexsort((at, doc, *names))
    same = np.ones(len(order) - 1, dtype=bool) if len(order) else np.empty(0, dtype=bool)
    for name in names:
        ordered = name[order]
        same &= ordered[1:] == ordered[:-1]
    out = np.zeros(len(order), dtype=bool)
    out[order[1:]] = same
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of each row in the order of doc_id.

    That is doc_id itself where it is a whole number, without nulls or repetitions. Otherwise
    the rows are numbered, nulls last and rows with one id by their text.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer"):
        each = docs.groupBy("doc_id").count()
        if each.where("doc_id is null or count > 1").limit(1).count() == 0:
            # Never null, so that no join puts a filter of its own below the exchange of the texts.
            return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    laid = laid_out(docs, [F.asc_nulls_last("doc_id"), F.asc("text")])
    return laid.select("doc_id", "text", F.monotonically_increasing_id().alias("doc"))


def _arrow(**columns: np.ndarray) -> pa.RecordBatch:
    made = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(made, names=list(columns))


_ROWS = "doc long, name long, whole long, at int, n int, inside boolean, known boolean"


def _rows(doc, name, whole, at, n, inside) -> pa.RecordBatch:
    """Rows of _ROWS. One that this block of documents already holds needs no sorting: it
    is known, and gets a name of its own, which spreads such rows."""
    known = _later(doc, at, whole, name)
    name = np.where(known, _pair(_mixed(doc.astype(np.uint64)), at.astype(np.uint64), 11), name)
    return _arrow(
        doc=doc, name=name, whole=whole, at=at.astype(np.int32), n=n.astype(np.int32), inside=inside, known=known
    )


def _first_pass(length: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
                if len(raw) >= length:
                    found.append(_runs(raw, length))
                    docs.append(np.full(len(found[-1][0]), doc, dtype=np.int64))
            if not found:
                continue
            doc = np.concatenate(docs)
            name, whole, at, n, inside = (np.concatenate(c) for c in zip(*found))
            yield _rows(doc, name, whole, at, n, inside)

    return runs


def _finer_pass(length: int, size: int):
    """Cut runs into blocks of at most ``size`` windows, named by the bytes that all of a block's windows share.

    A window is placed by how far before its smallest short name it starts, so equal windows fall into
    the same block wherever their runs begin.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length - _SHORT + 1
        for batch in slices(batches):
            found = []
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                short, long = _names(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8))
                n = np.array([r["n"] for r in runs])
                at = np.repeat([r["at"] for r in runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at.sort()
                before = np.concatenate([
                    short[some[:, None] + np.arange(width)].argmin(axis=1)
                    for some in np.array_split(at, -(-len(at) // 4096))
                ])
                least, block = at + before, before // size
                new = np.flatnonzero((np.diff(least) != 0) | (np.diff(block) != 0) | (np.diff(at) != 1)) + 1
                start = np.concatenate(([0], new))
                count = np.diff(np.concatenate((start, [len(at)])))
                least, block, at = least[start], block[start], at[start]
                name = _pair(_named(long, least - size * block, length - size + 1), short[least], 12)
                name = _pair(name, block.astype(np.uint64), 13)
                whole = _whole(long, at, count, length)
                found.append((np.full(len(at), doc, np.int64), name, whole, at, count))
            if found:
                doc, name, whole, at, n = (np.concatenate(c) for c in zip(*found))
                yield _rows(doc, name, whole, at, n, np.zeros(len(at), dtype=bool))

    return blocks


def _covered(size: int, spans: list, length: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int32)
    if spans:
        at = np.array([s["at"] for s in spans])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + np.array([s["n"] for s in spans]) + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _ranked(rows: DataFrame) -> DataFrame:
    """Sort rows by their names: those that repeat an earlier one (``gone``), and those that may hold more.

    Of rows with one name and one whole name, the first stays. It is needed again if its name has
    another whole name too, or if it may repeat inside. All other rows have nothing to find.
    """
    by_name = Window.partitionBy("name")
    again = F.lag("whole").over(by_name.orderBy("whole", "doc", "at")).eqNullSafe(F.col("whole"))
    kinds = F.min("whole").over(by_name) != F.max("whole").over(by_name)
    marked = rows.select("*", again.alias("again"), kinds.alias("kinds"))
    gone = F.col("known") | F.col("again")
    return marked.select(
        "doc", "at", "n", gone.alias("gone"), (F.col("kinds") | F.col("inside")).alias("open")
    ).where("gone or open")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes left, ``kept``, of each document.

    A byte goes if a string of ``length`` bytes (64 at least) that covers it also starts earlier: in
    a document with a smaller doc_id, or further to the front. Strings are judged on the input and never cross
    documents. A null text is empty. Rows that share an id are documents of their own,
    ordered by text; a null id comes last. Cutting bytes may split a character, so ``kept``
    is binary. Texts are shuffled once: the later passes take the same columns of them.

    A string in very many documents gives one row to sort for each block of documents
    that a task reads.
    """
    if length < _LONG:
        raise ValueError(f"length must be at least {_LONG}")
    keyed = _keyed(docs)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = saved(_ranked(keyed.select("doc", "text").mapInArrow(_first_pass(length), _ROWS)), "runs")
    placed = keyed.repartition(partitions, "doc")

    def finer(open_runs: DataFrame, size: int) -> DataFrame:
        by_doc = open_runs.where("not gone").groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
        texts = placed.join(by_doc, "doc").select("doc", "text", "runs", "doc_id")
        return _ranked(texts.mapInArrow(_finer_pass(length, size), _ROWS))

    blocks = finer(runs, min(BLOCK, length - _LONG + 1))
    windows = finer(blocks, 1)
    gone = [r.where("gone").select("doc", "at", "n") for r in (runs, blocks, windows)]
    spans = (
        gone[0].union(gone[1]).union(gone[2]).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
                gone = _covered(len(raw), found or [], length)
                rises = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(raw), int(gone.sum()), rises, raw[~gone].tobytes()))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            kept = pa.array([r[3] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return placed.join(spans, "doc", "left").select("doc_id", "text", "spans", "doc").mapInArrow(
        cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document the bytes and spans removed, and the digest of what is left."""
    out = remove_repeats(docs, length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
