"""Fill-in-middle examples: a text's middle goes to its end, by rotations of one block that undo exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.marks import check_marks
from dockledger.llm.ranges import fresh, slices

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """What stands in front of the three segments; none may start inside another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        check_marks([self.prefix, self.suffix, self.middle])

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def rotate(block: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbours [start, cut) and [cut, end) of a block: reverse each, then both."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        block[a:b] = block[a:b][::-1]


def line_cuts(text: bytes) -> np.ndarray:
    """Byte offsets between the lines of a text, from 0 to its end; a line ends after its newline."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    rest = [len(text)] if text and not text.endswith(b"\n") else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def transform(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with sentinels, cut at two byte offsets and rotated into ``form``."""
    prefix, suffix, middle = marks
    block = bytearray(text)
    block[second:second] = suffix
    block[first:first] = middle
    block[:0] = prefix
    head = len(prefix) + first
    tail = len(suffix) + len(text) - second
    rotate(block, head, head + len(middle) + second - first, len(block))
    if form == SPM:
        rotate(block, 0, head, head + tail)
    return block


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text that :func:`transform` was given: the rotations back, then the sentinels out."""
    prefix, suffix, middle = marks
    block = bytearray(output)
    if form == PLAIN:
        return block
    if form == SPM:
        rotate(block, 0, block.index(prefix), block.index(middle))
    rotate(block, block.index(suffix), block.index(middle), len(block))
    for mark in (suffix, middle, prefix):
        at = block.index(mark)
        del block[at : at + len(mark)]
    return block


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50,
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """Each row with its text cut at two line borders and its middle moved behind the rest.

    The draw of a row is the SHA-256 of ``seed``, a colon and its key, so a task that runs again
    cuts as before. Two of its numbers choose the borders, the third makes ``rate`` of 100 rows an
    example, the fourth ``spm`` of 100 examples start with the suffix. Adds n (lines of the text), form
    (plain, psm, spm), prefix_chars and middle_chars (code points; null if plain) and output;
    columns called so are replaced.

    A null or empty text, one that holds a sentinel, and a row not drawn are plain: output is the
    text, for null the empty one. Rows with a null key share one draw, as do repeated keys. No row meets
    another, and nothing is shuffled; a task holds 256 texts at a time, whole ones of any length.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    (draw,) = fresh([*docs.columns, *added], "__draw")
    kept = [f for f in docs.schema.fields if f.name.lower() not in added]
    if not {text.lower(), key.lower()} <= {f.name.lower() for f in kept}:
        raise ValueError(f"text and key must not be called like one of {added}")
    marks = sentinels.encoded()
    number = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = docs.select(*[f.name for f in kept], F.sha2(number, 256).alias(draw))
    names = [f.name for f in kept]

    def one(value: bytes, digits: str):
        h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
        cuts = line_cuts(value)
        n = len(cuts) - 1
        if not value or h3 % 100 >= rate or any(m in value for m in marks):
            return n, PLAIN, None, None, value
        first, second = (int(cuts[c]) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = SPM if h4 % 100 < spm else PSM
        chars = [len(value[a:b].decode()) for a, b in ((0, first), (first, second))]
        return n, form, *chars, bytes(transform(value, first, second, form, marks))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            values = batch.column(text).cast(pa.binary()).to_pylist()
            rows = [one(v or b"", d) for v, d in zip(values, batch.column(draw).to_pylist())]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            new = [
                pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], names=[*names, *added])

    long, string = T.LongType(), T.StringType()
    schema = T.StructType(
        [*kept, *[T.StructField(n, t) for n, t in zip(added, (long, string, long, long, string))]]
    )
    return drawn.mapInArrow(made, schema)


def restored(rows: DataFrame, sentinels: Sentinels = Sentinels(), column: str = "restored") -> DataFrame:
    """Rows with ``form`` and ``output`` and, added or replaced, the text that they were made of.

    Rows without an output get null. An output that lacks the sentinels of its form raises an error.
    """
    marks = sentinels.encoded()
    kept = [f for f in rows.schema.fields if f.name.lower() != column.lower()]
    names = [f.name for f in kept]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            pairs = zip(batch.column("output").cast(pa.binary()).to_pylist(), batch.column("form").to_pylist())
            texts = [None if o is None else bytes(restore(o, f, marks)) for o, f in pairs]
            whole = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], whole], names=[*names, column])

    return rows.select(*names).mapInArrow(back, T.StructType([*kept, T.StructField(column, T.StringType())]))


def infill_report(docs: DataFrame) -> DataFrame:
    """Each document's cuts and the digests of its output and of the text restored from that."""
    rows = restored(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
