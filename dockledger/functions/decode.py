"""Bytes of console output to text."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockledger.operators.skew import joined_to_groups, ranged_groups


# Sessions with this flag encode and decode GBK in the JVM.
CHARSETS = "spark.sql.legacy.javaCharsets"
# Values that are Python objects at a time.
_FEW = 64


def _native() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get(CHARSETS, "false").lower() == "true"


def _converted(values: pa.Array, convert: Callable, to: pa.DataType) -> pa.Array:
    """Each value converted, a few at a time; nulls stay."""
    parts = [
        pa.array([None if v is None else convert(v) for v in values.slice(i, _FEW).to_pylist()], to)
        for i in range(0, len(values), _FEW)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], to)


def encode_gbk(text: Column) -> Column:
    if _native():
        return F.encode(text, "GBK")

    @F.arrow_udf("binary")
    def encode(text: pa.Array) -> pa.Array:
        return _converted(text, lambda s: s.encode("gbk", errors="replace"), pa.binary())

    return encode(text)


def decode_output(raw: Column, is_windows: Column) -> Column:
    """GBK on Windows, UTF-8 elsewhere; GBK bytes that do not fit become U+FFFD.

    In the JVM where the session allows Java's charsets. Elsewhere only the Windows rows carry
    bytes into Python; the others pass a null.
    """
    if _native():
        return F.when(is_windows, F.decode(raw, "GBK")).otherwise(F.decode(raw, "UTF-8"))

    @F.arrow_udf("string")
    def decode(raw: pa.Array) -> pa.Array:
        return _converted(raw, lambda b: b.decode("gbk", errors="replace"), pa.string())

    return F.when(is_windows, decode(F.when(is_windows, raw))).otherwise(F.decode(raw, "UTF-8"))


# --- chunks that end inside a character --------------------------------------

# Bytes that can be either half of a GBK character, as Latin-1 letters.
_HALVES = "".join(map(chr, range(0x81, 0xFF)))


def _open_utf8(last: Column) -> Column:
    """How many of the last bytes, up to three, begin a UTF-8 character that needs more."""
    digits = F.hex(last)

    def at(back: int) -> Column:
        return F.substring(F.lpad(digits, 6, "0"), 7 - 2 * back, 2)

    def follows(byte: Column) -> Column:
        return byte.between("80", "BF")

    return (
        F.when(at(1).between("C2", "F4"), 1)
        .when(follows(at(1)) & at(2).between("E0", "F4"), 2)
        .when(follows(at(1)) & follows(at(2)) & at(3).between("F0", "F4"), 3)
        .otherwise(0)
    )


def _tail(raw: Column, size: Column | int) -> Column:
    """The last bytes of a binary value."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.substring(raw, F.length(raw) - F.least(size, F.length(raw)) + 1, F.least(size, F.length(raw)))


def _carried(df: DataFrame, group: list, order: list[str]) -> DataFrame:
    """What lies before each row of a group: up to three bytes, and whether they leave a GBK character open.

    ``_sure_before`` says so where an earlier row is sure; ``_flips`` is the parity of turns since
    then, or since the group's start.
    """
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = Window.partitionBy(*group, F.col("_n") == 0).orderBy(*order)
    ends = F.concat(*[F.coalesce(F.lag("_end", k).over(filled), F.lit(b"")) for k in (3, 2, 1)])
    out = df.withColumns({
        "_ends": _tail(ends, 3), "_turned": F.coalesce(F.sum("_turns").over(before), F.lit(0)),
        "_last": F.lead(F.lit(1)).over(filled).isNull(),
    })
    sure = F.last(F.when(F.col("_sure").isNotNull(), F.struct("_sure", "_turned")), ignorenulls=True).over(before)
    out = out.withColumn("_from", sure)
    return out.withColumns({
        "_sure_before": F.col("_from._sure"),
        "_flips": (F.col("_turned") - F.coalesce(F.col("_from._turned"), F.lit(0))) % 2 == 1,
    }).drop("_from", "_turned")


def decode_chunks(
    chunks: DataFrame, run: str = "run_id", seq: str = "seq", raw: str = "raw", windows: str = "windows",
    text: str = "text", limit: int | None = None,
) -> DataFrame:
    """Chunks of each run's output with their ``text``; a character cut between chunks is in the later one.

    The texts of a run, by ``seq``, together are what its whole output decodes to, wherever it was cut: GBK where
    ``windows`` is true, UTF-8 elsewhere, the same for all chunks of a run. A character that the last chunk
    leaves open becomes U+FFFD. Bytes that are no GBK may give other marks than the whole would.
    Empty and null chunks have empty texts; ``seq`` is unique in its run; a null run is one.

    For UTF-8 the last three bytes before a chunk tell what is open. For GBK it takes all bytes back to the
    last one that can only end a character: a chunk without such a byte hands on what it got if its
    length is even and the opposite if odd, so counting odd ones since the last sure chunk tells. A
    run with very many chunks lies in several ranges, and each range starts with what the ones before leave.
    """
    held = F.coalesce(F.col(raw), F.lit(b""))
    loose = F.length(held) - F.length(F.rtrim(F.decode(held, "ISO-8859-1"), F.lit(_HALVES)))
    rows = chunks.withColumns({
        "_raw": held, "_n": F.length(held), "_end": _tail(held, 3), "_loose": loose,
        "_windows": F.coalesce(F.col(windows), F.lit(False)),
    })
    odd, sure = F.col("_loose") % 2 == 1, F.col("_loose") < F.col("_n")
    rows = rows.withColumns({"_sure": F.when(sure, odd), "_turns": F.when(sure, 0).otherwise(odd.cast("int"))})
    laid, parted = ranged_groups(rows, [run], [seq], limit)
    out = _carried(laid, [run, "_range"], [seq])
    given_ends, given_open, final = F.lit(b""), F.lit(False), F.lit(True)
    if parted:
        # A range is to the ranges what a chunk is to its range.
        mine = F.col("_sure_before") != F.col("_flips")
        after = F.coalesce(F.col("_sure"), F.when(F.col("_turns") == 1, ~mine).otherwise(mine))
        ends = out.where("_range > 0 and _last and _n > 0").select(
            run, "_range", F.lit(1).alias("_n"), _tail(F.concat("_ends", "_raw"), 3).alias("_end"), after.alias("_sure"),
            F.when(after.isNotNull(), 0).otherwise((F.col("_flips").cast("int") + F.col("_turns")) % 2).alias("_turns"),
        )
        handed = _carried(ends, [run], ["_range"]).select(
            run, "_range", F.col("_ends").alias("_given_ends"),
            (F.coalesce("_sure_before", F.lit(False)) != F.col("_flips")).alias("_given_open"),
            F.col("_last").alias("_final"),
        )
        out = joined_to_groups(out, handed, [run, "_range"])
        given_ends = F.coalesce("_given_ends", F.lit(b""))
        given_open = F.coalesce("_given_open", F.lit(False))
        final = F.coalesce("_final", F.lit(True))
    out = out.withColumns({
        "_ends": _tail(F.concat(given_ends, "_ends"), 3),
        "_open": F.coalesce(F.col("_sure_before"), given_open) != F.col("_flips"),
        "_close": F.col("_last") & final,
    })
    left = F.coalesce(F.col("_sure"), F.when(F.col("_turns") == 1, ~F.col("_open")).otherwise(F.col("_open")))
    out = out.withColumns({
        "_in": F.when(F.col("_windows"), F.col("_open").cast("int")).otherwise(_open_utf8(F.col("_ends"))),
        "_out": F.when(F.col("_close"), 0).when(F.col("_windows"), left.cast("int")).otherwise(
            _open_utf8(_tail(F.concat("_ends", "_raw"), 3))
        ),
    })
    whole = F.concat(_tail(F.col("_ends"), F.col("_in")), F.col("_raw"))
    body = F.when(F.col("_n") > 0, F.substring(whole, F.lit(1), F.length(whole) - F.col("_out"))).otherwise(F.lit(b""))
    decoded = out.withColumn(text, decode_output(body, F.col("_windows")))
    return decoded.select(*[c for c in chunks.columns if c != text], text)
