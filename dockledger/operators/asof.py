"""The last table row at or before each row's time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.operators.skew import is_small, joined_to_groups, ranged_groups

_RESERVED = ("_at", "_kind", "_row", "_value", "_found", "_before", "_periods")


def as_of(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], at: str, since: str, fields: Sequence[str],
    found: str = "found", limit: int | None = None,
) -> DataFrame:
    """All rows, with ``fields`` of the table row of the same keys whose ``since`` is the last not after ``at``.

    ``found`` says whether there is one; the fields are null if not, as for null keys or times. Of
    table rows with the same keys and ``since`` the greatest by its fields counts. Columns of
    ``rows`` are kept.

    A table of a checked size is broadcast as one sorted list for each key, and rows stay where they are.
    Beyond that, rows and table are laid out together by keys and time, and each row takes the last
    table row in front of it; the rows of a hot key lie in several ranges, and a range starts with what
    the ranges before it ended with.
    """
    keys, fields = list(keys), list(fields)
    known = table.select(*keys, F.col(since).alias("_at"), F.struct(*fields).alias("_value")).dropna(subset=[*keys, "_at"])
    if is_small(table.select(*keys, since, *fields)):
        lists = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_periods"))
        both = rows.join(F.broadcast(lists), keys, "left")
        past = F.filter("_periods", lambda p: p["_at"] <= F.col(at))
        both = both.withColumn("_found", F.try_element_at(past, F.lit(-1))["_value"])
        return _shown(both, rows.columns, fields, found)
    events = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    starts = known.withColumn("_kind", F.lit(0))
    laid, parted = ranged_groups(
        events.unionByName(starts, allowMissingColumns=True), keys, ["_at", "_kind"], limit
    )
    upto = Window.partitionBy(*keys, "_range").orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumn("_found", F.last("_value", ignorenulls=True).over(upto))
    if parted:
        ends = laid.where("_range > 0 and _kind = 0").groupBy(*keys, "_range").agg(
            F.max(F.struct("_at", "_value")).alias("_end")
        )
        ranges = laid.where("_range > 0").select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.select(*keys, "_range", F.last("_end", ignorenulls=True).over(earlier)["_value"].alias("_before"))
        out = joined_to_groups(out, carried, [*keys, "_range"]).withColumn("_found", F.coalesce("_found", "_before"))
    matched = out.where("_kind = 1").select("_found", "_row.*")
    usable = F.lit(True)
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    return _shown(matched.withColumn("_found", F.when(usable & F.col(at).isNotNull(), F.col("_found"))), rows.columns, fields, found)


def _shown(both: DataFrame, columns: Sequence[str], fields: Sequence[str], found: str) -> DataFrame:
    return both.select(
        *columns, *[F.col("_found")[f].alias(f) for f in fields], F.col("_found").isNotNull().alias(found)
    )


def valid_on(rows: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, since: str, until: str, holds: Column | None = None) -> DataFrame:
    """Rows with ``qualified``: whether the supplier's qualification of that date was valid.

    ``periods`` has one row for each change of a supplier's qualification: from ``since`` (included) to ``until``
    (excluded; null: open). The last one that began counts, even if an earlier one is longer.
    ``holds`` is a further condition on the period. A supplier without a period is not qualified.
    """
    good = F.lit(True) if holds is None else F.coalesce(holds, F.lit(False))
    listed = periods.withColumn("_holds", good)
    matched = as_of(rows, listed, keys, at, since, [until, "_holds"], "_listed")
    in_time = F.col(until).isNull() | (F.col(at) < F.col(until))
    return matched.withColumn("qualified", F.col("_listed") & F.coalesce(F.col("_holds"), F.lit(False)) & in_time).drop("_listed", "_holds")
