"""Requisition lines to purchase orders: group, look up, price, check, classify, write back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions.text import first_number, outcome_rule, strip, whole_number_text
from dockledger.operators.skew import attach, hot_keys, lookup, repeat_rows

# The project type priced with tax, and both tax settings.
TAXED_PRICE_TYPE = "新住配完善"
TAX_OF_TYPE = (0, "J0")
TAX_OF_OTHERS = (13, "U2")
# Fixed values put on each order.
ORDER_CONSTANTS = {
    "purchasing_org": "15A0",
    "payment_term": "TA01",
    "currency": "RMB",
    "price_unit": 1,
}
# Phrase in a message, outcome code, text written back (None keeps the message).
OUTCOME_RULES = (
    ("超出预算", "OVER_BUDGET", "超预算"),
    ("没有满足选择标准的数据存在", "NO_DATA", None),
    ("行号信息不完整", "INCOMPLETE_LINES", None),
    ("公司信息不正确", "BAD_SUPPLIER", None),
    ("订单金额不正确", "WRONG_AMOUNT", None),
)
# Fixed value: the question after saving that means failure. Any other text there goes on.
VOUCHER_ERROR = "凭证仍有错"


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have all keys. A key that is no column raises Spark's error."""
    return rows.where(reduce(lambda a, b: a & b, [rows[k].isNotNull() for k in keys]))


def group_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups by one or more keys, null keys left out, with their row counts."""
    return with_keys(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def order_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str]
) -> DataFrame:
    """One row per group: its row count and the ``first`` columns of its earliest row."""
    return (
        with_keys(rows, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min_by(F.struct(*first), _order_key(order)).alias("_first"),
        )
        .select(*keys, "n_rows", *[F.col("_first")[c].alias(c) for c in first])
    )


def group_first(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    first: Sequence[str],
    prefix: str = "group_",
    limit: int | None = None,
) -> DataFrame:
    """Each row with the ``first`` columns of the earliest row of its group.

    A window does it in one shuffle. When a group is too large for one task, the
    first rows are found by a map-side aggregate and joined back with salt.
    """
    rows = with_keys(rows, keys)
    hot = hot_keys(rows, keys, limit)
    if not hot:
        window = (
            Window.partitionBy(*keys).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return rows.withColumns({f"{prefix}{c}": F.first(c).over(window) for c in first})
    heads = order_groups(rows, keys, order, first).select(
        *keys, *[F.col(c).alias(f"{prefix}{c}") for c in first]
    )
    return attach(rows, heads, keys, "inner", hot=hot)


def chosen_price(project_type: Column | str, incl: Column | str, excl: Column | str,
                 taxed_type: str = TAXED_PRICE_TYPE) -> Column:
    """Price with tax for one project type, without tax for all others."""
    kind = F.col(project_type) if isinstance(project_type, str) else project_type
    incl = F.col(incl) if isinstance(incl, str) else incl
    excl = F.col(excl) if isinstance(excl, str) else excl
    return F.when(kind == taxed_type, incl).otherwise(excl)


def tax_rate(project_type: Column | str, taxed_type: str = TAXED_PRICE_TYPE) -> Column:
    kind = F.col(project_type) if isinstance(project_type, str) else project_type
    return F.when(kind == taxed_type, F.lit(TAX_OF_TYPE[0])).otherwise(F.lit(TAX_OF_OTHERS[0]))


def tax_code(project_type: Column | str, taxed_type: str = TAXED_PRICE_TYPE) -> Column:
    kind = F.col(project_type) if isinstance(project_type, str) else project_type
    return F.when(kind == taxed_type, F.lit(TAX_OF_TYPE[1])).otherwise(F.lit(TAX_OF_OTHERS[1]))


def order_constants(df: DataFrame, constants: dict[str, object] | None = None) -> DataFrame:
    values = ORDER_CONSTANTS if constants is None else constants
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


# --- lookups ----------------------------------------------------------------

def supplier_code(rows: DataFrame, codes: DataFrame, name: str = "supplier_name") -> DataFrame:
    """Add ``supplier_code``: the code of the trimmed name, or that name if it has none.

    ``codes`` has (supplier_name, supplier_code). A name listed twice takes its
    greater code, so a row never matches twice.
    """
    table = codes.groupBy(strip("supplier_name").alias("_name")).agg(
        F.max("supplier_code").alias("_code")
    )
    return (
        lookup(rows.withColumn("_name", strip(name)), table, ["_name"], "left", counted=codes)
        .withColumn("supplier_code", F.coalesce("_code", "_name"))
        .drop("_name", "_code")
    )


def first_candidate(
    names: DataFrame, candidates: DataFrame, name: str = "supplier_name"
) -> DataFrame:
    """First candidate, by ``ordinal``, whose trimmed label equals the trimmed name.

    ``candidates`` has (ordinal, label, candidate_id). Null when none does.
    """
    table = candidates.groupBy(strip("label").alias("_label")).agg(
        F.min_by("candidate_id", "ordinal").alias("candidate_id"),
        F.min("ordinal").alias("ordinal"),
    )
    named = names.withColumn("_label", strip(name))
    return lookup(named, table, ["_label"], "left", counted=candidates).drop("_label")


def missing_lines(required: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required lines left over when each available line covers one of them.

    The same rows as EXCEPT ALL. Equal lines are added up map-side and written out
    again in chunks: exceptAll would build all copies of a line in one array.
    """
    short = (
        required.select(*keys, F.lit(1).alias("_short"))
        .unionByName(available.select(*keys, F.lit(-1).alias("_short")))
        .groupBy(*keys)
        .agg(F.sum("_short").alias("_short"))
    )
    return repeat_rows(short, "_short")


def _line_text(df: DataFrame, line: str) -> Column:
    whole = isinstance(df.schema[line].dataType, T.IntegralType)
    return F.col(line).cast("string") if whole else whole_number_text(line)


def line_completeness(
    required: DataFrame,
    available: DataFrame,
    required_keys: Sequence[str],
    available_keys: Sequence[str],
    line: str,
) -> DataFrame:
    """Every group (``required_keys``) that requires lines: lines required, on offer and missing.

    What is on offer belongs to ``available_keys``, some of the group's keys: each supplier's
    group of a requisition is checked against all lines of the requisition, whether or not
    they name a supplier. Line numbers are compared as whole-number text.
    """
    side = required.select(
        *required_keys, _line_text(required, line).alias("_line"), F.lit(1).alias("_need"), F.lit(0).alias("_have")
    ).unionByName(
        available.select(
            *available_keys, _line_text(available, line).alias("_line"),
            F.lit(0).alias("_need"), F.lit(1).alias("_have"),
        ),
        allowMissingColumns=True,
    )
    per_line = side.groupBy(*required_keys, "_line").agg(F.sum("_need").alias("_need"), F.sum("_have").alias("_have"))
    return group_totals(offered_lines(per_line, available_keys), required_keys)


def offered_lines(
    per_line: DataFrame, available_keys: Sequence[str], line: str = "_line", hot: Mapping[int, int] | None = None
) -> DataFrame:
    """Rows (keys, line, _need, _have) with what the requisition offers of the line, ``_of_line``, and at all, ``_of_all``.

    The rows are counts already. If a requisition has too many different ones for one task, its
    total is joined to them with salt. ``hot`` are the hot requisitions, if the caller has looked for
    them in the rows that were counted.
    """
    of_line = F.sum("_have").over(Window.partitionBy(*available_keys, line))
    out = per_line.withColumn("_of_line", of_line)
    hot = hot_keys(per_line, available_keys) if hot is None else hot
    if not hot:
        return out.withColumn("_of_all", F.sum("_have").over(Window.partitionBy(*available_keys)))
    totals = per_line.groupBy(*available_keys).agg(F.sum("_have").alias("_of_all"))
    return attach(out, totals, available_keys, "inner", hot=hot)


def _totals() -> dict[str, Column]:
    return {
        "n_required": F.sum("_need"),
        "n_available": F.max("_of_all"),
        "n_missing": F.sum(F.greatest(F.col("_need") - F.col("_of_line"), F.lit(0))),
    }


def group_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group from :func:`offered_lines`."""
    needed = lines.where(F.col("_need") > 0).groupBy(*keys)
    return needed.agg(*[c.alias(n) for n, c in _totals().items()]).withColumn("complete", F.col("n_missing") == 0)


def with_group_totals(lines: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """The lines of :func:`offered_lines` that are needed, each with the totals of its group.

    ``more`` are further aggregates over the group. Lines that lie together by some of the
    keys are not moved.
    """
    group = Window.partitionBy(*keys)
    return lines.where(F.col("_need") > 0).withColumns(
        {n: c.over(group) for n, c in (_totals() | more).items()}
    )


def apply_prices(
    erp_lines: DataFrame,
    sheet: DataFrame,
    order: str,
    material: str,
    src_row: Sequence[str],
    price: str,
    erp_ordinal: str | None = None,
) -> DataFrame:
    """Price of each ERP line from the sheet row of the same order and material.

    Codes are compared as text; of several rows the last one counts. With
    ``erp_ordinal`` (0-based) only as many ERP lines are filled as the sheet has rows
    for the order.
    """
    code = F.col(material).cast("string")
    priced = (
        sheet.withColumn(material, code)
        .groupBy(order, material)
        .agg(F.max_by(price, _order_key(src_row)).alias("price"))
    )
    lines = erp_lines.withColumn(material, code)
    out = attach(lines, priced, [order, material], "left")
    if erp_ordinal is None:
        return out
    sizes = sheet.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    # Hot orders are looked for in the lines, not in the joined rows, which would be joined once more.
    return (
        attach(out, sizes, [order], "left", hot=hot_keys(lines, [order]))
        .withColumn("price", F.when(F.col(erp_ordinal) < F.col("_n"), F.col("price")))
        .drop("_n")
    )


# --- outcomes ---------------------------------------------------------------

def classify_outcome(popup: Column | str, question: Column | str, status: Column | str) -> Column:
    """Struct (order_no, outcome_code, message) of one attempt to create an order.

    A pop-up text on saving means failure and is classified by its phrases; other text
    there is kept. The question that may follow means failure if it speaks of a faulty
    voucher; with any other text the attempt goes on. Then the status line holds the new order number; without
    a number there the attempt failed and the message is empty.
    """
    popup, question, status = (F.col(c) if isinstance(c, str) else c for c in (popup, question, status))
    number = first_number(status)
    code = outcome_rule(popup, [(p, c) for p, c, _ in OUTCOME_RULES], F.lit("OTHER"))
    text = outcome_rule(
        popup, [(p, popup if t is None else F.lit(t)) for p, _, t in OUTCOME_RULES], popup
    )
    voucher = F.coalesce(F.contains(question, F.lit(VOUCHER_ERROR)), F.lit(False))
    return F.struct(
        F.when(popup.isNull() & ~voucher, number).alias("order_no"),
        F.when(popup.isNotNull(), code).when(voucher, F.lit("VOUCHER_ERROR"))
        .when(number.isNotNull(), F.lit("CREATED")).otherwise(F.lit("FAILED")).alias("outcome_code"),
        F.when(popup.isNotNull(), text).when(voucher, F.lit(VOUCHER_ERROR))
        .when(number.isNotNull(), number.cast("string")).otherwise(F.lit("")).alias("message"),
    )


def attempt_outcome(
    n_available: Column, n_missing: Column, supplier_known: Column,
    popup: Column, question: Column, status: Column,
) -> Column:
    """Struct as of :func:`classify_outcome` for a whole attempt, checks in their order.

    No line at all on offer, lines missing, supplier not known; then what the ERP
    system answered.
    """
    early = (
        F.when(n_available == 0, F.lit("没有满足选择标准的数据存在"))
        .when(n_missing > 0, F.lit("行号信息不完整"))
        .when(~supplier_known, F.lit("公司信息不正确"))
    )
    return classify_outcome(F.coalesce(early, popup), question, status)


def write_back(
    sheet: DataFrame,
    outcomes: DataFrame,
    requisition: str = "requisition_no",
    line: str = "requisition_line",
    supplier: str = "supplier_name",
    info: str = "info",
    outcome: str = "outcome",
    match_supplier: bool = False,
) -> DataFrame:
    """Put each group's outcome on its rows; rows of no group keep their old value.

    ``outcomes`` has one row per (requisition, supplier). A row matches by
    requisition and line only: of two suppliers sharing a line number the later name
    wins. ``match_supplier`` matches the row's own supplier instead.
    """
    # Without a hot requisition none of its lines or groups is hot: one look serves all joins.
    hot = None if hot_keys(sheet, [requisition]) else {}
    if match_supplier:
        keys = [requisition, supplier]
        table = outcomes.groupBy(*keys).agg(
            F.max(F.struct(F.lit(True).alias("hit"), outcome)).alias("_new")
        )
        out = attach(sheet, table, keys, "left", hot=hot)
    else:
        keys = [requisition, line]
        lines = with_keys(sheet, [requisition, line, supplier]).select(
            requisition, line, supplier, F.lit(True).alias("hit")
        )
        table = (
            attach(lines, outcomes.select(requisition, supplier, outcome),
                   [requisition, supplier], "inner", hot=hot)
            .groupBy(*keys)
            .agg(F.max_by(F.struct("hit", outcome), F.col(supplier)).alias("_new"))
        )
        out = attach(sheet, table, keys, "left", hot=hot)
    return out.withColumn(
        info, F.when(F.col("_new").isNotNull(), F.col("_new")[outcome]).otherwise(F.col(info))
    ).drop("_new")
