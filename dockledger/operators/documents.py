"""Receiving documents: validate, map the header, number and type the lines, total, reconcile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions.text import (
    NUMBER, date_stamp, exact_number, iso_timestamp, money_text, padded_code, parse_amount,
)
from dockledger.operators.skew import attach, collect_parts, lookup

# Required fields, in the order they are checked.
REQUIRED = ("documentType", "documentNumber", "date", "supplier", "items")
# Units kept as they are, and the unit of all others.
KEPT_UNITS = ("套", "个")
OTHER_UNIT = "PCS"
# Currency, expiry date, prefixes of codes and ids, suffix of receipt numbers.
CURRENCY = "CNY"
EXPIRY_DATE = "2026-12-31"
MATERIAL, BATCH, SHELF, SHELF_END = "MAT", "BATCH", "A-", "-01"
EXECUTION, RECEIPT, RECEIPT_SUFFIX = "EXEC_", "GR", "00156"
# Who carries out a run, what its report remarks, and the fields of a line in a
# structured document.
REPORT_OPERATOR = "RPA_AUTO_SYSTEM"
REPORT_REMARKS = "自动化流程执行成功"
LINE_FIELDS = (
    "lineNumber", "materialCode", "materialName", "specification", "quantity", "unit", "unitPrice",
    "totalPrice", "batchNumber", "productionDate", "expiryDate", "storageLocation",
)


# --- validation ------------------------------------------------------------

def required_fields(df: DataFrame, fields: Sequence[str] = REQUIRED) -> DataFrame:
    """Add ``missing`` (absent fields in order) and ``reject_reason`` (the first of them).

    A field is missing when it is null; an empty list of items is present.
    """
    gaps = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    return df.withColumn("missing", F.array_compact(gaps)).withColumn(
        "reject_reason", F.get("missing", F.lit(0))
    )


def required_keys(df: DataFrame, text: str, fields: Sequence[str] = REQUIRED) -> DataFrame:
    """As :func:`required_fields` on JSON text, where a field written as null is present."""
    document = F.from_json(text, "map<string,string>")
    gaps = F.array(
        *[
            F.when(~F.coalesce(F.map_contains_key(document, F.lit(f)), F.lit(False)), F.lit(f))
            for f in fields
        ]
    )
    return df.withColumn("missing", F.array_compact(gaps)).withColumn(
        "reject_reason", F.get("missing", F.lit(0))
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("missing", "reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def require(df: DataFrame) -> DataFrame:
    """Stop the job at the first document with a missing field."""
    message = F.concat(F.lit("missing required field: "), F.col("reject_reason"))
    reason = F.when(F.col("reject_reason").isNotNull(), F.raise_error(message).cast("string"))
    # The check is part of a kept column, so that column pruning cannot drop it.
    checked = F.coalesce(reason, F.col("documentNumber"))
    return df.withColumn("documentNumber", checked).drop("missing", "reject_reason")


def date_is_valid(text: Column | str) -> Column:
    """ISO calendar date of exactly yyyy-MM-dd."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & parsed.isNotNull(), F.lit(False))


def in_range(value: Column, low, high) -> Column:
    """Both ends included; a missing value is out of range."""
    return F.coalesce(value.between(low, high), F.lit(False))


def broken_rules(df: DataFrame, rules: Sequence[tuple[str, str | Column]]) -> DataFrame:
    """Add ``broken``: names of the rules (SQL text or boolean columns) a row does not meet."""
    names = []
    for name, rule in rules:
        passed = F.expr(rule) if isinstance(rule, str) else rule
        names.append(F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)))
    return df.withColumn("broken", F.array_compact(F.array(*names)))


# --- header ----------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    """Target column of a header mapping: a source with a default, or a constant."""

    target: str
    source: str | None = None
    default: str | None = None
    constant: str | None = None


# The two header forms.
MINIMAL_HEADER = (
    Field("documentType", constant="RECEIPT"),
    Field("documentNumber", "documentNumber"),
    Field("transactionDate", "date"),
    Field("supplierName", "supplier"),
)
FULL_HEADER = (
    Field("documentType", constant="GOODS_RECEIPT"),
    Field("documentNumber", "documentNumber"),
    Field("transactionDate", "date"),
    Field("supplierCode", "supplierCode", default="UNKNOWN"),
    Field("supplierName", "supplier"),
    Field("warehouseCode", "warehouseCode", default="WH001"),
    Field("warehouseName", "warehouse", default="主仓库"),
    Field("operationType", constant="RECEIVE"),
    Field("operator", "operator", default="System"),
    Field("remarks", "remarks", default=""),
)


def map_header(
    df: DataFrame,
    mapping: Sequence[Field],
    as_of: Column,
    stamped: str = "createdAt",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Header columns of each document; ``as_of`` is the time stamped on it."""
    columns = []
    for field in mapping:
        if field.source is None:
            column = F.lit(field.constant)
        elif field.default is None:
            column = F.col(field.source)
        else:
            column = F.coalesce(F.col(field.source), F.lit(field.default))
        columns.append(column.alias(field.target))
    return df.select(*keep, *columns, iso_timestamp(as_of).alias(stamped))


# --- lines -----------------------------------------------------------------

def explode_items(
    df: DataFrame,
    keys: Sequence[str] = ("documentNumber",),
    items: str = "items",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per item, numbered from 1 in list order.

    A document without items gives no row, or with ``keep_empty`` one without
    ``lineNumber``: then document columns in ``keys`` and line totals come from one
    pass, with no join back to the documents.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*keys, explode(items).alias("_pos", "_item")).select(
        *keys, (F.col("_pos") + 1).alias("lineNumber"), "_item.*"
    )


def type_items(lines: DataFrame, price: str = "price") -> DataFrame:
    """Quantity and price as decimals of up to 12 digits before the point and 6 behind; a missing price is 0.

    ``item_error`` names the first field whose text is not such a number. One with more digits
    than that is an error too, never rounded.
    """
    quantity = exact_number(F.col("quantity").cast("string"))
    amount = exact_number(F.coalesce(F.col(price).cast("string"), F.lit("0")))
    return lines.withColumns(
        {
            "item_error": F.when(quantity.isNull(), "quantity").when(amount.isNull(), price),
            "quantity": quantity,
            "unitPrice": amount,
        }
    )


def line_amount(mode: str = "recompute", stated: str = "totalPrice") -> Column:
    """Quantity times unit price, or the amount the document states for the line."""
    if mode == "recompute":
        return F.col("quantity") * F.col("unitPrice")
    if mode == "stated":
        return exact_number(F.col(stated).cast("string"))
    raise ValueError("mode is 'recompute' or 'stated'")


def normalise_unit(unit: Column | str) -> Column:
    unit = F.col(unit) if isinstance(unit, str) else unit
    return F.when(unit.isin(*KEPT_UNITS), F.upper(unit)).otherwise(F.lit(OTHER_UNIT))


def normalise_unit_by(lines: DataFrame, units: DataFrame) -> DataFrame:
    """Units from a table (unit, standard_unit), the fixed rule for units not in it."""
    found = lookup(lines, units, ["unit"], "left")
    return found.withColumn(
        "unit", F.coalesce("standard_unit", normalise_unit("unit"))
    ).drop("standard_unit")


def place_lines(lines: DataFrame, as_of: Column, number: str = "lineNumber") -> DataFrame:
    """Codes derived from the line number and the day: material, batch, dates, location."""
    return lines.withColumns(
        {
            "materialCode": padded_code(MATERIAL, number),
            "batchNumber": date_stamp(BATCH, as_of),
            "productionDate": F.date_format(as_of, "yyyy-MM-dd"),
            "expiryDate": F.lit(EXPIRY_DATE),
            "storageLocation": padded_code(SHELF, number, 2, SHELF_END),
        }
    )


def standard_lines(
    lines: DataFrame, as_of: Column, mode: str = "recompute", stated: str = "totalPrice"
) -> DataFrame:
    """Typed lines with all fields of LINE_FIELDS; other columns are kept.

    ``materialName`` is the line's name; a missing specification is empty.
    """
    specification = F.col("specification") if "specification" in lines.columns else F.lit(None)
    placed = place_lines(lines, as_of)
    return placed.withColumns(
        {
            "materialName": F.col("name"),
            "specification": F.coalesce(specification.cast("string"), F.lit("")),
            "unit": normalise_unit("unit"),
            "totalPrice": line_amount(mode, stated),
        }
    )


# --- totals ----------------------------------------------------------------

def summarise(
    documents: DataFrame,
    lines: DataFrame,
    keys: Sequence[str] = ("documentNumber",),
    quantity: Column | None = None,
    amount: Column | None = None,
) -> DataFrame:
    """Line count, quantity and amount of every document, 0 for one without lines.

    Lines are added up before the join, so the join has one row per document on
    either side and a large document costs no more than a small one. The total that
    a document itself states, ``totalAmount``, becomes ``statedAmount``.
    """
    quantity = F.col("quantity") if quantity is None else quantity
    amount = F.col("totalPrice") if amount is None else amount
    totals = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("totalItems"),
        F.sum(quantity).alias("totalQuantity"),
        F.sum(amount).alias("totalAmount"),
    )
    stated = documents.withColumnRenamed("totalAmount", "statedAmount")
    return stated.join(totals, list(keys), "left").withColumns(
        {
            "totalItems": F.coalesce("totalItems", F.lit(0)),
            "totalQuantity": F.coalesce("totalQuantity", F.lit(0)),
            "totalAmount": F.coalesce("totalAmount", F.lit(0)),
            "currency": F.lit(CURRENCY),
        }
    )


def reconcile(
    summaries: DataFrame, stated: str = "statedAmount", tolerance: str = "0.005", within: str = "10"
) -> DataFrame:
    """Compare the sum of the lines with the stated total.

    ``reconciles``: they differ by at most ``tolerance``, by default half a cent;
    ``amount_ok``: by less than ``within``. Both null when nothing is stated. A stated total
    may be text with thousands separators; ``amount_error`` is true where it is no number.
    """
    given = F.col(stated).cast("string")
    number = parse_amount(given)
    diff = F.col("totalAmount") - number
    return summaries.withColumns(
        {
            "amount_error": given.isNotNull() & number.isNull(),
            "amount_diff": diff,
            "reconciles": F.abs(diff) <= F.lit(tolerance).cast(NUMBER),
            "amount_ok": F.abs(diff) < F.lit(within).cast(NUMBER),
        }
    )


def execution_report(
    summaries: DataFrame,
    as_of: Column,
    key: str = "documentNumber",
    receipt_suffix: Column | None = None,
    operator: str = REPORT_OPERATOR,
    remarks: str = REPORT_REMARKS,
) -> DataFrame:
    """One report row per document. The id comes from the document, not from the clock."""
    document = F.col(key).cast("string")
    suffix = F.lit(RECEIPT_SUFFIX) if receipt_suffix is None else receipt_suffix
    return summaries.select(
        F.concat(F.lit(EXECUTION), document).alias("executionId"),
        iso_timestamp(as_of).alias("executionTime"),
        document.alias("sourceDocument"),
        F.concat(date_stamp(RECEIPT, as_of), suffix).alias("receiptNumber"),
        F.col("totalItems").alias("itemsProcessed"),
        "totalAmount",
        money_text("totalAmount").alias("amountText"),
        "currency",
        F.lit("SUCCESS").alias("status"),
        F.lit(operator).alias("operator"),
        F.lit(remarks).alias("remarks"),
    )


def run_report(runs: DataFrame, as_of: Column, run: str = "run_id") -> DataFrame:
    """The smaller report: id, time, script and status of each run."""
    return runs.select(
        F.concat(F.lit(EXECUTION), F.col(run).cast("string")).alias("executionId"),
        iso_timestamp(as_of).alias("timestamp"),
        "scriptPath", "scriptType", F.lit("SUCCESS").alias("status"),
    )


def nested_documents(
    headers: DataFrame,
    lines: DataFrame,
    summaries: DataFrame,
    line_fields: Sequence[str] = LINE_FIELDS,
    key: str = "documentNumber",
    max_items: int | None = None,
) -> DataFrame:
    """{header, items, summary} documents, for a sink that takes them nested.

    One row per document, with empty items if it has no lines. Flat headers, lines and
    summaries are what other steps should read. With ``max_items`` a document is written in
    rows of at most so many lines with the same header and summary, numbered by ``part``.
    """
    header = F.struct(*headers.columns).alias("header")
    totals = F.struct(*[c for c in summaries.columns if c != key]).alias("summary")
    heads = headers.select(key, header).join(summaries.select(key, totals), key)
    parts = collect_parts(lines, [key], "lineNumber", line_fields, max_items=max_items)
    items = F.coalesce(F.col("items"), F.array()).alias("items")
    if max_items is None:
        return heads.join(parts, key, "left").select(key, "header", items, "summary")
    # Parts of one document may be many: they are the side that is salted.
    filled = attach(parts, heads, [key], "inner").select(key, "part", "header", "items", "summary")
    bare = heads.join(parts.select(key).distinct(), key, "left_anti")
    return filled.unionByName(bare.withColumn("part", F.lit(0).cast("long")), allowMissingColumns=True).select(
        key, "part", "header", items, "summary"
    )


# --- checks against other tables -------------------------------------------

def unknown_values(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``known`` (materials, units, ...)."""
    return lookup(rows, known, keys, "left_anti")


def qualified(rows: DataFrame, suppliers: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Rows whose supplier is on the list with a valid qualification."""
    return lookup(rows, suppliers.where(valid), keys, "left_semi")


def unqualified(rows: DataFrame, suppliers: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Rows whose supplier is absent from the list or without a valid qualification."""
    return lookup(rows, suppliers.where(valid), keys, "left_anti")


def over_capacity(
    lines: DataFrame,
    capacity: DataFrame,
    keys: Sequence[str],
    quantity: Column,
) -> DataFrame:
    """Stock per place against what it holds: one row per place over its capacity."""
    stock = lines.groupBy(*keys).agg(F.sum(quantity).alias("stock"))
    return stock.join(capacity, list(keys)).where(F.col("stock") > F.col("capacity")).withColumn(
        "excess", F.col("stock") - F.col("capacity")
    )
