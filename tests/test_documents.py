"""Receiving documents: golden values and rejected input."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dockledger import schemas
from dockledger.functions import text
from dockledger.operators import documents as docs
from dockledger.sources import sinks, tables

FORM_1 = {
    "documentType": "note", "documentNumber": "SH1", "date": "2024-10-31",
    "supplier": "Example Garden Supply",
    "items": [
        {"name": "screwdrivers", "quantity": 7, "unit": "套", "price": 31.25},
        {"name": "gloves", "quantity": 40, "unit": "个", "price": 2.5},
        {"name": "pump", "quantity": 6, "unit": "个", "price": 410.0},
        {"name": "ladder", "quantity": 2, "unit": "台", "price": 99.9},
    ],
}
FORM_1_TOTAL = {**FORM_1, "documentNumber": "SH2", "items": FORM_1["items"][:3], "totalAmount": "2,700.00"}
FORM_2 = {
    **FORM_1, "documentNumber": "SH3", "supplierCode": "SP7", "warehouse": "shed",
    "warehouseCode": "W9", "operator": "someone", "remarks": "soon", "totalAmount": 2778.75,
    "items": [
        {"name": i["name"], "specification": "s", "quantity": i["quantity"], "unit": i["unit"],
         "unitPrice": i["price"], "totalPrice": i["quantity"] * i["price"]}
        for i in FORM_1["items"][:3]
    ],
}
EMPTY = {**FORM_1, "documentNumber": "SH4", "items": []}


@pytest.fixture(scope="module")
def raw(spark):
    texts = [(json.dumps(d, ensure_ascii=False),) for d in (FORM_1, FORM_1_TOTAL, FORM_2, EMPTY)]
    return tables.parse_documents(spark.createDataFrame(texts, "doc string"), "doc")


def _lines(raw, price, mode):
    lines = docs.type_items(docs.explode_items(raw), price)
    return lines.withColumn("totalPrice", docs.line_amount(mode))


@pytest.mark.parametrize(
    "document, lines, quantity, amount, reconciles",
    [("SH1", 4, 55, "2978.55", None), ("SH2", 3, 53, "2778.75", False), ("SH4", 0, 0, "0", None)],
)
def test_totals_of_form_1(raw, document, lines, quantity, amount, reconciles):
    summary = docs.reconcile(docs.summarise(raw, _lines(raw, "price", "recompute")))
    row = summary.where(F.col("documentNumber") == document).first()
    assert (row.totalItems, row.totalQuantity) == (lines, quantity)
    assert row.totalAmount == Decimal(amount)
    assert row.reconciles == reconciles
    if document == "SH2":
        assert row.amount_diff == Decimal("78.75") and row.amount_error is False


def test_form_2_lines_header_and_report(spark, raw):
    as_of = F.lit("2024-10-21 14:30:00").cast("timestamp")
    form_2 = raw.where("documentNumber = 'SH3'")
    lines = docs.place_lines(_lines(form_2, "unitPrice", "stated"), as_of)
    lines = lines.withColumn("unit", docs.normalise_unit("unit"))
    got = lines.orderBy("lineNumber").collect()
    assert [r.materialCode for r in got] == ["MAT0001", "MAT0002", "MAT0003"]
    assert [r.storageLocation for r in got] == ["A-01-01", "A-02-01", "A-03-01"]
    assert [r.unit for r in got] == ["套", "个", "个"]
    assert got[0].batchNumber == "BATCH20241021" and got[0].expiryDate == "2026-12-31"
    summary = docs.reconcile(docs.summarise(form_2, lines))
    assert summary.first().reconciles is True
    header = docs.map_header(form_2, docs.FULL_HEADER, as_of).first()
    assert (header.documentType, header.operationType, header.supplierCode) == (
        "GOODS_RECEIPT", "RECEIVE", "SP7")
    report = docs.execution_report(summary, as_of).first()
    assert report.receiptNumber == "GR2024102100156"
    assert report.amountText == "¥2,778.75"
    assert (report.operator, report.remarks) == ("RPA_AUTO_SYSTEM", "自动化流程执行成功")
    assert report.executionTime == "2024-10-21T14:30:00"


def test_one_bad_total_does_not_stop_the_others(spark):
    df = spark.createDataFrame(
        [(1, "1,050.00"), (2, "about 7"), (3, None), (4, "1050.5")], "documentNumber int, statedAmount string"
    ).withColumn("totalAmount", F.lit("1050.00").cast("decimal(18,2)"))
    got = docs.reconcile(df).orderBy("documentNumber").collect()
    assert [(r.amount_error, r.reconciles) for r in got] == [(False, True), (True, None), (False, None), (False, False)]


def test_fields_of_lines(spark, raw):
    as_of = F.lit("2024-10-21").cast("timestamp")
    lines = docs.standard_lines(docs.type_items(docs.explode_items(raw)), as_of)
    row = lines.where("documentNumber = 'SH1' and lineNumber = 4").first()
    assert (row.materialName, row.specification, row.unit, row.totalPrice) == ("ladder", "", "PCS", Decimal("199.8"))
    assert set(docs.LINE_FIELDS) <= set(lines.columns)


def test_header_defaults(raw):
    as_of = F.lit("2024-10-21").cast("timestamp")
    row = docs.map_header(raw.where("documentNumber = 'SH1'"), docs.FULL_HEADER, as_of).first()
    assert (row.supplierCode, row.warehouseCode, row.warehouseName, row.operator, row.remarks) == (
        "UNKNOWN", "WH001", "主仓库", "System", "")
    row = docs.map_header(raw, docs.MINIMAL_HEADER, as_of, "processedAt").first()
    assert row.documentType == "RECEIPT" and row.processedAt == "2024-10-21T00:00:00"


def test_first_missing_field_is_the_reason(spark):
    gone = [dict(FORM_1), dict(FORM_1), dict(EMPTY)]
    del gone[0]["date"], gone[0]["items"]
    del gone[1]["documentType"]
    texts = spark.createDataFrame([(json.dumps(d),) for d in gone], "doc string")
    checked = docs.required_fields(tables.parse_documents(texts, "doc"))
    reasons = {r.documentNumber: r.reject_reason for r in checked.collect()}
    assert sorted(str(r.reject_reason) for r in checked.collect()) == ["None", "date", "documentType"]
    assert reasons["SH4"] is None  # an empty list of items is present
    assert docs.accepted(checked).count() + docs.rejected(checked).count() == checked.count()
    assert docs.accepted(checked).count() == 1


def test_fail_fast(spark, raw):
    assert docs.require(docs.required_fields(raw)).count() == 4
    bad = raw.withColumn("supplier", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="missing required field: supplier"):
        docs.require(docs.required_fields(bad)).select("documentNumber").collect()


def test_presence_is_not_value(spark):
    df = spark.createDataFrame([('{"a": null, "b": 1}',), ('{"b": 1}',), ("no json",)], "doc string")
    got = [r.reject_reason for r in docs.required_keys(df, "doc", ["a", "b"]).collect()]
    assert got == [None, "a", "a"]


def test_bad_numbers_are_named(spark):
    df = spark.createDataFrame(
        [("5", "1.5"), ("five", "2"), ("1", "two"), ("2", None)], "quantity string, price string"
    )
    got = docs.type_items(df).collect()
    assert [r.item_error for r in got] == [None, "quantity", "price", None]
    assert got[3].unitPrice == 0


def test_fine_quantities_are_not_rounded(spark):
    df = spark.createDataFrame([("0.125", "0.0333")], "quantity string, price string")
    assert docs.type_items(df).select(docs.line_amount()).first()[0] == Decimal("0.0041625")


def test_units_from_a_table(spark):
    df = spark.createDataFrame([("套",), ("个",), ("kg",), (None,)], "unit string")
    units = spark.createDataFrame([("套", "SET"), ("kg", "KGM")], "unit string, standard_unit string")
    assert sorted(r.unit for r in docs.normalise_unit_by(df, units).collect()) == [
        "KGM", "PCS", "SET", "个"]


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-02-29",), ("2023-02-29",), ("2024-2-9",), ("29/02/2024",), (None,)], "d string"
    )
    assert [r[0] for r in df.select(docs.date_is_valid("d")).collect()] == [
        True, False, False, False, False]


def test_scan_batch(spark):
    batch = {"folderPath": "/scan", "imagesProcessed": 3,
             "documents": [{**FORM_1_TOTAL, "imageName": "receipt_001.jpg"}]}
    empty = {"folderPath": "/none", "imagesProcessed": 0, "documents": []}
    texts = spark.createDataFrame([(json.dumps(b),) for b in (batch, empty)], "b string")
    found = tables.scanned_documents(tables.parse_documents(texts, "b", schemas.SCAN_BATCH))
    got = {r.folderPath: r for r in found.collect()}
    assert got["/scan"].documentNumber == "SH2" and got["/scan"].imagesProcessed == 3
    assert len(got["/scan"]["items"]) == 3
    assert got["/none"].documentNumber is None


def test_nested_documents_in_parts(spark, raw):
    as_of = F.lit("2024-10-21").cast("timestamp")
    headers = docs.map_header(raw, docs.MINIMAL_HEADER, as_of)
    lines = docs.place_lines(_lines(raw, "price", "recompute"), as_of)
    summaries = docs.summarise(raw.select("documentNumber"), lines)
    nested = docs.nested_documents(headers, lines, summaries, ["materialCode"], max_items=3)
    got = {(r.documentNumber, r.part): [i.materialCode for i in r["items"]] for r in nested.collect()}
    assert got[("SH1", 0)] == ["MAT0001", "MAT0002", "MAT0003"] and got[("SH1", 1)] == ["MAT0004"]
    assert got[("SH4", 0)] == []
    whole = docs.nested_documents(headers, lines, summaries, ["materialCode"])
    assert whole.count() == 4 and "part" not in whole.columns
    assert {r.documentNumber: len(r["items"]) for r in whole.collect()}["SH1"] == 4
    text = nested.where("documentNumber = 'SH4'").select(
        sinks.json_text(F.struct("header", "items", "summary")).alias("j")).first().j
    assert json.loads(text)["summary"]["totalItems"] == 0


def test_capacity(spark):
    lines = spark.createDataFrame([("a", 3), ("a", 4), ("b", 9)], "place string, q int")
    room = spark.createDataFrame([("a", 6), ("b", 9)], "place string, capacity int")
    assert [(r.place, r.excess) for r in docs.over_capacity(lines, room, ["place"], F.col("q")).collect()] == [("a", 1)]


def test_numbers_lose_no_digits(spark):
    cases = {
        "1.5": "1.500000", " 12 ": "12.000000", "0.123456": "0.123456", "0.1234567": None, "0.12345600": "0.123456",
        "999999999999.999999": "999999999999.999999", "1234567890123": None, "1E-7": None, "1e-6": "0.000001",
        "2E3": "2000.000000", "x": None, "": None, ".5": "0.500000", "-0.0000001": None, "+3": "3.000000",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.exact_number("t").cast("string").alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases
