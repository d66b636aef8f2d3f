"""Readers and writers."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger import schemas
from dockledger.operators import documents as docs
from dockledger.operators import hooks
from dockledger.operators.skew import positions
from dockledger.session import scratch_path
from dockledger.plans.workbook_files import to_workbooks
from dockledger.sources import sinks, tables
from dockledger.sources.workbooks import read_workbooks, sheet_columns, workbook_rows


def test_tables_by_suffix(spark):
    df = spark.createDataFrame([("1", 2.5), ("2", None)], "requisition_no string, price double")
    base = scratch_path(spark, "tables")
    df.write.parquet(f"{base}/a.PARQUET")
    df.write.option("header", True).csv(f"{base}/a.csv")
    sinks.write_json(df, f"{base}/a.json")
    for name in ("a.PARQUET", "a.csv", "a.json"):
        got = tables.read_table(spark, f"{base}/{name}", df.schema)
        assert sorted(got.collect()) == sorted(df.collect())


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('supplier_name,price,requisition_no\nACME,1.5,7\n"two\nlines",x,8\n')
    schema = T.StructType.fromDDL("requisition_no string, supplier_name string, price double")
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), schema, bad="bad", multi_line=True).collect()
    assert [tuple(r) for r in got] == [("7", "ACME", 1.5, []), ("8", "two\nlines", None, ["price"])]
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), T.StructType([*schema.fields, T.StructField("missing", T.StringType())]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), schema, multi_line=True).select("price").collect()


def test_sheet_keeps_its_row_order(spark):
    """A file read in many blocks, by tasks in any order."""
    path = scratch_path(spark, "sheet") + ".csv"
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("requisition_line"), F.lit("x" * 50).alias("info"))
    rows.coalesce(1).write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = tables.read_sheet(spark, path, rows.schema)
        assert got.rdd.getNumPartitions() > 4
        order = [int(r.requisition_line) for r in got.orderBy(*tables.SHEET_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order == list(range(3000))


def test_unsupported_and_missing_tables(spark):
    with pytest.raises(tables.UnsupportedFormat, match="doc"):
        tables.read_table(spark, "x/y.doc")
    with pytest.raises(ValueError, match="schema"):
        tables.read_table(spark, "x/y.csv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, "/tmp/no-such-place/y.parquet")


def test_documents_with_corrupt_text(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    good = json.dumps({"documentNumber": "SH1", "items": [{"name": "n", "quantity": 5}]}, ensure_ascii=False)
    (tmp_path / "docs" / "a.json").write_text(good + "\n{broken\n", encoding="utf-8")
    got = tables.read_documents(spark, str(tmp_path / "docs")).cache()
    assert got.where("_corrupt is null").first()["items"][0].quantity == "5"
    assert got.where("_corrupt is not null").first()._corrupt == "{broken"
    pretty = tmp_path / "pretty"
    pretty.mkdir()
    (pretty / "b.json").write_text(json.dumps(json.loads(good), indent=2), encoding="utf-8")
    assert tables.read_documents(spark, str(pretty), multi_line=True).first().documentNumber == "SH1"


def test_image_list(spark, tmp_path):
    for name in ("receipt_001.jpg", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    got = tables.list_files(spark, str(tmp_path)).collect()
    assert {os.path.basename(r.path) for r in got} == {"receipt_001.jpg", "b.png"}
    assert {r.size for r in got} == {5}


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame(
        [("1000314270.0", "示例（一）", 12.5), ("2", " <&> ", None), ("3", None, 0.1)],
        "requisition_no string, supplier_name string, price_incl_tax double").coalesce(1)
    for n, row in enumerate(to_workbooks(df).collect()):
        (tmp_path / f"{n}.xlsx").write_bytes(row.content)
    (tmp_path / "notes.txt").write_text("not a workbook")
    schema = T.StructType(
        [f for f in schemas.REQUISITION_SHEET if f.name in df.columns or f.name == "info"])
    got = read_workbooks(spark, str(tmp_path), schema).orderBy("src_row").collect()
    assert [(r.src_row, r.requisition_no, r.supplier_name) for r in got] == [
        (1, "1000314270.0", "示例（一）"), (2, "2", " <&> "), (3, "3", None)]
    assert [None if r.price_incl_tax is None else float(r.price_incl_tax) for r in got] == [12.5, None, 0.1]
    assert got[0].info is None
    sheet = tables.read_sheet(spark, f"{tmp_path}/*.xlsx", schema)
    assert [r.requisition_no for r in sheet.orderBy(*tables.SHEET_ORDER).collect()] == [
        "1000314270.0", "2", "3"]


def test_workbook_with_shared_strings(spark):
    """The layout spreadsheet programs write: shared strings, numbers, gaps."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                      '<sheet name="One" sheetId="1" r:id="rId7"/><sheet name="Two" sheetId="2" r:id="rId8"/>'
                      '</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="rId8" Type="t" Target="worksheets/sheet9.xml"/>'
                      '<Relationship Id="rId7" Type="t" Target="/xl/worksheets/first.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>no</t></si>'
                      '<si><r><t>in</t></r><r><t>fo</t></r></si><si><t>x</t></si></sst>')
        book.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{main}"><sheetData>'
                      '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                      '<row r="2"><c r="A2"><v>7</v></c><c r="B2"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row>'
                      '<row r="3"><c r="C3" t="s"><v>2</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")
    schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("info", T.StringType())])
    got = sheet_columns(workbook_rows(files), schema).orderBy("src_row").collect()
    assert [(r.no, r.info) for r in got] == [(7, "x"), (None, "x")]
    assert workbook_rows(files).first().sheet == "One"


def test_versions_of_a_table(spark):
    path = scratch_path(spark, "versions")
    sinks.write_version(spark.range(3), path, 0)
    sinks.write_version(sinks.read_version(spark, path, 0).withColumn("id", F.col("id") + 1), path, 1)
    assert sorted(r.id for r in sinks.read_version(spark, path, 1).collect()) == [1, 2, 3]
    assert sinks.read_version(spark, path, 1).columns == ["id"]


def test_bucketed_tables_meet_without_a_shuffle(spark):
    documents = spark.range(100).select(F.col("id").alias("documentNumber"))
    lines = spark.range(1000).select(
        (F.col("id") % 90).alias("documentNumber"), F.col("id").alias("line"),
        F.lit(2).alias("quantity"), F.lit(3).alias("totalPrice"))
    path = scratch_path(spark, "bucketed")
    saved = [
        sinks.write_bucketed(df, name, ["documentNumber"], 4, f"{path}/{name}")
        for df, name in ((documents, "bucketed_documents"), (lines, "bucketed_lines"))
    ]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summary = docs.summarise(*saved)
        numbered = positions(saved[1], ["documentNumber"], ["line"])
        assert "Exchange" in docs.summarise(documents, lines)._jdf.queryExecution().executedPlan().toString()
        for df in (summary, numbered):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert summary.agg(F.sum("totalItems"), F.count("*")).first()[:] == (1000, 100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop table bucketed_documents")
        spark.sql("drop table bucketed_lines")


def test_caller_hooks(spark):
    df = spark.range(4)
    assert hooks.clean_documents(df, lambda d: d.where("id > 1")).count() == 2

    def plus(batches):
        for batch in batches:
            yield batch + 1

    assert hooks.clean_documents(df, plus, "id long").agg(F.sum("id")).first()[0] == 10
    broken = hooks.custom_rules(df, [("small", "id < 2"), ("even", F.col("id") % 2 == 0)])
    assert [r.broken for r in broken.orderBy("id").collect()] == [[], ["even"], ["small"], ["small", "even"]]
