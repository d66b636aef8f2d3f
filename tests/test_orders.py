"""Requisition sheet to orders, checked against plain Python on small sheets."""

import random

import pytest
from pyspark.sql import functions as F

from dockledger import schemas
from dockledger.operators import changes, orders
from dockledger.plans import REGISTRY


@pytest.fixture(scope="module")
def sheet(spark):
    """A small sheet with repeated lines, shared line numbers and missing keys."""
    random.seed(3)
    rows = []
    for i in range(200):
        requisition = None if i % 17 == 0 else str(random.randrange(12))
        supplier = None if i % 23 == 0 else f"s{random.randrange(4)}"
        rows.append((i, requisition, str(random.randrange(5)), supplier, f"p{i}", f"t{i % 3}", f"m{i % 7}",
                     float(i), f"old{i}"))
    return spark.createDataFrame(
        rows, "src_row long, requisition_no string, requisition_line string, supplier_name string, "
        "project_name string, project_type string, material_code string, price double, info string"
    ).repartition(3)


def _groups(sheet):
    groups = {}
    for row in sorted(sheet.collect(), key=lambda r: r.src_row):
        if row.requisition_no is not None and row.supplier_name is not None:
            groups.setdefault((row.requisition_no, row.supplier_name), []).append(row)
    return dict(sorted(groups.items()))


def test_groups_and_first_rows(sheet):
    keys = ["requisition_no", "supplier_name"]
    got = orders.order_groups(sheet, keys, ["src_row"], ["project_name", "project_type"])
    want = {k: (len(v), v[0].project_name, v[0].project_type) for k, v in _groups(sheet).items()}
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in got.collect()} == want
    seen = orders.group_first(sheet, keys, ["src_row"], ["project_name"])
    assert {(r.requisition_no, r.supplier_name, r.group_project_name) for r in seen.collect()} == {
        (*k, v[1]) for k, v in want.items()}
    assert seen.count() == sum(v[0] for v in want.values())


def test_unknown_group_column_is_an_error(sheet):
    with pytest.raises(Exception, match="nope"):
        orders.group_counts(sheet, ["nope"])


@pytest.mark.parametrize("strict", [False, True])
def test_write_back_is_last_writer_wins(spark, sheet, strict):
    groups = _groups(sheet)
    outcomes = {k: (None if n % 5 == 0 else f"o{n}") for n, k in enumerate(groups) if n % 4}
    all_rows = sheet.collect()
    info = {r.src_row: r.info for r in all_rows}
    for (requisition, supplier), rows in groups.items():
        if (requisition, supplier) not in outcomes:
            continue
        lines = {r.requisition_line for r in rows}
        for row in all_rows:
            same = row.requisition_no == requisition and row.requisition_line in lines
            if same and (not strict or row.supplier_name == supplier):
                info[row.src_row] = outcomes[(requisition, supplier)]
    table = spark.createDataFrame(
        [(*k, v) for k, v in outcomes.items()], "requisition_no string, supplier_name string, outcome string")
    got = orders.write_back(sheet, table, match_supplier=strict)
    assert {r.src_row: r.info for r in got.collect()} == info


def test_prices(spark, sheet):
    erp = [("r", n, f"m{n % 4}") for n in range(6)]
    rows = [("r", 0, "m1", 1.0), ("r", 1, "m1", 2.0), ("r", 2, "m3", 3.0), ("q", 3, "m0", 9.0)]
    lines = spark.createDataFrame(erp, "order string, ordinal int, code string")
    prices = spark.createDataFrame(rows, "order string, src_row int, code string, price double")
    args = (lines, prices.withColumnRenamed("price", "p"), "order", "code", ["src_row"], "p")
    got = {r.ordinal: r.price for r in orders.apply_prices(*args).collect()}
    assert got == {0: None, 1: 2.0, 2: None, 3: 3.0, 4: None, 5: 2.0}
    got = {r.ordinal: r.price for r in orders.apply_prices(*args, "ordinal").collect()}
    assert got == {0: None, 1: 2.0, 2: None, 3: None, 4: None, 5: None}


def test_completeness_counts_copies(spark):
    need = spark.createDataFrame(
        [("a", "1.0"), ("a", "1.0"), ("a", "2.0"), ("b", "1.0"), ("c", "5.0")], "order string, line string")
    have = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("b", "1"), ("d", "1")], "order string, line string")
    got = orders.line_completeness(need, have, ["order"], ["order"], "line").orderBy("order").collect()
    assert [tuple(r) for r in got] == [
        ("a", 3, 3, 1, False), ("b", 1, 2, 0, True), ("c", 1, 0, 1, False)]
    left = orders.missing_lines(need, need.limit(0), ["order", "line"])
    assert left.count() == 5


def test_lines_offered_without_a_supplier_count_for_every_group(spark):
    need = spark.createDataFrame(
        [("r1", "s1", "1"), ("r1", "s1", "2"), ("r1", "s2", "2"), ("r1", "s2", "2"), ("r2", "s1", "1")],
        "requisition string, supplier string, line string")
    have = spark.createDataFrame([("r1", "1"), ("r1", "2"), ("r3", "9")], "requisition string, line string")
    got = orders.line_completeness(need, have, ["requisition", "supplier"], ["requisition"], "line")
    assert {(r.requisition, r.supplier): (r.n_required, r.n_available, r.n_missing, r.complete) for r in got.collect()} == {
        ("r1", "s1"): (2, 2, 0, True), ("r1", "s2"): (2, 2, 1, False), ("r2", "s1"): (1, 0, 1, False)}


def test_supplier_codes(spark):
    codes = spark.createDataFrame(
        [("示例（一）公司", "1"), ("示例(一)公司 ", "1"), ("b", "2"), ("b　", "3")],
        "supplier_name string, supplier_code string")
    names = spark.createDataFrame(
        [("　示例（一）公司",), ("b",), (" other ",), (None,)], "supplier_name string")
    got = orders.supplier_code(names, codes).collect()
    assert [r.supplier_code for r in got] == ["1", "3", "other", None]


def test_first_candidate(spark):
    names = spark.createDataFrame([("a ",), ("x",)], "supplier_name string")
    list_ = spark.createDataFrame([(5, "a", "late"), (3, " a", "early"), (4, "b", "b")],
                                  "ordinal int, label string, candidate_id string")
    got = {r.supplier_name: r.candidate_id for r in orders.first_candidate(names, list_).collect()}
    assert got == {"a ": "early", "x": None}


@pytest.mark.parametrize("popup, question, status, want", [
    (None, None, "标准采购订单 4500000123 已创建", (4500000123, "CREATED", "4500000123")),
    (None, "系统消息已发出", "订单 7", (7, "CREATED", "7")), (None, "别的", "订单 7", (7, "CREATED", "7")),
    (None, None, "没有编号", (None, "FAILED", "")), (None, None, None, (None, "FAILED", "")),
    ("项目超出预算 12", None, "1", (None, "OVER_BUDGET", "超预算")),
    (None, "凭证仍有错，是否保留", "订单 7", (None, "VOUCHER_ERROR", "凭证仍有错")),
    ("没有满足选择标准的数据存在", None, None, (None, "NO_DATA", "没有满足选择标准的数据存在")),
    ("行号信息不完整", None, None, (None, "INCOMPLETE_LINES", "行号信息不完整")),
    ("公司信息不正确", None, None, (None, "BAD_SUPPLIER", "公司信息不正确")),
    ("其他 7", None, None, (None, "OTHER", "其他 7")),
])
def test_outcomes(spark, popup, question, status, want):
    df = spark.createDataFrame([(popup, question, status)], "popup string, question string, status string")
    assert tuple(df.select(orders.classify_outcome("popup", "question", "status").alias("o")).first().o) == want


def test_price_and_tax(spark):
    df = spark.createDataFrame([("新住配完善", 113.0, 100.0), ("other", 113.0, 100.0), (None, 113.0, 100.0)],
                               "kind string, incl double, excl double")
    got = orders.order_constants(df.select(
        orders.chosen_price("kind", "incl", "excl").alias("p"), orders.tax_rate("kind").alias("t"),
        orders.tax_code("kind").alias("c"))).collect()
    assert [(r.p, r.t, r.c) for r in got] == [(113.0, 0, "J0"), (100.0, 13, "U2"), (100.0, 13, "U2")]
    assert (got[0].purchasing_org, got[0].payment_term, got[0].currency, got[0].price_unit) == (
        "15A0", "TA01", "RMB", 1)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, None, 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (4, 1, None), (5, 1, "e")], "k int, w int, v string")
    got = changes.changed_rows(old, new, ["k"]).orderBy("k").collect()
    assert [(r.k, r.change, r.v, r.w) for r in got] == [
        (2, "update", "b", None), (3, "delete", "c", 1), (5, "insert", "e", 1)]


def test_order_flow_has_tasks_for_its_rows(spark):
    """Merged by their bytes, the partitions of narrow rows hold millions, sorted several times in one task."""
    spark.conf.set("spark.dockledger.maxTaskRows", "250")
    try:
        df = REGISTRY["purchase_orders"].build(spark, "/root/testdata/sf0.001")
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.dockledger.maxTaskRows")
    assert sum(sizes) == 6000 and max(sizes) < 500
    by_order = [x for x in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]
    assert len(by_order) >= 3 and all("24), REPARTITION_BY_NUM" in x for x in by_order), plan


def test_sheet_schema_has_the_columns_the_operators_use():
    assert {"requisition_no", "requisition_line", "supplier_name", "info"} <= set(
        schemas.REQUISITION_SHEET.names)
