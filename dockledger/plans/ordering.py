"""Requisitions on the driver tables: an order is a requisition, a lineitem its sheet row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions.text import MONEY, money_text, parse_amount, whole_number_text
from dockledger.operators import changes, hooks, orders
from dockledger.operators.skew import attach, hot_keys, lookup, positions, tasks_for
from dockledger.plans.registry import query, table
from dockledger.plans.workbook_files import to_workbooks
from dockledger.session import scratch_path
from dockledger.sources import sinks, tables
from dockledger.sources.workbooks import sheet_columns, workbook_rows

ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Sheet rows of one order and material, in a total order of their prices.
SHEET_ORDER = ["l_linenumber", "l_suppkey", "l_extendedprice"]
TAXED_TYPE = "PROMO"


def _sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet rows with the project type of their material."""
    types = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, folder, "lineitem").select(*ROW_ID, "l_extendedprice", "l_tax")
    return lookup(rows, types, ["l_partkey"], "inner")


@query(
    "A2 A3",
    """select l_orderkey, l_suppkey, count(*) as n_rows,
      arg_min(l_partkey, {'a': l_linenumber, 'b': l_partkey}) as first_part,
      arg_min(p_type, {'a': l_linenumber, 'b': l_partkey}) as first_type
    from lineitem join part on l_partkey = p_partkey group by 1, 2""",
)
def order_groups(spark: SparkSession, folder: str) -> DataFrame:
    grouped = orders.order_groups(
        _sheet(spark, folder), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"],
        ["l_partkey", "p_type"],
    )
    return grouped.withColumnsRenamed({"l_partkey": "first_part", "p_type": "first_type"})


@query(
    "A2",
    """select l_orderkey, l_suppkey, count(*) as n_rows from lineitem
    where l_discount <> 0 group by 1, 2""",
)
def requisition_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Two-level grouping; rows without a requisition (here: no discount) form no group."""
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_discount") != 0, F.col("l_orderkey")).alias("l_orderkey"), "l_suppkey"
    )
    return orders.group_counts(rows, ["l_orderkey", "l_suppkey"])


@query(
    "W2 A3 F20 F21 F22",
    f"""with typed as (
      select *, first_value(p_type) over (partition by l_orderkey, l_suppkey
          order by l_linenumber, l_partkey
          rows between unbounded preceding and unbounded following) as group_type,
        cast(l_extendedprice as decimal(18,2)) as excl,
        cast(l_extendedprice as decimal(18,2)) * (1 + cast(l_tax as decimal(18,2))) as incl
      from lineitem join part on l_partkey = p_partkey)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, group_type,
      cast(case when group_type = '{TAXED_TYPE}' then incl else excl end as double) as price,
      case when group_type = '{TAXED_TYPE}' then 0 else 13 end as tax,
      case when group_type = '{TAXED_TYPE}' then 'J0' else 'U2' end as tax_code,
      '15A0' as purchasing_org, 'TA01' as payment_term, 'RMB' as currency, 1 as price_unit
    from typed""",
)
def group_price_tax(spark: SparkSession, folder: str) -> DataFrame:
    """Price and tax by the project type of the first row of the (order, supplier) group."""
    rows = orders.group_first(
        _sheet(spark, folder), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"], ["p_type"]
    )
    excl = F.col("l_extendedprice").cast(MONEY)
    incl = excl * (F.lit(1) + F.col("l_tax").cast(MONEY))
    priced = rows.select(
        *ROW_ID,
        F.col("group_p_type").alias("group_type"),
        orders.chosen_price("group_p_type", incl, excl, TAXED_TYPE).cast("double").alias("price"),
        orders.tax_rate("group_p_type", TAXED_TYPE).alias("tax"),
        orders.tax_code("group_p_type", TAXED_TYPE).alias("tax_code"),
    )
    return orders.order_constants(priced)


@query(
    "J2 F13",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when s_acctbal >= 0 then concat('10000', s_suppkey) else s_name end as supplier_code
    from lineitem join supplier on l_suppkey = s_suppkey""",
)
def supplier_code(spark: SparkSession, folder: str) -> DataFrame:
    """Only suppliers with a balance of 0 or more have a code; names carry stray spaces."""
    suppliers = table(spark, folder, "supplier")
    names = suppliers.select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.concat(F.lit("　\t"), F.col("s_name"), F.lit(" ")).alias("supplier_name"),
    )
    codes = suppliers.where("s_acctbal >= 0").select(
        F.concat(F.col("s_name"), F.lit("　")).alias("supplier_name"),
        F.concat(F.lit("10000"), F.col("s_suppkey").cast("string")).alias("supplier_code"),
    )
    rows = lookup(table(spark, folder, "lineitem").select(*ROW_ID), names, ["l_suppkey"], "inner")
    return orders.supplier_code(rows, codes).select(*ROW_ID, "supplier_code")


@query(
    "J5 L1",
    """with candidates as (
      select p_brand, min(p_partkey) as ordinal, arg_min(p_name, p_partkey) as candidate
      from part where p_size > 10 group by 1)
    select p_partkey, cast(ordinal as varchar) as ordinal, candidate from part left join candidates using (p_brand)""",
)
def first_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """First list entry (a part of size over 10) whose label is the brand asked for."""
    parts = table(spark, folder, "part")
    names = parts.select("p_partkey", F.concat(F.lit(" "), F.col("p_brand")).alias("supplier_name"))
    candidates = parts.where("p_size > 10").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.col("p_brand"), F.lit("  ")).alias("label"),
        F.col("p_name").alias("candidate_id"),
    )
    found = orders.first_candidate(names, candidates)
    return found.select(
        "p_partkey", F.col("ordinal").cast("string").alias("ordinal"),
        F.col("candidate_id").alias("candidate"),
    )


@query(
    "J3 U2",
    """select l_orderkey, l_linenumber from lineitem
    except all select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'""",
)
def lines_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left when each returned line covers one line of the same number."""
    rows = table(spark, folder, "lineitem")
    return orders.missing_lines(
        rows, rows.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"]
    )


@query(
    "J3 F11",
    """with lines as (
      select l_orderkey, l_linenumber, count(*) as required,
        count(*) filter (where l_linestatus = 'F') * 2 as available
      from lineitem group by 1, 2)
    select l_orderkey, cast(sum(required) as bigint) as n_required,
      cast(sum(greatest(required - available, 0)) as bigint) as n_missing,
      sum(greatest(required - available, 0)) = 0 as complete
    from lines group by 1""",
)
def order_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers as sheets show them ('3.0'); every finished line is on offer twice."""
    rows = table(spark, folder, "lineitem")
    sheet = rows.select("l_orderkey", F.col("l_linenumber").cast("double").alias("line"))
    erp = rows.where("l_linestatus = 'F'").select(
        "l_orderkey", F.col("l_linenumber").alias("line")
    )
    checked = orders.line_completeness(
        sheet, erp.unionByName(erp), ["l_orderkey"], ["l_orderkey"], "line"
    )
    return checked.select("l_orderkey", "n_required", "n_missing", "complete")


_PRICE_SQL = """with sheet as (select * from lineitem where l_returnflag <> 'R'),
    priced as (
      select l_orderkey, l_partkey,
        arg_max(l_extendedprice, {'a': l_linenumber, 'b': l_suppkey, 'c': l_extendedprice}) as price
      from sheet group by 1, 2),
    sizes as (select l_orderkey, count(*) as n from sheet group by 1),
    erp as (
      select *, row_number() over (
        partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as ordinal
      from lineitem)"""


def _price_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "lineitem").select(*ROW_ID, "l_extendedprice", "l_returnflag")
    return rows.select(*ROW_ID), rows.where("l_returnflag <> 'R'")


@query(
    "J4 W3",
    _PRICE_SQL + """
    select l_orderkey, l_linenumber, cast(l_partkey as varchar) as l_partkey, l_suppkey, price
    from erp left join priced using (l_orderkey, l_partkey)""",
)
def price_apply(spark: SparkSession, folder: str) -> DataFrame:
    """All lines take the last price the sheet (lines not returned) has for their part."""
    erp, sheet = _price_tables(spark, folder)
    return orders.apply_prices(
        erp, sheet, "l_orderkey", "l_partkey", SHEET_ORDER, "l_extendedprice"
    )


@query(
    "J4",
    _PRICE_SQL + """
    select l_orderkey, l_linenumber, cast(l_partkey as varchar) as l_partkey, l_suppkey,
      case when ordinal < n then price end as price
    from erp left join priced using (l_orderkey, l_partkey) left join sizes using (l_orderkey)""",
)
def price_apply_first_n(spark: SparkSession, folder: str) -> DataFrame:
    """As price_apply, filling only as many lines as the sheet has rows."""
    erp, sheet = _price_tables(spark, folder)
    numbered = positions(
        erp, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "ordinal"
    ).withColumn("ordinal", F.col("ordinal") - 1)
    return orders.apply_prices(
        numbered, sheet, "l_orderkey", "l_partkey", SHEET_ORDER, "l_extendedprice", "ordinal",
    ).drop("ordinal")


_OUTCOME_SQL = """outcomes as (
      select l_orderkey, l_suppkey, concat('PO', l_orderkey, '-', l_suppkey) as outcome
      from lineitem where l_returnflag <> 'R' group by 1, 2)"""


def _sheet_and_outcomes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "lineitem").select(*ROW_ID, "l_returnflag")
    groups = rows.where("l_returnflag <> 'R'").select("l_orderkey", "l_suppkey").distinct()
    outcomes = groups.withColumn(
        "outcome",
        F.concat(F.lit("PO"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")),
    )
    return rows.select(*ROW_ID, F.lit("old").alias("info")), outcomes


@query(
    "J1 W3 L2",
    f"""with {_OUTCOME_SQL},
    winners as (
      select l_orderkey, l_linenumber, arg_max(outcome, l_suppkey) as outcome
      from lineitem join outcomes using (l_orderkey, l_suppkey) group by 1, 2)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(outcome, 'old') as info
    from lineitem left join winners using (l_orderkey, l_linenumber)""",
)
def write_back(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the groups with a line not returned, on the rows with their line numbers."""
    sheet, outcomes = _sheet_and_outcomes(spark, folder)
    return orders.write_back(sheet, outcomes, "l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "J1",
    f"""with {_OUTCOME_SQL}
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(outcome, 'old') as info
    from lineitem left join outcomes using (l_orderkey, l_suppkey)""",
)
def write_back_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    sheet, outcomes = _sheet_and_outcomes(spark, folder)
    return orders.write_back(
        sheet, outcomes, "l_orderkey", "l_linenumber", "l_suppkey", match_supplier=True
    )


@query(
    "A2 A3 J2 J3 F11 F12 F19 J1",
    f"""with offered as (
      select l_orderkey, l_linenumber, count(*) filter (where l_returnflag <> 'R') as have
      from lineitem group by 1, 2),
    on_offer as (select l_orderkey, sum(have) as n_have from offered group by 1),
    needed as (
      select l_orderkey, l_suppkey, l_linenumber, count(*) as need from lineitem group by 1, 2, 3),
    groups as (
      select l_orderkey, l_suppkey, sum(greatest(need - have, 0)) as n_missing
      from needed join offered using (l_orderkey, l_linenumber) group by 1, 2),
    firsts as (
      select l_orderkey, l_suppkey,
        arg_min(p_type, {{'a': l_linenumber, 'b': l_partkey}}) as group_type
      from lineitem join part on l_partkey = p_partkey group by 1, 2),
    outcomes as (
      select l_orderkey, l_suppkey, case when n_have = 0 then '没有满足选择标准的数据存在'
          when n_missing > 0 then '行号信息不完整'
          when s_acctbal < 0 then '公司信息不正确'
          when group_type = '{TAXED_TYPE}' then '超预算'
          when l_orderkey % 7 = 0 then '凭证仍有错'
          else cast(4500000000 + l_orderkey as varchar) end as outcome
      from groups join on_offer using (l_orderkey) join firsts using (l_orderkey, l_suppkey)
      join supplier on l_suppkey = s_suppkey),
    winners as (
      select l_orderkey, l_linenumber, arg_max(outcome, l_suppkey) as outcome
      from lineitem join outcomes using (l_orderkey, l_suppkey) group by 1, 2)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, outcome as info
    from lineitem join winners using (l_orderkey, l_linenumber)""",
)
def purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Whole order flow: group, check lines and supplier, submit, classify, write back.

    Returned lines are not on offer; what is on offer counts for the whole requisition. Orders of the taxed type
    exceed their budget, every seventh has a faulty voucher, the others a question that goes on.

    The lines are counted once per (order, supplier, line); everything up to the outcomes of the groups
    works on these counts, which lie together by order. Outcomes and rows then meet by order and line. Both
    stages sort their rows more than once, so the number of their tasks follows the number of rows.
    """
    group, order_line = ["l_orderkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]
    rows = table(spark, folder, "lineitem").select(*ROW_ID, "l_returnflag")
    types = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    suppliers = table(spark, folder, "supplier")
    # Without a hot order none of its lines is hot, nor any of its counts.
    hot = hot_keys(rows, ["l_orderkey"])
    tasks = tasks_for(rows)
    line = whole_number_text(F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")))
    first = F.min_by("p_type", F.struct("l_linenumber", "l_partkey"))
    order = F.min(F.struct("l_linenumber", "l_partkey"))
    typed = lookup(rows, types, ["l_partkey"], "inner")
    if not hot:
        typed = typed.repartition(tasks, "l_orderkey")
    counted = typed.groupBy(*group, "l_linenumber").agg(
        F.count(F.lit(1)).alias("_need"), F.count_if(F.col("l_returnflag") != "R").alias("_have"),
        first.alias("_type"), order.alias("_order"),
    ).withColumn("_line", line)
    lines = orders.with_group_totals(
        orders.offered_lines(counted, ["l_orderkey"], hot=hot), group, p_type=F.min_by("_type", "_order")
    )
    named = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier_name"))
    codes = suppliers.where("s_acctbal >= 0").select(
        F.col("s_name").alias("supplier_name"), F.concat(F.lit("SP"), "s_suppkey").alias("supplier_code")
    )
    code_of = orders.supplier_code(named, codes).select("l_suppkey", "supplier_code")
    coded = lookup(lines, code_of, ["l_suppkey"], "inner", counted=named, probed=rows)
    popup = F.when(F.col("p_type") == TAXED_TYPE, F.lit("项目超出预算"))
    question = F.when(F.col("l_orderkey") % 7 == 0, F.lit("凭证仍有错，是否保留")).otherwise("系统消息已发出")
    status = F.concat(F.lit("订单 "), (F.col("l_orderkey") + 4500000000).cast("string"))
    outcome = orders.attempt_outcome(
        F.col("n_available"), F.col("n_missing"), F.col("supplier_code").startswith("SP"),
        popup, question, status,
    )
    judged = coded.select(*group, "l_linenumber", outcome["message"].alias("outcome"))
    sheet = rows.select(*ROW_ID)
    if not hot:
        judged, sheet = judged.repartition(tasks, *order_line), sheet.repartition(tasks, *order_line)
    winners = judged.groupBy(*order_line).agg(F.max_by("outcome", "l_suppkey").alias("info"))
    return attach(sheet, winners, order_line, "inner", hot=None if hot else {}).select(*ROW_ID, "info")


@query(
    "F12 F19",
    """with raw as (
      select event_id, case event_type
          when 'error' then concat('项目超出预算 ', props)
          when 'click' then '没有满足选择标准的数据存在'
          when 'view' then concat('其他消息 ', event_id) end as popup,
        case when event_type = 'signup' and value >= 50 then '凭证仍有错，是否保留'
          when event_type = 'signup' then '系统消息已发出' end as question,
        case when value >= 10 then concat('标准采购订单 ', 4500000000 + event_id, ' 已创建 9')
          else '没有编号' end as status
      from events),
    judged as (select *, coalesce(contains(question, '凭证仍有错'), false) as voucher from raw)
    select event_id, case when popup is null and not voucher
        then nullif(regexp_extract(status, '\\d+'), '') end as order_no,
      case when contains(popup, '超出预算') then 'OVER_BUDGET'
        when contains(popup, '没有满足选择标准的数据存在') then 'NO_DATA'
        when popup is not null then 'OTHER' when voucher then 'VOUCHER_ERROR'
        when regexp_matches(status, '\\d') then 'CREATED' else 'FAILED' end as outcome_code,
      case when contains(popup, '超出预算') then '超预算'
        when popup is not null then popup when voucher then '凭证仍有错'
        else regexp_extract(status, '\\d+') end as message
    from judged""",
)
def outcome_class(spark: SparkSession, folder: str) -> DataFrame:
    """Pop-ups on saving, the question after it, with which some go on, and the status line."""
    kind, number = F.col("event_type"), F.col("event_id")
    popup = (
        F.when(kind == "error", F.concat(F.lit("项目超出预算 "), F.col("props")))
        .when(kind == "click", F.lit("没有满足选择标准的数据存在"))
        .when(kind == "view", F.concat(F.lit("其他消息 "), number.cast("string")))
    )
    question = F.when(kind == "signup", F.when(F.col("value") >= 50, "凭证仍有错，是否保留").otherwise("系统消息已发出"))
    status = F.when(
        F.col("value") >= 10,
        F.concat(F.lit("标准采购订单 "), (number + 4500000000).cast("string"), F.lit(" 已创建 9")),
    ).otherwise(F.lit("没有编号"))
    return table(spark, folder, "events").select(
        "event_id", orders.classify_outcome(popup, question, status).alias("o")
    ).select(
        "event_id", F.col("o.order_no").cast("string").alias("order_no"), "o.outcome_code", "o.message"
    )


@query(
    "F11",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      cast(l_orderkey as varchar) as requisition_no,
      cast(cast(trunc(l_extendedprice - 50000) as bigint) as varchar) as whole
    from lineitem""",
)
def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        *ROW_ID,
        whole_number_text(F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")))
        .alias("requisition_no"),
        whole_number_text(F.col("l_extendedprice") - 50000).alias("whole"),
    )


@query(
    "F9 F14",
    """select o_orderkey, concat('¥', format('{:,.2f}', o_totalprice)) as amount_text,
      o_totalprice as amount from orders""",
)
def amount_text(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts as shown on screen, and read back from the text."""
    shown = table(spark, folder, "orders").select(
        "o_orderkey", money_text("o_totalprice").alias("amount_text")
    )
    return shown.withColumn(
        "amount", parse_amount(F.translate("amount_text", "¥", " ")).cast("double")
    )


@query(
    "S1 S7",
    """select cast(l_orderkey as varchar) as requisition_no,
      cast(l_linenumber as varchar) as requisition_line, cast(l_partkey as varchar) as material_code,
      case when l_tax > 0 then l_extendedprice end as price_incl_tax,
      case when l_tax > 0 then '' else 'price_incl_tax' end as bad_columns from lineitem""",
)
def csv_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Requisition sheet written as CSV and read back by its suffix, with declared types.

    The file has its columns in another order and one more; some prices are no numbers.
    """
    path = scratch_path(spark, "sheet") + ".csv"
    price = F.col("l_extendedprice").cast(MONEY).cast("string")
    table(spark, folder, "lineitem").select(
        F.when(F.col("l_tax") > 0, price).otherwise("see offer").alias("price_incl_tax"),
        F.col("l_partkey").alias("material_code"),
        F.col("l_suppkey").alias("not_declared"),
        F.col("l_linenumber").alias("requisition_line"),
        F.col("l_orderkey").alias("requisition_no"),
    ).write.option("header", True).csv(path)
    schema = T.StructType.fromDDL(
        "requisition_no string, requisition_line string, material_code string, "
        "price_incl_tax decimal(18,2)"
    )
    return tables.read_table(spark, path, schema, bad="bad_columns").withColumns({
        "price_incl_tax": F.col("price_incl_tax").cast("double"),
        "bad_columns": F.array_join("bad_columns", ","),
    })


@query(
    "S2 S7",
    """select cast(o_orderkey as varchar) as requisition_no, cast(o_custkey as varchar) as supplier_name,
      o_totalprice as price_incl_tax, o_orderpriority as project_type from orders""",
)
def workbook_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as workbook files, and the workbooks read back as a table."""
    books = to_workbooks(
        table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("requisition_no"),
            F.col("o_custkey").alias("supplier_name"),
            F.col("o_totalprice").cast(MONEY).alias("price_incl_tax"),
            F.col("o_orderpriority").alias("project_type"),
        ),
        spark.sparkContext.defaultParallelism,
    )
    schema = T.StructType.fromDDL(
        "requisition_no string, supplier_name string, price_incl_tax decimal(18,2), "
        "project_type string"
    )
    return sheet_columns(workbook_rows(books), schema).select(
        "requisition_no", "supplier_name",
        F.col("price_incl_tax").cast("double").alias("price_incl_tax"), "project_type",
    )


@query(
    "S7 J1",
    """select o_orderkey, case when o_orderstatus = 'F' then concat('PO', o_orderkey)
      else 'open' end as info from orders""",
)
def sheet_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A table rewritten from itself: version 1 is computed from version 0."""
    path = scratch_path(spark, "sheet-versions")
    source = table(spark, folder, "orders")
    sinks.write_version(source.select("o_orderkey", F.lit("open").alias("info")), path, 0)
    outcomes = source.where("o_orderstatus = 'F'").select(
        "o_orderkey", F.concat(F.lit("PO"), F.col("o_orderkey").cast("string")).alias("outcome")
    )
    updated = sinks.read_version(spark, path, 0).join(outcomes, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("outcome", "info").alias("info")
    )
    sinks.write_version(updated, path, 1)
    return sinks.read_version(spark, path, 1)


_CHANGED_SQL = """old as (select * from orders where o_orderpriority <> '1-URGENT'),
    new as (
      select o_orderkey, o_custkey,
        case when o_orderstatus = 'P' then null else o_orderstatus end as o_orderstatus,
        case when o_orderpriority = '2-HIGH' then o_totalprice + 1 else o_totalprice end as o_totalprice
      from orders where o_orderpriority <> '5-LOW')"""


@query(
    "V8",
    f"""with {_CHANGED_SQL}
    select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey,
      case when o.o_orderkey is null then 'insert' when n.o_orderkey is null then 'delete'
        else 'update' end as change,
      case when n.o_orderkey is null then o.o_custkey else n.o_custkey end as o_custkey,
      case when n.o_orderkey is null then o.o_orderstatus else n.o_orderstatus end as o_orderstatus,
      case when n.o_orderkey is null then o.o_totalprice else n.o_totalprice end as o_totalprice
    from old o full join new n on o.o_orderkey = n.o_orderkey
    where o.o_orderkey is null or n.o_orderkey is null
      or o.o_orderstatus is distinct from n.o_orderstatus
      or o.o_totalprice is distinct from n.o_totalprice""",
)
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Old and new state of the orders: urgent ones are new, low ones are gone."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    source = table(spark, folder, "orders")
    old = source.where("o_orderpriority <> '1-URGENT'").select(*columns)
    new = source.where("o_orderpriority <> '5-LOW'").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )
    return changes.changed_rows(old, new, ["o_orderkey"])


@query(
    "X3",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey,
      concat(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey),
        '/', count(*) over (partition by l_suppkey)) as place,
      l_quantity >= 25 as large,
      cast(sum(cast(l_quantity as bigint)) over (partition by l_suppkey) as bigint) as group_quantity
    from lineitem""",
)
def group_hook(spark: SparkSession, folder: str) -> DataFrame:
    """The caller's pandas step, once per supplier."""
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )

    def step(group: pd.DataFrame) -> pd.DataFrame:
        place = group["group_row"].astype(str) + "/" + group["group_rows"].astype(str)
        return pd.DataFrame(
            {
                "l_suppkey": group["l_suppkey"], "l_orderkey": group["l_orderkey"],
                "l_linenumber": group["l_linenumber"], "l_partkey": group["l_partkey"],
                "place": place, "large": group["l_quantity"] >= 25,
                "group_quantity": int(group["l_quantity"].astype("int64").sum()),
            }
        )

    return hooks.per_group(
        rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], step,
        "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, "
        "place string, large boolean, group_quantity long",
    )
