"""Receiving documents on the driver tables: an order is a document, a lineitem its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.text import MONEY
from dockledger.operators import documents as docs
from dockledger.operators import hooks
from dockledger.operators.skew import collect_parts, lookup, positions
from dockledger.plans.registry import query, table
from dockledger.session import scratch_path
from dockledger.sources import sinks, tables

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def _unit() -> Column:
    """Stand-in for the units of a scanned document."""
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "套").when(flag == "R", "个").otherwise("kg")


_UNIT_SQL = "case l_returnflag when 'A' then '套' when 'R' then '个' else 'PCS' end"
_NUMBERED_SQL = """
    numbered as (
      select *, row_number() over (
        partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n
      from lineitem)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered lines with raw quantity, unit and price."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", *LINE_ORDER, "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_tax"
    )
    return positions(rows, ["l_orderkey"], LINE_ORDER, "lineNumber").select(
        F.col("l_orderkey").alias("documentNumber"),
        "lineNumber",
        F.col("l_partkey").cast("string").alias("name"),
        F.col("l_quantity").alias("quantity"),
        _unit().alias("unit"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        "l_shipdate",
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Document headers; a few fields are absent on some documents."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", "c_mktsegment"
    )
    orders = lookup(table(spark, folder, "orders"), customers, ["o_custkey"], "left")
    return orders.select(
        F.col("o_orderkey").alias("documentNumber"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
        .alias("documentType"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("date"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("supplier"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("SP"), F.col("o_custkey").cast("string")))
        .alias("supplierCode"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("warehouse"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.lit("WH002")).alias("warehouseCode"),
        F.when(F.col("o_orderstatus") == "F", F.lit("clerk")).alias("operator"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")).alias("remarks"),
        F.col("o_totalprice").alias("totalAmount"),
        "o_orderdate",
    )


_ORDERS_SQL = """
    docs as (
      select o_orderkey as document,
        case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as document_type,
        case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') end as doc_date,
        case when c_acctbal >= 0 then c_name end as supplier,
        case when c_acctbal >= 0 then concat('SP', o_custkey) end as supplier_code,
        case when c_mktsegment <> 'BUILDING' then c_mktsegment end as warehouse,
        case when c_mktsegment <> 'BUILDING' then 'WH002' end as warehouse_code,
        case when o_orderstatus = 'F' then 'clerk' end as operator,
        case when o_orderpriority = '1-URGENT' then 'urgent' end as remarks,
        o_totalprice, o_orderdate
      from orders left join customer on o_custkey = c_custkey)"""


@query(
    "N1 W1 F4 F5 F6 F7 F8",
    f"""with {_NUMBERED_SQL}
    select l_orderkey as document, n as line_number, printf('MAT%04d', n) as material_code,
      {_UNIT_SQL} as unit, l_quantity as quantity, l_extendedprice as unit_price,
      cast(cast(l_quantity as decimal(18,2)) * cast(l_extendedprice as decimal(18,2)) as double)
        as total_price,
      concat('BATCH', strftime(l_shipdate, '%Y%m%d')) as batch_number,
      strftime(l_shipdate, '%Y-%m-%d') as production_date, '2026-12-31' as expiry_date,
      printf('A-%02d-01', n) as storage_location
    from numbered""",
)
def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = docs.place_lines(docs.type_items(_lines(spark, folder)), F.col("l_shipdate"))
    return lines.select(
        F.col("documentNumber").alias("document"),
        F.col("lineNumber").alias("line_number"),
        F.col("materialCode").alias("material_code"),
        docs.normalise_unit("unit").alias("unit"),
        F.col("quantity").cast("double").alias("quantity"),
        F.col("unitPrice").cast("double").alias("unit_price"),
        docs.line_amount().cast("double").alias("total_price"),
        F.col("batchNumber").alias("batch_number"),
        F.col("productionDate").alias("production_date"),
        F.col("expiryDate").alias("expiry_date"),
        F.col("storageLocation").alias("storage_location"),
    )


@query(
    "F4",
    """with typed as (
      select l_orderkey, l_tax = 0 as bad, cast(l_quantity as decimal(18,2)) as q,
        case when l_discount = 0 then 0 else cast(l_extendedprice as decimal(18,2)) end as p
      from lineitem)
    select l_orderkey as document, count(*) filter (where not bad) as accepted, count(*) filter (where bad) as rejected,
      cast(coalesce(sum(q * p) filter (where not bad), 0) as double) as amount
    from typed group by 1""",
)
def item_typing(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities that are no number are rejected; a missing price counts as 0."""
    raw = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_tax") == 0, F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice").cast("string")).alias("price"),
    )
    lines = docs.type_items(raw)
    good = F.col("item_error").isNull()
    return lines.groupBy(F.col("l_orderkey").alias("document")).agg(
        F.count_if(good).alias("accepted"),
        F.count_if(~good).alias("rejected"),
        F.coalesce(F.sum(F.when(good, docs.line_amount())), F.lit(0)).cast("double").alias("amount"),
    )


def _stated_summary(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("document"), "o_totalprice", "o_orderdate"
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("document"), "l_quantity", "l_extendedprice"
    )
    return docs.summarise(
        documents, lines, ["document"],
        F.col("l_quantity").cast(MONEY), F.col("l_extendedprice").cast(MONEY),
    )


_SUMMARY_SQL = """
    totals as (
      select l_orderkey, count(*) as n, sum(cast(l_quantity as decimal(18,2))) as q,
        sum(cast(l_extendedprice as decimal(18,2))) as a
      from lineitem group by 1),
    summary as (
      select o_orderkey as document, o_orderdate, cast(o_totalprice as decimal(18,2)) as stated,
        coalesce(n, 0) as total_items, coalesce(q, 0) as total_quantity,
        coalesce(a, 0) as total_amount
      from orders left join totals on o_orderkey = l_orderkey)"""


@query(
    "A1",
    f"""with {_SUMMARY_SQL}
    select document, total_items, cast(total_quantity as double) as total_quantity,
      cast(total_amount as double) as total_amount, 'CNY' as currency from summary""",
)
def doc_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _stated_summary(spark, folder).select(
        "document",
        F.col("totalItems").alias("total_items"),
        F.col("totalQuantity").cast("double").alias("total_quantity"),
        F.col("totalAmount").cast("double").alias("total_amount"),
        "currency",
    )


@query(
    "V1 V2 A1 F14",
    f"""with {_SUMMARY_SQL},
    given as (
      select *, case when document % 10 = 3 then 'about ' || stated when document % 10 = 4 then null
          when document % 2 = 0 then format('{{:,.2f}}', cast(stated as double))
          else cast(stated as varchar) end as given,
        case when document % 10 not in (3, 4) then stated end as number
      from summary)
    select document, given as stated, cast(total_amount as double) as total_amount,
      document % 10 = 3 as amount_error, cast(total_amount - number as double) as amount_diff,
      total_amount - number = 0 as reconciles, abs(total_amount - number) < 10 as amount_ok
    from given""",
)
def doc_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Stated totals are text: some with separators, some that are no number, some missing."""
    amount, last = F.col("o_totalprice").cast(MONEY), F.col("document") % 10
    stated = (
        F.when(last == 3, F.concat(F.lit("about "), amount.cast("string"))).when(last == 4, F.lit(None))
        .when(last % 2 == 0, F.format_number("o_totalprice", 2)).otherwise(amount.cast("string"))
    )
    checked = docs.reconcile(_stated_summary(spark, folder).withColumn("stated", stated), "stated")
    return checked.select(
        "document",
        "stated",
        F.col("totalAmount").cast("double").alias("total_amount"),
        "amount_error",
        F.col("amount_diff").cast("double").alias("amount_diff"),
        "reconciles",
        "amount_ok",
    )


@query(
    "A9 F8 F9",
    f"""with {_SUMMARY_SQL}
    select concat('EXEC_', document) as execution_id,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as execution_time,
      cast(document as varchar) as source_document,
      concat('GR', strftime(o_orderdate, '%Y%m%d'), '00156') as receipt_number,
      total_items as items_processed, cast(total_amount as double) as total_amount,
      concat('¥', format('{{:,.2f}}', cast(total_amount as double))) as amount_text,
      'CNY' as currency, 'SUCCESS' as status, 'RPA_AUTO_SYSTEM' as operator,
      '自动化流程执行成功' as remarks
    from summary""",
)
def exec_report(spark: SparkSession, folder: str) -> DataFrame:
    report = docs.execution_report(
        _stated_summary(spark, folder), F.col("o_orderdate"), "document"
    )
    return report.select(
        F.col("executionId").alias("execution_id"),
        F.col("executionTime").alias("execution_time"),
        F.col("sourceDocument").alias("source_document"),
        F.col("receiptNumber").alias("receipt_number"),
        F.col("itemsProcessed").alias("items_processed"),
        F.col("totalAmount").cast("double").alias("total_amount"),
        F.col("amountText").alias("amount_text"),
        "currency",
        "status",
        "operator",
        "remarks",
    )


@query(
    "F3",
    f"""with {_ORDERS_SQL}
    select 'GOODS_RECEIPT' as document_type, document, doc_date as transaction_date,
      coalesce(supplier_code, 'UNKNOWN') as supplier_code, supplier as supplier_name,
      coalesce(warehouse_code, 'WH001') as warehouse_code,
      coalesce(warehouse, '主仓库') as warehouse_name, 'RECEIVE' as operation_type,
      coalesce(operator, 'System') as operator, coalesce(remarks, '') as remarks,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as created_at
    from docs""",
)
def doc_header(spark: SparkSession, folder: str) -> DataFrame:
    header = docs.map_header(_orders(spark, folder), docs.FULL_HEADER, F.col("o_orderdate"))
    return header.select(
        F.col("documentType").alias("document_type"),
        F.col("documentNumber").alias("document"),
        F.col("transactionDate").alias("transaction_date"),
        F.col("supplierCode").alias("supplier_code"),
        F.col("supplierName").alias("supplier_name"),
        F.col("warehouseCode").alias("warehouse_code"),
        F.col("warehouseName").alias("warehouse_name"),
        F.col("operationType").alias("operation_type"),
        "operator",
        "remarks",
        F.col("createdAt").alias("created_at"),
    )


@query(
    "F2",
    f"""with {_ORDERS_SQL}
    select 'RECEIPT' as document_type, document, doc_date as transaction_date,
      supplier as supplier_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as processed_at
    from docs""",
)
def doc_header_minimal(spark: SparkSession, folder: str) -> DataFrame:
    header = docs.map_header(
        _orders(spark, folder), docs.MINIMAL_HEADER, F.col("o_orderdate"), "processedAt"
    )
    return header.select(
        F.col("documentType").alias("document_type"),
        F.col("documentNumber").alias("document"),
        F.col("transactionDate").alias("transaction_date"),
        F.col("supplierName").alias("supplier_name"),
        F.col("processedAt").alias("processed_at"),
    )


@query(
    "F1",
    f"""with {_ORDERS_SQL},
    gaps as (
      select document, case when document_type is null then 'documentType' end as a,
        case when doc_date is null then 'date' end as b,
        case when supplier is null then 'supplier' end as c,
        case when l_orderkey is null then 'items' end as d
      from docs left join (select distinct l_orderkey from lineitem) on document = l_orderkey)
    select document, coalesce(a, b, c, d) as reject_reason,
      cast(a is not null as bigint) + cast(b is not null as bigint)
        + cast(c is not null as bigint) + cast(d is not null as bigint) as n_missing
    from gaps""",
)
def doc_required(spark: SparkSession, folder: str) -> DataFrame:
    """An order without any line stands for a document without items."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("documentNumber"))
    checked = docs.required_fields(
        _orders(spark, folder).join(
            lines.agg(F.count(F.lit(1)).alias("items")), "documentNumber", "left"
        )
    )
    return checked.select(
        F.col("documentNumber").alias("document"),
        F.size("missing").cast("long").alias("n_missing"),
        "reject_reason",
    )


@query(
    "F1",
    """with raw as (
      select event_id, case event_type when 'error' then '{"k": null}' when 'view' then '{}'
        else props end as doc from events)
    select event_id, case when json_type(doc, '$.k') is null then 'k' end as reject_reason
    from raw""",
)
def doc_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Presence, not value: a key written as null is there."""
    kind = F.col("event_type")
    raw = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "error", F.lit('{"k": null}')).when(kind == "view", F.lit("{}"))
        .otherwise(F.col("props")).alias("document"),
    )
    return docs.required_keys(raw, "document", ["k"]).select("event_id", "reject_reason")


@query(
    "V3 X2",
    """with raw as (
      select *, case when l_returnflag = 'R' then strftime(l_shipdate, '%d/%m/%Y')
        else strftime(l_shipdate, '%Y-%m-%d') end as ship_text from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      concat_ws(',', case when not l_quantity between 1 and 45 then 'quantity' end,
        case when not (regexp_matches(ship_text, '^\\d{4}-\\d{2}-\\d{2}$')
          and try_strptime(ship_text, '%Y-%m-%d') is not null) then 'date' end,
        case when not l_discount <= 0.05 then 'discount' end) as broken
    from raw""",
)
def line_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Range and date checks, and one rule given by the caller as SQL."""
    shipped = F.when(
        F.col("l_returnflag") == "R", F.date_format("l_shipdate", "dd/MM/yyyy")
    ).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = table(spark, folder, "lineitem").withColumn("ship_text", shipped)
    checked = hooks.custom_rules(
        rows,
        [
            ("quantity", docs.in_range(F.col("l_quantity"), 1, 45)),
            ("date", docs.date_is_valid("ship_text")),
            ("discount", "l_discount <= 0.05D"),
        ],
    )
    return checked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join("broken", ",").alias("broken"),
    )


@query(
    "N1 F5",
    f"""with {_NUMBERED_SQL}
    select l_orderkey as document, n as line_number, cast(l_partkey as varchar) as material_name,
      case when l_returnflag = 'A' then 'large' else '' end as specification,
      case when l_tax > 0 then l_extendedprice end as total_price
    from numbered""",
)
def stated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the amount their document states, null where that is no number."""
    stated = F.when(F.col("tax") > 0, F.col("price").cast(MONEY).cast("string")).otherwise("?")
    raw = _lines(spark, folder).withColumns({
        "totalPrice": stated, "specification": F.when(F.col("unit") == "套", "large"),
    })
    lines = docs.standard_lines(docs.type_items(raw), F.col("l_shipdate"), mode="stated")
    return lines.select(
        F.col("documentNumber").alias("document"), F.col("lineNumber").alias("line_number"),
        F.col("materialName").alias("material_name"), "specification",
        F.col("totalPrice").cast("double").alias("total_price"),
    )


@query(
    "N1 N2 S8",
    f"""with {_NUMBERED_SQL}, {_SUMMARY_SQL},
    items as (
      select l_orderkey, count(*) as n_items,
        string_agg(concat_ws(':', n, printf('MAT%04d', n), l_partkey, '', cast(l_quantity as bigint),
            {_UNIT_SQL}, cast(l_extendedprice as decimal(18,2)),
            cast(cast(l_quantity as decimal(18,2)) * cast(l_extendedprice as decimal(18,2)) as decimal(18,2)),
            concat('BATCH', strftime(l_shipdate, '%Y%m%d')), strftime(l_shipdate, '%Y-%m-%d'),
            '2026-12-31', printf('A-%02d-01', n)), ',' order by n) as items_text
      from numbered group by 1)
    select document, strftime(o_orderdate, '%Y-%m-%d') as transaction_date,
      coalesce(n_items, 0) as n_items, coalesce(items_text, '') as items_text,
      total_items, cast(total_amount as double) as total_amount
    from summary left join items on document = l_orderkey""",
)
def doc_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Nested documents, shown flat: all fields of the items as text, a header and a summary field."""
    summaries = _stated_summary(spark, folder).withColumnRenamed("document", "documentNumber")
    headers = summaries.select(
        "documentNumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("transactionDate")
    )
    lines = docs.standard_lines(docs.type_items(_lines(spark, folder)), F.col("l_shipdate"))
    nested = docs.nested_documents(
        headers, lines, summaries.select("documentNumber", "totalItems", "totalAmount")
    )
    kinds = {"quantity": "long", "unitPrice": MONEY, "totalPrice": MONEY}
    shown = F.transform(
        "items",
        lambda x: F.concat_ws(":", *[x[f].cast(kinds.get(f, "string")).cast("string") for f in docs.LINE_FIELDS]),
    )
    return nested.select(
        F.col("documentNumber").alias("document"),
        F.col("header.transactionDate").alias("transaction_date"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(shown, ",").alias("items_text"),
        F.col("summary.totalItems").alias("total_items"),
        F.col("summary.totalAmount").cast("double").alias("total_amount"),
    )


def _raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Raw nested documents: headers with their items."""
    items = collect_parts(
        _lines(spark, folder), ["documentNumber"], "lineNumber", ["name", "quantity", "unit", "price"]
    )
    return _orders(spark, folder).join(items, "documentNumber", "left")


@query(
    "S3 F1 F3 N1 F4 F5 F6 F7 A1 V1 A9",
    f"""with {_ORDERS_SQL}, {_NUMBERED_SQL},
    totals as (
      select l_orderkey, count(*) as n, sum(cast(l_quantity as decimal(18,2))) as q,
        sum(cast(l_quantity as decimal(18,2)) * cast(l_extendedprice as decimal(18,2))) as a,
        count(*) filter (where {_UNIT_SQL} = 'PCS') as n_pcs, max(printf('MAT%04d', n)) as last_material
      from numbered group by 1)
    select document, coalesce(supplier_code, 'UNKNOWN') as supplier_code,
      n as items_processed, cast(q as double) as total_quantity, cast(a as double) as total_amount,
      concat('¥', format('{{:,.2f}}', cast(a as double))) as amount_text, n_pcs, last_material,
      a = cast(o_totalprice as decimal(18,2)) as reconciles,
      concat('EXEC_', document) as execution_id
    from docs join totals on document = l_orderkey
    where document_type is not null and doc_date is not null and supplier is not null""",
)
def receiving_report(spark: SparkSession, folder: str) -> DataFrame:
    """Whole receiving flow: JSON text, validation, header, lines, totals, report."""
    text = _raw_documents(spark, folder).select(
        "o_orderdate",
        sinks.json_text(
            F.struct(
                "documentType", "documentNumber", "date", "supplier", "supplierCode",
                "warehouse", "warehouseCode", "operator", "remarks", "totalAmount", "items",
            )
        ).alias("document"),
    )
    parsed = docs.accepted(docs.required_fields(tables.parse_documents(text, "document")))
    header = docs.map_header(
        parsed, docs.FULL_HEADER, F.col("o_orderdate"),
        keep=["o_orderdate", "totalAmount", "items"],
    )
    document = ["documentNumber", "supplierCode", "totalAmount"]
    lines = docs.place_lines(
        docs.type_items(
            docs.explode_items(header, [*document, "o_orderdate"], keep_empty=True)
        ),
        F.col("o_orderdate"),
    ).withColumn("unit", docs.normalise_unit("unit"))
    totals = lines.withColumnRenamed("totalAmount", "statedAmount").groupBy("documentNumber").agg(
        F.max("supplierCode").alias("supplierCode"),
        F.max("statedAmount").alias("statedAmount"),
        F.count("lineNumber").alias("totalItems"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("totalQuantity"),
        F.coalesce(F.sum(docs.line_amount()), F.lit(0)).alias("totalAmount"),
        F.count_if(F.col("lineNumber").isNotNull() & (F.col("unit") == "PCS")).alias("n_pcs"),
        F.max("materialCode").alias("last_material"),
    )
    summary = docs.reconcile(totals)
    return summary.select(
        F.col("documentNumber").cast("long").alias("document"),
        F.col("supplierCode").alias("supplier_code"),
        F.col("totalItems").alias("items_processed"),
        F.col("totalQuantity").cast("double").alias("total_quantity"),
        F.col("totalAmount").cast("double").alias("total_amount"),
        docs.money_text("totalAmount").alias("amount_text"),
        "n_pcs", "last_material", "reconciles",
        F.concat(F.lit("EXEC_"), F.col("documentNumber")).alias("execution_id"),
    )


@query(
    "S4",
    """select cast(c_custkey as varchar) as folder_path, cast(o_orderkey as varchar) as document,
      o_totalprice as total_amount
    from customer left join orders on c_custkey = o_custkey""",
)
def scan_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A customer is a scan folder, its orders the documents found in it."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("documentNumber"),
        F.col("o_totalprice").alias("totalAmount"), "o_orderkey",
    )
    found = collect_parts(
        positions(orders, ["o_custkey"], ["o_orderkey"], "_pos"), ["o_custkey"], "_pos",
        ["documentNumber", "totalAmount"], "documents",
    )
    batches = (
        table(spark, folder, "customer").select("c_custkey")
        .join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("folderPath"),
            F.coalesce(F.size("documents"), F.lit(0)).alias("imagesProcessed"),
            "documents",
        )
    )
    return tables.scanned_documents(batches).select(
        F.col("folderPath").alias("folder_path"),
        F.col("documentNumber").alias("document"),
        F.col("totalAmount").alias("total_amount"),
    )


@query(
    "S3 S8",
    f"""with {_ORDERS_SQL}
    select cast(document as varchar) as document, document_type, doc_date, supplier,
      o_totalprice as total_amount from docs""",
)
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as JSON files and read back with the declared schema."""
    path = scratch_path(spark, "documents") + ".json"
    sinks.write_json(_orders(spark, folder).drop("o_orderdate"), path)
    return tables.read_documents(spark, path).where(F.col("_corrupt").isNull()).select(
        F.col("documentNumber").alias("document"),
        F.col("documentType").alias("document_type"),
        F.col("date").alias("doc_date"),
        "supplier",
        F.col("totalAmount").cast("double").alias("total_amount"),
    )


@query(
    "V4",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    where not exists (select 1 from part where p_partkey = l_partkey and p_retailprice >= 950)""",
)
def unknown_material(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose part is not on the material list (parts from a price of 950 up)."""
    known = table(spark, folder, "part").where("p_retailprice >= 950").select(
        F.col("p_partkey").alias("l_partkey")
    )
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return docs.unknown_values(rows, known, ["l_partkey"])


_QUALIFIED_SQL = """select l_suppkey, count(*) as n_lines,
      cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
    from lineitem where l_suppkey {} (select s_suppkey from supplier where s_acctbal > 0)
    group by 1"""


def _by_supplier(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("amount"),
    )


def _supplier_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")


@query("V5", _QUALIFIED_SQL.format("not in"))
def supplier_unqualified(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_extendedprice")
    return _by_supplier(docs.unqualified(
        lines, _supplier_list(spark, folder), ["l_suppkey"], F.col("s_acctbal") > 0
    ))


@query("V5", _QUALIFIED_SQL.format("in"))
def supplier_qualified(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_extendedprice")
    return _by_supplier(docs.qualified(
        lines, _supplier_list(spark, folder), ["l_suppkey"], F.col("s_acctbal") > 0
    ))


@query(
    "V6",
    """with stock as (
      select l_partkey, sum(cast(l_quantity as decimal(18,2))) as stock from lineitem group by 1)
    select p_partkey as place, cast(stock as double) as stock, p_size * 30 as capacity,
      cast(stock - p_size * 30 as double) as excess
    from stock join part on l_partkey = p_partkey where stock > p_size * 30""",
)
def stock_capacity(spark: SparkSession, folder: str) -> DataFrame:
    """Each part has its own place, which holds thirty times the part's size."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("place"), "l_quantity")
    capacity = table(spark, folder, "part").select(
        F.col("p_partkey").alias("place"), (F.col("p_size") * 30).alias("capacity")
    )
    return docs.over_capacity(lines, capacity, ["place"], F.col("l_quantity").cast(MONEY)).select(
        "place", F.col("stock").cast("double").alias("stock"), "capacity",
        F.col("excess").cast("double").alias("excess"),
    )


@query(
    "F6",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case l_returnflag when 'A' then 'SET' when 'R' then '个' else 'PCS' end as unit
    from lineitem""",
)
def unit_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Units from a table; a unit not in it follows the fixed rule."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _unit().alias("unit")
    )
    units = spark.createDataFrame([("套", "SET")], "unit string, standard_unit string")
    return docs.normalise_unit_by(rows, units)


@query(
    "X1",
    """select l_orderkey as document, count(*) as n_lines,
      count(*) filter (where l_quantity >= 10) as n_large from lineitem group by 1""",
)
def clean_hook(spark: SparkSession, folder: str) -> DataFrame:
    """The caller's cleaning step as pandas code over Arrow batches."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity")

    def clean(batches):
        for batch in batches:
            yield batch.assign(large=batch["l_quantity"] >= 10)

    cleaned = hooks.clean_documents(
        rows, clean, "l_orderkey long, l_quantity double, large boolean"
    )
    return cleaned.groupBy(F.col("l_orderkey").alias("document")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("large").alias("n_large")
    )
