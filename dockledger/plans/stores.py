"""Tables kept in versions, by digest, by index or by date, on the driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import variants
from dockledger.functions.decode import decode_chunks, encode_gbk
from dockledger.operators import asof, changes, hooks, orders, search
from dockledger.plans.registry import REGISTRY, query, table
from dockledger.session import scratch_path
from dockledger.sources.versions import VersionedTable

CHUNK_BYTES = 61


@query(
    "S7 J1 W3 L2",
    """with outcomes as (
      select l_orderkey, l_suppkey, concat('PO', l_orderkey, '-', l_suppkey) as outcome
      from lineitem where l_orderkey % 8 = 3 and l_returnflag <> 'R' group by all),
    winners as (
      select l_orderkey, l_linenumber, arg_max(outcome, l_suppkey) as outcome
      from lineitem join outcomes using (l_orderkey, l_suppkey) group by 1, 2)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(outcome, 'old') as info,
      case when l_orderkey % 8 = 3 then 1 else 0 end::bigint as version
    from lineitem left join winners using (l_orderkey, l_linenumber)""",
)
def write_back_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes for the orders of one partition rewrite that partition; the version says who wrote a row."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.lit("old").alias("info"),
        F.pmod("l_orderkey", F.lit(8)).cast("int").alias("part"),
    )
    sheet = VersionedTable(spark, scratch_path(spark, "sheet"), lines.schema, ["part"])
    base = sheet.create(lines)
    done = sheet.read(base).where("part = 3 and l_returnflag <> 'R'")
    outcomes = done.select("part", "l_orderkey", "l_suppkey").distinct().withColumn(
        "outcome", F.concat(F.lit("PO"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    )

    def put(rows: DataFrame) -> DataFrame:
        return orders.write_back(rows, outcomes, "l_orderkey", "l_linenumber", "l_suppkey")

    sheet.update(put, outcomes, base)
    return sheet.read().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "info", "version")


@query(
    "V8",
    """with old as (select * from orders),
    new as (
      select o_orderkey, o_custkey, case when o_orderkey % 500 = 7 then null else o_orderstatus end as o_orderstatus,
        case when o_orderkey % 500 = 8 then o_totalprice + 1 else o_totalprice end as o_totalprice
      from orders where o_orderkey % 500 <> 9
      union all
      select -o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 500 = 10)
    select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey,
      case when o.o_orderkey is null then 'insert' when n.o_orderkey is null then 'delete' else 'update' end as change,
      case when n.o_orderkey is null then o.o_custkey else n.o_custkey end as o_custkey,
      case when n.o_orderkey is null then o.o_orderstatus else n.o_orderstatus end as o_orderstatus,
      case when n.o_orderkey is null then o.o_totalprice else n.o_totalprice end as o_totalprice
    from old o full join new n on o.o_orderkey = n.o_orderkey
    where o.o_orderkey is null or n.o_orderkey is null
      or o.o_orderstatus is distinct from n.o_orderstatus or o.o_totalprice is distinct from n.o_totalprice""",
)
def changed_by_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Two saved states of the orders, few of which differ; only their buckets are read and joined."""
    old = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    number = F.pmod("o_orderkey", F.lit(500))
    kept = old.where(number != 9).withColumns({
        "o_orderstatus": F.when(number != 7, F.col("o_orderstatus")),
        "o_totalprice": F.when(number == 8, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    })
    new = kept.unionByName(old.where(number == 10).withColumn("o_orderkey", -F.col("o_orderkey")))
    paths = [scratch_path(spark, name) for name in ("old-orders", "new-orders")]
    for path, rows in zip(paths, (old, new)):
        changes.write_digested(rows, path, ["o_orderkey"], buckets=64, groups=8)
    return changes.changed_saved_rows(spark, *paths, ["o_orderkey"], old.schema)


@query(
    "V5",
    """with periods as (
      select s_suppkey, make_date(y, 1 + s_suppkey % 12, 1) as since, make_date(y, 1 + s_suppkey % 12, 1)
          + cast(200 + (s_suppkey * 7 + y) % 200 as integer) as until, s_acctbal > (y - 1996) * 1000 as holds
      from supplier, range(1995, 2002) as r(y)),
    asked as (
      select o_orderkey, o_custkey % (select count(*) from supplier) as s_suppkey, cast(o_orderdate as date) as at from orders)
    select o_orderkey, a.s_suppkey, strftime(p.until, '%Y-%m-%d') as until,
      p.s_suppkey is not null and p.holds and a.at < p.until as qualified
    from asked a asof left join periods p on a.s_suppkey = p.s_suppkey and a.at >= p.since""",
)
def supplier_valid_on(spark: SparkSession, folder: str) -> DataFrame:
    """Was the supplier's qualification valid on the order's date? Each supplier is graded once a year."""
    suppliers = table(spark, folder, "supplier")
    year, month = F.col("y"), (1 + F.col("s_suppkey") % 12).cast("int")
    periods = suppliers.withColumn("y", F.explode(F.sequence(F.lit(1995), F.lit(2001)))).select(
        "s_suppkey", F.make_date(year, month, F.lit(1)).alias("since"),
        F.date_add(F.make_date(year, month, F.lit(1)), (200 + (F.col("s_suppkey") * 7 + year) % 200).cast("int")).alias("until"),
        (F.col("s_acctbal") > (year - 1996) * 1000).alias("holds"),
    )
    asked = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % suppliers.count()).alias("s_suppkey"), F.col("o_orderdate").cast("date").alias("at")
    )
    found = asof.valid_on(asked, periods, ["s_suppkey"], "at", "since", "until", F.col("holds"))
    return found.select("o_orderkey", "s_suppkey", F.col("until").cast("string").alias("until"), "qualified")


TERMS = ["ÉTION DANS", "100%", "Password", "er", "no such words"]


@query(
    "F16",
    "select term, doc_id, lang, n_chars from documents, (values "
    + ", ".join(f"('{t}')" for t in TERMS)
    + ") as t(term) where contains(lower(text), lower(term))",
)
def log_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts searched for several terms; the index names the blocks to read."""
    path = scratch_path(spark, "indexed")
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    search.write_indexed(rows, path, "text", ["lang", "doc_id"], blocks=32)
    found = [
        search.search_indexed(spark, path, "text", term).select(F.lit(term).alias("term"), "doc_id", "lang", "n_chars")
        for term in TERMS
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@query("F15 S6", REGISTRY["decode_output"].sql)
def decode_cut_output(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as console bytes that come in chunks of 61 bytes, cut inside characters."""
    windows = F.col("doc_id") % 2 == 0
    chinese = F.concat(F.lit("脚本输出（中文）："), F.regexp_replace("text", r"[^\x00-\x7F]", "文"))
    rows = table(spark, folder, "documents").select("doc_id", windows.alias("windows"), "text", chinese.alias("chinese"))
    gbk = encode_gbk(F.when(F.col("windows"), F.col("chinese")))
    raw = F.when(F.col("windows"), gbk).otherwise(F.encode("text", "UTF-8"))
    whole = rows.select("doc_id", "windows", raw.alias("whole"))
    last = F.greatest(F.floor((F.length("whole") - 1) / CHUNK_BYTES), F.lit(0)).cast("int")
    chunks = whole.select("doc_id", "windows", "whole", F.explode(F.sequence(F.lit(0), last)).alias("seq")).select(
        "doc_id", "windows", "seq", F.substring("whole", F.col("seq") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("raw")
    )
    decoded = decode_chunks(chunks, "doc_id", "seq")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return decoded.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.array_join("parts.text", "").alias("message"))


def _loose_json() -> Column:
    """Receiving headers as text: some fields null, absent, of another type, or more than known; some no object."""
    odd = F.pmod("o_orderkey", F.lit(9))
    fields = [
        F.when(odd != 1, F.concat(F.lit('"documentNumber": '), F.when(odd == 2, F.col("o_orderkey").cast("string")).otherwise(
            F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))))),
        F.when(odd == 3, F.lit('"totalAmount": null')).when(odd == 4, F.lit('"totalAmount": "many"'))
        .otherwise(F.concat(F.lit('"totalAmount": '), F.col("o_custkey").cast("string"), F.lit(".25"))),
        F.when(odd == 5, F.lit('"items": {}')).when(odd != 6, F.lit('"items": [1, "b"]')),
        F.when(odd == 7, F.lit('"note": {"by": "é"}, "page": 2')),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return F.when(odd == 8, F.when(F.col("o_custkey") % 2 == 0, F.lit("[1]")).otherwise(F.lit('{"documentNumber": '))).otherwise(whole)


@query(
    "F1 S3",
    """with o as (select *, o_orderkey % 9 as odd from orders)
    select o_orderkey, case when odd not in (1, 2, 8) then cast(o_orderkey as varchar) end as number,
      case when odd not in (3, 4, 8) then cast(o_custkey + 0.25 as double) end as amount,
      case odd when 1 then 'documentNumber=absent' when 2 then 'documentNumber=wrong type' when 3 then 'totalAmount=null'
        when 4 then 'totalAmount=wrong type' when 5 then 'items=wrong type' when 6 then 'items=absent'
        when 8 then null else '' end as states,
      case odd when 8 then null when 7 then 'note={"by":"é"},page=2' else '' end as unknown
    from o""",
)
def document_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Null, absent and wrongly typed fields told apart in one parse; unknown fields are kept."""
    raw = table(spark, folder, "orders").select("o_orderkey", _loose_json().alias("raw"))
    kinds = {"documentNumber": "text", "totalAmount": "number", "items": "list"}
    read = variants.read_fields(raw, "raw", kinds)

    def listed(column: str, value) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"], value(e["value"]).alias("value"))))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(column)

    return read.select(
        "o_orderkey", F.col("documentNumber").alias("number"), F.col("totalAmount").cast("double").alias("amount"),
        listed("states", lambda v: v), listed("unknown", F.to_json),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and running quantity of each row of a group, batch by batch."""
    place, quantity = 0, 0
    for batch in batches:
        n = batch.num_rows
        sums = pc.add(pc.cumulative_sum(batch.column("quantity")), quantity)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")],
                pa.array(range(place + 1, place + n + 1), pa.int64()), sums,
            ],
            names=["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "place", "running"],
        )
        if n:
            place, quantity = place + n, sums[n - 1].as_py()


@query(
    "X3",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey,
      row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as place,
      cast(sum(cast(l_quantity as bigint)) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey
        rows unbounded preceding) as bigint) as running
    from lineitem""",
)
def group_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The caller's code walks through a supplier's lines in order, one Arrow batch at a time."""
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity")
    )
    schema = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, place long, running long"
    return hooks.per_group_batches(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], _running, schema)
