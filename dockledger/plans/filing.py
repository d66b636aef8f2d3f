"""Files, forms, value lists and runtimes on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.text import (
    LANGUAGES_COMPILED, file_extension, script_language, split_arguments, upper_all,
)
from dockledger.operators import inventory
from dockledger.plans.registry import query, table


def _name() -> Column:
    """Stand-in file names: some without extension, some hidden, mixed case."""
    lang = F.col("lang")
    return F.concat(
        F.when(lang == "de", F.lit(".")).otherwise(F.lit("doc")),
        F.col("doc_id").cast("string"),
        F.when(lang == "en", F.lit(".PDF")).when(lang == "fr", F.lit(".tar.gz"))
        .otherwise(F.lit("")),
    )


_FILES_SQL = """files as (
      select doc_id, source, n_chars as size,
        case lang when 'en' then '.pdf' when 'fr' then '.gz' else '' end as extension
      from documents)"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "source", _name().alias("fileName"), F.col("n_chars").alias("size")
    )


@query("F23", f"with {_FILES_SQL} select doc_id, extension from files")
def file_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("doc_id", file_extension("fileName").alias("extension"))


@query(
    "A4 F23",
    f"""with {_FILES_SQL}
    select extension, count(*) as files, cast(sum(size) as bigint) as size from files group by 1""",
)
def file_types(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.file_types(_files(spark, folder))


@query(
    "A4",
    f"""with {_FILES_SQL}
    select source, count(*) as total_files, cast(sum(size) as bigint) as total_size
    from files group by 1""",
)
def file_totals(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.file_totals(_files(spark, folder), ["source"])


@query(
    "N4",
    f"""with {_FILES_SQL},
    counted as (select source, extension, count(*) as n from files group by 1, 2)
    select source, count(*) as n_types,
      string_agg(concat(extension, '=', n), ',' order by extension) as file_types
    from counted group by 1""",
)
def file_type_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Maps per source, shown as text."""
    maps = inventory.file_type_maps(_files(spark, folder), ["source"])
    entries = F.transform(
        F.array_sort(F.map_entries("file_types")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return maps.select(
        "source", F.size("file_types").cast("long").alias("n_types"),
        F.array_join(entries, ",").alias("file_types"),
    )


@query(
    "N3",
    """select event_id, 2 as n_fields, 'k' as field, json_extract_string(props, '$.k') as value
      from events
    union all select event_id, 2, 'type', event_type from events""",
)
def form_fields(spark: SparkSession, folder: str) -> DataFrame:
    forms = table(spark, folder, "events").select(
        "event_id",
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("type"), F.col("event_type")),
        ).alias("fields"),
    )
    return inventory.form_fields(forms, ["event_id"])


@query(
    "A5 F10",
    """with placed as (
      select *, row_number() over (partition by p_brand order by p_partkey) as n,
        count(*) over (partition by p_brand) as total_items from part)
    select p_brand, total_items,
      string_agg(upper(p_name), ',' order by p_partkey) as processed_data, 'completed' as status
    from placed group by 1, 2""",
)
def value_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_brand", "p_partkey", "p_name")
    report = inventory.value_report(rows, ["p_brand"], "p_name", ["p_partkey"])
    return report.withColumn("processed_data", F.array_join("processed_data", ","))


@query(
    "F10 F26",
    """select doc_id, len(string_split(text, ' ')) as n_split,
      len(regexp_extract_all(text, '[^ ]*[^\\s][^ ]*')) as n_arguments,
      replace(replace(upper(replace(text, ' ', '|')), 'ß', 'SS'), 'ẞ', 'SS') as shouted
    from documents""",
)
def argument_split(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts split on single spaces, with and without the blank pieces."""
    parts = split_arguments("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.size(parts).cast("long").alias("n_split"),
        F.size(split_arguments("text", True)).cast("long").alias("n_arguments"),
        F.array_join(upper_all(parts), "|").alias("shouted"),
    )


@query(
    "F27",
    """select doc_id, case lang when 'en' then 'python' when 'de' then 'nodejs' end as language,
      case lang when 'en' then 'python' when 'de' then 'nodejs' when 'fr' then 'java' end
        as compiled_language
    from documents""",
)
def file_language(spark: SparkSession, folder: str) -> DataFrame:
    suffix = (
        F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js")
        .when(F.col("lang") == "fr", ".jar").otherwise(".PY")
    )
    path = F.concat(F.col("doc_id").cast("string"), suffix)
    return table(spark, folder, "documents").select(
        "doc_id", script_language(path).alias("language"),
        script_language(path, LANGUAGES_COMPILED).alias("compiled_language"),
    )


# Stand-in inventory: a part is a host; brand and size make its version texts, which end in a
# newline, as a command prints them. Some hosts give blank or empty text, or none.
_HOSTS_SQL = """raw as (
      select p_partkey as host, p_size as v, right(p_brand, 1)::int as minor, p_type, p_partkey % 9 as odd
      from part),
    graded as (
      select host, 'Node.js' as name,
        case when p_type = 'LARGE' or odd = 4 then null else v end as major,
        case when p_type = 'LARGE' then null when odd = 4 then '' else concat('v', v, '.', minor, '.0') end as version,
        case when p_type = 'LARGE' then 'error' when odd <> 4 and v >= 16 then 'success' else 'warning' end as status,
        case when p_type = 'LARGE' then '未找到Node.js，请安装Node.js运行环境'
          when odd = 4 then '无法解析版本号，但Node.js已安装' when v >= 16 then '版本符合要求'
          else concat('建议升级到 Node.js 16+ 以获得更好的性能，当前版本：v', v, '.', minor, '.0') end as message
      from raw
      union all
      select host, 'Python', case when p_type = 'SMALL' or odd = 5 then null when v > 25 then 3 else 2 end,
        case when odd = 5 then '' when p_type = 'SMALL' then 'Python unknown'
          else concat('Python ', case when v > 25 then 3 else 2 end, '.', minor, '.1') end,
        case when odd <> 5 and p_type <> 'SMALL' and v > 25 and minor >= 7 then 'success' else 'warning' end,
        case when odd = 5 or p_type = 'SMALL' then '无法解析版本号，但Python已安装'
          when v > 25 and minor >= 7 then '版本符合要求，使用命令：python3'
          when v > 25 and minor >= 6 then concat('建议升级到Python 3.7+，当前版本：Python 3.', minor, '.1')
          else concat('版本可能不兼容，建议使用Python 3.7+，当前版本：Python ',
            case when v > 25 then 3 else 2 end, '.', minor, '.1') end
      from raw
      union all
      select host, 'Java', case when odd not in (6, 7) then v end,
        case when odd = 7 then null when odd = 6 then 'Java (未知版本)'
          when v < 9 then concat('Java 1.', v, '.0_1') else concat('Java ', v, '.0.2') end,
        case when odd = 7 then 'error' when odd <> 6 and v >= 11 then 'success' else 'warning' end,
        case when odd = 7 then '未找到Java，请安装JDK 11+（需要包含java和javac命令）'
          when odd = 6 then '无法解析Java版本号，但JDK已安装（包含java和javac）'
          when v >= 11 then 'JDK版本符合要求（包含java和javac）'
          when v >= 9 then concat('JDK已安装但建议升级到Java 11+，当前版本：', v, '.0.2')
          when v >= 8 then concat('JDK已安装但建议升级到Java 11+，当前版本：1.', v, '.0_1')
          else concat('JDK版本过低，建议升级到Java 11+，当前版本：1.', v, '.0_1') end
      from raw where p_type <> 'PROMO')"""


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("host"), F.col("p_size").cast("string").alias("v"),
        F.right("p_brand", F.lit(1)).alias("minor"), "p_type",
    )
    odd = F.col("host") % 9
    node = F.when(
        F.col("p_type") != "LARGE",
        F.when(odd == 4, F.lit("  ")).otherwise(F.concat(F.lit("v"), "v", F.lit("."), "minor", F.lit(".0\n"))),
    )
    python = F.when(odd == 5, F.lit("")).when(F.col("p_type") == "SMALL", F.lit("Python unknown\n")).otherwise(
        F.concat(F.lit("Python "), F.when(F.col("v").cast("int") > 25, "3").otherwise("2"),
                 F.lit("."), "minor", F.lit(".1\n"))
    )
    java = F.when(odd == 6, F.lit(" \n")).when(odd == 7, F.lit("")).when(F.col("v").cast("int") < 9, F.concat(F.lit('java version "1.'), "v", F.lit('.0_1"'))) \
        .otherwise(F.concat(F.lit('openjdk version "'), "v", F.lit('.0.2"')))
    texts = part.select(
        "host",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("Node.js").alias("name"), node.alias("raw")),
                    F.struct(F.lit("Python").alias("name"), python.alias("raw")),
                    F.when(F.col("p_type") != "PROMO",
                           F.struct(F.lit("Java").alias("name"), java.alias("raw"))),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    return inventory.grade_runtimes(texts)


@query("F24 F25", f"with {_HOSTS_SQL} select host, name, cast(major as varchar) as major, version, status, message from graded")
def version_grades(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder).select(
        "host", "name", F.col("major").cast("string").alias("major"), "version", "status", "message"
    )


@query(
    "J6",
    f"""with {_HOSTS_SQL}
    select w.host, w.name, g.version, coalesce(g.status, 'error') as status,
      coalesce(g.message, '检查失败') as message
    from (select host, unnest(['Node.js', 'Python', 'Java']) as name from raw) w
    left join graded g on g.host = w.host and g.name = w.name""",
)
def runtime_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every wanted runtime of every host, with what the check says."""
    hosts = table(spark, folder, "part").select(F.col("p_partkey").alias("host"))
    return inventory.runtime_report(_graded(spark, folder), hosts).drop("required")


@query(
    "J6 A7 A8",
    f"""with {_HOSTS_SQL},
    report as (
      select w.host, w.name, w.required, coalesce(g.status, 'error') as status
      from (select host, unnest(['Node.js', 'Python', 'Java']) as name, true as required from raw) w
      left join graded g on g.host = w.host and g.name = w.name)
    select host, count(*) filter (where status = 'error') as critical_issues,
      count(*) filter (where status = 'warning') as warnings, count(*) filter (where status = 'error') = 0 as all_ready,
      case when bool_or(required and status = 'error') then 'error'
        when bool_or(status = 'warning') then 'warning' else 'success' end as overall_status
    from report group by 1""",
)
def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """A runtime that was not found on a host counts as an error there."""
    hosts = table(spark, folder, "part").select(F.col("p_partkey").alias("host"))
    return inventory.readiness(inventory.runtime_report(_graded(spark, folder), hosts))
