"""Readers: tables by file suffix, JSON documents, scan batches, file lists, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger import schemas
from dockledger.sources.workbooks import read_workbooks

CORRUPT = "_corrupt"


class UnsupportedFormat(ValueError):
    """The path does not end in a table format this package reads."""


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, bad: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV files with a header line, their columns taken by name.

    A declared column that the header lacks raises an error, as does a file whose header differs from the first. A
    value that does not fit its type raises an error; with ``bad`` it becomes null and
    that column lists the names of such columns in each row. ``multi_line`` reads cells with
    line breaks, for which a file is read by one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    names = reader.csv(path).columns
    absent = [n for n in schema.names if n not in names]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in the header: {', '.join(names)}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = reader.option("enforceSchema", False).schema(text).csv(path)
    quoted = {f.name: F.col(f"`{f.name}`") for f in schema.fields}
    if bad is None:
        return rows.select(*[quoted[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    wrong = F.array_compact(F.array(*[
        F.when(quoted[f.name].isNotNull() & quoted[f.name].try_cast(f.dataType).isNull(), F.lit(f.name))
        for f in schema.fields
    ]))
    return rows.select(
        *[quoted[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields], wrong.alias(bad)
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, bad: str | None = None
) -> DataFrame:
    """Table at ``path``, chosen by the lower-case text after its last dot.

    csv and json need a schema: inferring one would read all files twice. ``bad`` is as in
    :func:`read_csv`. A path that does not exist raises Spark's own error.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if suffix in ("csv", "json", "xlsx") and schema is None:
        raise ValueError(f"{suffix} needs a declared schema")
    if suffix == "csv":
        return read_csv(spark, path, schema, bad)
    if suffix == "json":
        return spark.read.schema(schema).json(path)
    if suffix == "xlsx":
        return read_workbooks(spark, path, schema)
    raise UnsupportedFormat(f"cannot read '{suffix}' files: use csv, json, parquet or xlsx")


# Columns that give the rows of a sheet the order they have in their file.
SHEET_ORDER = ("src_file", "src_block", "src_row")


def read_sheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A sheet with its row order, as SHEET_ORDER.

    Spark reads blocks of a file in parallel and in any order; file, block and row
    number inside the block put the rows back in line without a sort or a shuffle.
    """
    df = read_table(spark, path, schema)
    if "src_row" in df.columns:  # workbooks number their rows themselves
        return df.select(
            F.col("path").alias("src_file"), F.lit(0).cast("long").alias("src_block"),
            "src_row", *schema.names,
        )
    return df.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        *schema.names,
    )


def read_documents(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.RAW_DOCUMENT,
    multi_line: bool = False,
) -> DataFrame:
    """JSON documents, one per line; ``multi_line`` for indented files of one document.

    Text that is no JSON keeps its row, with the text in the ``_corrupt`` column.
    """
    return (
        spark.read.schema(T.StructType(list(schema.fields)).add(CORRUPT, T.StringType()))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def parse_documents(
    df: DataFrame, text: str, schema: T.StructType = schemas.RAW_DOCUMENT
) -> DataFrame:
    """Document columns from a column of JSON text; other columns are kept.

    Parsed by a generator, so that a later filter on several document columns does
    not copy the parsing into itself once per column.
    """
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.inline(F.array(F.from_json(text, schema))))


def scanned_documents(batches: DataFrame) -> DataFrame:
    """Documents of scan batches. A batch without documents keeps one row of nulls."""
    return batches.select(
        "folderPath", "imagesProcessed", F.explode_outer("documents").alias("_document")
    ).select("folderPath", "imagesProcessed", "_document.*")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Path, size and time of the files in a folder tree; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("timestamp"))
    )


def read_log_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.LOG,
    file_format: str = "json",
    **options: str,
) -> DataFrame:
    """Log events as they arrive in a folder. A Kafka source gives the same columns."""
    return spark.readStream.schema(schema).options(**options).format(file_format).load(path)


def script_results(runs: DataFrame) -> DataFrame:
    """Run records with the error text filled in: stderr, else the exit code.

    A run without exit code was killed or could not start; that is a failure too.
    """
    fallback = F.concat(
        F.lit("exit code: "), F.coalesce(F.col("exit_code").cast("string"), F.lit("null"))
    )
    success = F.col("exit_code") == 0
    error = F.when(F.col("stderr") != "", F.col("stderr")).otherwise(fallback)
    return runs.select(
        "run_id",
        F.coalesce(success, F.lit(False)).alias("success"),
        F.col("stdout").alias("output"),
        F.when(~F.coalesce(success, F.lit(False)), error).alias("error"),
        "execution_ms",
    )
