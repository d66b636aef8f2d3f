"""Small summaries: runtimes of hosts, file types, form fields, value lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions.text import file_extension, upper_all
from dockledger.functions.versions import (
    NOT_CHECKED, major_version, version_grade, version_message, version_text,
)
from dockledger.operators.skew import collect_parts, hot_keys, positions

# Runtimes every host is checked for, and whether it must have them.
RUNTIMES = (("Node.js", True), ("Python", True), ("Java", True))


def grade_runtimes(inventory: DataFrame) -> DataFrame:
    """Inventory rows with their version as shown, major version, grade and message."""
    name, raw = F.col("name"), F.col("raw")
    return inventory.withColumns(
        {
            "version": version_text(name, raw),
            "major": major_version(name, raw),
            "status": version_grade(name, raw),
            "message": version_message(name, raw),
        }
    )


def runtime_report(
    graded: DataFrame, hosts: DataFrame, runtimes: Sequence[tuple[str, bool]] = RUNTIMES
) -> DataFrame:
    """One row per host and wanted runtime with version, status and message.

    A runtime with no result is an error. Of several results the least text counts.
    """
    wanted = hosts.select("host").distinct().select(
        "host",
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("name"), F.lit(r).alias("required")) for n, r in runtimes
        ])),
    )
    result = F.struct("version", "status", "message")
    # A result without any text must count too, so the order is a struct, which is never null.
    found = graded.groupBy("host", "name").agg(F.min_by(result, F.struct("raw")).alias("_found"))
    return wanted.join(found, ["host", "name"], "left").select(
        "host", "name", "required", "_found.version",
        F.coalesce("_found.status", F.lit("error")).alias("status"),
        F.coalesce("_found.message", F.lit(NOT_CHECKED)).alias("message"),
    )


def readiness(report: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Errors, warnings and readiness of a host; overall status counts required errors only."""
    error, warning = F.col("status") == "error", F.col("status") == "warning"
    return report.groupBy(*keys).agg(
        F.count_if(error).alias("critical_issues"),
        F.count_if(warning).alias("warnings"),
        (F.count_if(error) == 0).alias("all_ready"),
        F.when(F.bool_or(F.col("required") & error), F.lit("error"))
        .when(F.bool_or(warning), F.lit("warning"))
        .otherwise(F.lit("success"))
        .alias("overall_status"),
    )


def file_types(files: DataFrame, keys: Sequence[str] = (), name: str = "fileName") -> DataFrame:
    """Files and bytes per extension."""
    return (
        files.groupBy(*keys, file_extension(name).alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    )


def file_totals(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )


def file_type_maps(
    files: DataFrame, keys: Sequence[str], name: str = "fileName", max_entries: int | None = None
) -> DataFrame:
    """Extension to count as one map per key; with ``max_entries`` in maps numbered by ``part``."""
    # A key has no more extensions than files, so a key that is not hot in the
    # files is not hot among the extensions either.
    hot = hot_keys(files, keys)
    numbered = positions(file_types(files, keys, name), keys, ["extension"], "_pos", hot=hot)
    parts = collect_parts(numbered, keys, "_pos", ["extension", "files"], "_items", max_entries)
    entries = F.transform("_items", lambda x: F.struct(x["extension"], x["files"]))
    part = [] if max_entries is None else ["part"]
    return parts.select(*keys, *part, F.map_from_entries(entries).alias("file_types"))


def form_fields(forms: DataFrame, keys: Sequence[str], fields: str = "fields") -> DataFrame:
    """One row per field of a form, with the field count of the form."""
    return forms.select(
        *keys, F.size(fields).alias("n_fields"), F.explode(fields).alias("field", "value")
    )


def value_report(
    values: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], max_items: int | None = None
) -> DataFrame:
    """Count and upper-cased list of the values of each key, in order.

    With ``max_items`` a key gives lists of at most so many values, numbered by
    ``part``; ``total_items`` is the count of the whole key in each of them.
    """
    numbered = positions(values, keys, order, "_pos", "total_items")
    parts = collect_parts(numbered, [*keys, "total_items"], "_pos", [value], "_items", max_items)
    part = [] if max_items is None else ["part"]
    return parts.select(
        *keys, *part, "total_items",
        upper_all(F.transform("_items", lambda x: x[value])).alias("processed_data"),
        F.lit("completed").alias("status"),
    )
