"""Column functions on the values that go wrong easily."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dockledger.functions import text, versions
from dockledger.functions import decode
from dockledger.functions.decode import decode_output, encode_gbk


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.repartition(2).select(fn("v").alias("out"), "i").orderBy("i").select("out").collect()]


def test_codes_pad_and_never_cut(spark):
    assert values(spark, lambda c: text.padded_code("MAT", c), [1, 12345], "int") == ["MAT0001", "MAT12345"]


def test_whole_numbers(spark):
    got = values(spark, text.whole_number_text,
                 ["1000314270.0", "-3.9", "3.9", "9007199254740993", "0.5", "-0.5", "x", None])
    assert got == ["1000314270", "-3", "3", "9007199254740993", "0", "0", None, None]


def test_first_number(spark):
    got = values(spark, text.first_number, ["dafdsafdsa1000314270采购申请号9", "没有", "编号１２３x", "٤٢", None])
    assert got == [1000314270, None, 123, 42, None]


def test_strip_all_white_space(spark):
    assert values(spark, text.strip, ["　\t 上海 电力 　\n", "a", ""]) == ["上海 电力", "a", ""]
    inputs = [f"{chr(c)}é{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert values(spark, text.strip, inputs) == [i.strip() for i in inputs]


def test_amounts(spark):
    assert [None if v is None else float(v) for v in values(spark, text.parse_amount, [" 1,234,567.50 ", "12", "n/a"])] == [
        1234567.5, 12.0, None]
    assert values(spark, text.money_text, [77450.0, 0.125, 2.675, -1234.5], "double") == [
        "¥77,450.00", "¥0.12", "¥2.67", "¥-1,234.50"]


def test_search_is_literal(spark):
    inputs = ["100% done", "100 done", "A_B", "axb", "ÉTION", "上海电力"]
    def hits(term):
        return values(spark, lambda c: text.contains_ignoring_case(c, term), inputs)
    assert hits("%") == [True, False, False, False, False, False]
    assert hits("a_b") == [False, False, True, False, False, False]
    assert hits("étion")[4] and hits("电力")[5] and all(hits(""))


def test_levels(spark):
    df = spark.createDataFrame(
        [("stdout", None), ("stderr", None), ("close", 0), ("close", 2), ("close", None), ("kill", None)],
        "channel string, code int")
    assert [r[0] for r in df.select(text.log_level("channel", "code")).collect()] == [
        "INFO", "ERROR", "SUCCESS", "ERROR", "ERROR", "WARNING"]


def test_prefix_and_line(spark):
    df = spark.sql("select timestamp'2024-10-21 14:30:00.5' ts, 'INFO' level, 'm' message, 'L' label")
    assert df.select(text.step_prefix("label", "message")).first()[0] == "[L] m"
    assert df.select(text.step_prefix(F.lit(None).cast("string"), "message")).first()[0] == "m"
    assert df.select(text.log_line("ts", "level", "message")).first()[0] == "[2024-10-21 14:30:00.500] INFO: m"


def test_iso_time(spark):
    df = spark.sql("select timestamp'2024-10-21 14:30:00' a, timestamp'2024-10-21 14:30:00.5' b")
    assert df.select(text.iso_timestamp(F.col("a")), text.iso_timestamp(F.col("b"))).first()[:] == (
        "2024-10-21T14:30:00", "2024-10-21T14:30:00.500000")


def test_version_texts(spark):
    df = spark.createDataFrame(
        [("Java", 'openjdk version "17.0.1" x'), ("Java", "jdk"), ("Python", "Python 3.7.0 "), ("Java", None),
         ("Node.js", "v18.2.0\n"), ("Python", ""), ("Node.js", "  "), ("Java", " "), ("Java", "")],
        "name string, raw string")
    assert [r[0] for r in df.select(versions.version_text(F.col("name"), F.col("raw"))).collect()] == [
        "Java 17.0.1", "Java (未知版本)", "Python 3.7.0", None, "v18.2.0", "", "", "Java (未知版本)", None]


def test_redaction(spark):
    got = values(spark, text.redact, ["run --user u --password abc end", "token=xyz x", "password: q, ok", "plain"])
    assert got == ["run --user u --password *** end", "token=*** x", "password: *** ok", "plain"]


def test_extensions(spark):
    got = values(spark, text.file_extension, ["a.TXT", "a.tar.gz", ".bashrc", "a.", "dir.x/none", "dir/.hid", "a/b.Yml"])
    assert got == [".txt", ".gz", "", ".", "", "", ".yml"]
    assert values(spark, text.last_suffix, ["a/b.XLSX", "t.csv"]) == ["xlsx", "csv"]


def test_languages(spark):
    assert values(spark, text.script_language, ["a.py", "a.js", "A.java", "a.PY", "a.jar"]) == [
        "python", "nodejs", "java", None, None]
    compiled = lambda c: text.script_language(c, text.LANGUAGES_COMPILED)
    assert values(spark, compiled, ["a.jar", "a.class", "a.java"]) == ["java", "java", None]


def test_arguments(spark):
    inputs = ["a  b ", "", "  ", None, "x"]
    assert values(spark, text.split_arguments, inputs) == [["a", "", "b", ""], [], ["", "", ""], [], ["x"]]
    blank = lambda c: text.split_arguments(c, True)
    assert values(spark, blank, inputs) == [["a", "b"], [], [], [], ["x"]]


def test_usage(spark):
    assert values(spark, text.usage_band, [49.99, 50.0, 79.9, 80.0], "double") == [
        "success", "warning", "warning", "error"]
    assert values(spark, text.percent_text, [178.35, 0.25, 0.05, 99.95, 3.0, -0.25, 1e9 + 0.15], "double") == [
        "178.3%", "0.3%", "0.1%", "100.0%", "3.0%", "-0.3%", "1000000000.1%"]


def test_upper_all(spark):
    assert values(spark, text.upper_all, [["apple", "été"], []], "array<string>") == [["APPLE", "ÉTÉ"], []]


def test_decoding(spark):
    df = spark.createDataFrame([("变压器 a",), (None,)], "t string")
    back = df.select(decode_output(encode_gbk(F.col("t")), F.lit(True)))
    assert [r[0] for r in back.collect()] == ["变压器 a", None]
    back = df.select(decode_output(F.encode("t", "UTF-8"), F.lit(False)))
    assert [r[0] for r in back.collect()] == ["变压器 a", None]
    bad = df.select(decode_output(F.unhex(F.lit("41FF")), F.lit(True)))
    assert bad.first()[0] == "A�"


@pytest.mark.parametrize("name, raw, major, status", [
    ("Node.js", "v18.2.0", 18, "success"), ("Node.js", "v14.0.0", 14, "warning"),
    ("Node.js", "nonsense", None, "warning"), ("Python", "Python 3.7.0", 3, "success"),
    ("Python", "Python 3.6.9", 3, "warning"), ("Python", "Python 2.7.18", 2, "warning"),
    ("Python", "Python 4.9.0", 4, "warning"), ("Java", 'java version "1.8.0_291"', 8, "warning"),
    ("Java", 'openjdk version "17.0.1"', 17, "success"), ("Java", 'version "11"', 11, "success"),
    ("Java", None, None, "error"), ("Node.js", "", None, "warning"), ("Node.js", None, None, "error"),
    ("Python", "", None, "warning"), ("Java", "", None, "error"), ("Java", " ", None, "warning"),
])
def test_versions(spark, name, raw, major, status):
    df = spark.createDataFrame([(name, raw)], "name string, raw string")
    got = df.select(versions.major_version(F.col("name"), F.col("raw")),
                    versions.version_grade(F.col("name"), F.col("raw"))).first()
    assert tuple(got) == (major, status)


def test_few_values_are_python_objects_at_a_time():
    most, alive = 0, []

    def convert(text):
        nonlocal most
        alive.append(text)
        return text.encode("gbk")

    class Counted:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, start, length):
            nonlocal most
            part = self.values.slice(start, length)
            most = max(most, len(part))
            return part

    values = pa.array(["变", None, "", "a"] * 500)
    got = decode._converted(Counted(values), convert, pa.binary())
    assert got.to_pylist() == [None if v is None else v.encode("gbk") for v in values.to_pylist()]
    assert most == decode._FEW and len(alive) == 1500
    assert decode._converted(values.slice(0, 0), convert, pa.binary()).to_pylist() == []
