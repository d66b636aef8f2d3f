"""Runtime versions: parse the printed text, grade it against the wanted minimum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockledger.functions.text import strip

# Version text patterns and the lowest good versions.
NODE_PATTERN = r"v(\d+)\.(\d+)\.(\d+)"
PYTHON_PATTERN = r"Python (\d+)\.(\d+)\.(\d+)"
JAVA_PATTERN = r'version "([^"]+)"'
NODE_MINIMUM = 16
PYTHON_MINIMUM = (3, 7)
JAVA_MINIMUM = 11
# Messages shown with a grade.
NOT_CHECKED = "检查失败"
GOOD = "版本符合要求"
GOOD_PYTHON = "版本符合要求，使用命令："
GOOD_JAVA = "JDK版本符合要求（包含java和javac）"
OLD_NODE = "建议升级到 Node.js 16+ 以获得更好的性能，当前版本："
OLD_PYTHON = "建议升级到Python 3.7+，当前版本："
OTHER_PYTHON = "版本可能不兼容，建议使用Python 3.7+，当前版本："
OLD_JAVA = "JDK已安装但建议升级到Java 11+，当前版本："
OLDER_JAVA = "JDK版本过低，建议升级到Java 11+，当前版本："
UNREADABLE_NODE = "无法解析版本号，但Node.js已安装"
UNREADABLE_PYTHON = "无法解析版本号，但Python已安装"
UNREADABLE_JAVA = "无法解析Java版本号，但JDK已安装（包含java和javac）"
ABSENT_NODE = "未找到Node.js，请安装Node.js运行环境"
ABSENT_PYTHON = "未找到Python（尝试了python3和python命令）"
ABSENT_JAVA = "未找到Java，请安装JDK 11+（需要包含java和javac命令）"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def major_version(name: Column, raw: Column) -> Column:
    """Major version; null when the text does not parse. Java 1.x counts as x."""
    java = F.regexp_extract(raw, JAVA_PATTERN, 1)
    java_major = F.when(java.startswith("1."), _number(java, r"^1\.(\d+)", 1)).otherwise(
        _number(java, r"^(\d+)", 1)
    )
    return (
        F.when(name == "Node.js", _number(raw, NODE_PATTERN, 1))
        .when(name == "Python", _number(raw, PYTHON_PATTERN, 1))
        .when((name == "Java") & (java != ""), F.coalesce(java_major, F.lit(0)))
    )


def minor_version(name: Column, raw: Column) -> Column:
    """Minor version of Node.js and Python; null otherwise."""
    return F.when(name == "Node.js", _number(raw, NODE_PATTERN, 2)).when(
        name == "Python", _number(raw, PYTHON_PATTERN, 2)
    )


def version_text(name: Column, raw: Column) -> Column:
    """Version as shown: the stripped text; for Java its name and quoted version.

    Null where the runtime is absent.
    """
    java = F.regexp_extract(raw, JAVA_PATTERN, 1)
    shown = F.when(
        name == "Java", F.concat(F.lit("Java "), F.when(java != "", java).otherwise("(未知版本)"))
    ).otherwise(strip(raw))
    return F.when(~absent(name, raw), shown)


def absent(name: Column, raw: Column) -> Column:
    """Whether the command gave nothing: no text at all, for Java an empty one too.

    White space counts as output that cannot be read.
    """
    return raw.isNull() | ((name == "Java") & (raw == ""))


def version_message(name: Column, raw: Column, command: str = "python3") -> Column:
    """What the check says about a runtime; ``command`` is the Python command that answered."""
    major, minor = major_version(name, raw), minor_version(name, raw)
    shown = strip(raw)
    java = F.regexp_extract(raw, JAVA_PATTERN, 1)
    node = (
        F.when(raw.isNull(), F.lit(ABSENT_NODE)).when(major.isNull(), F.lit(UNREADABLE_NODE))
        .when(major >= NODE_MINIMUM, F.lit(GOOD)).otherwise(F.concat(F.lit(OLD_NODE), shown))
    )
    python = (
        F.when(raw.isNull(), F.lit(ABSENT_PYTHON)).when(major.isNull(), F.lit(UNREADABLE_PYTHON))
        .when((major == 3) & (minor >= PYTHON_MINIMUM[1]), F.lit(GOOD_PYTHON + command))
        .when((major == 3) & (minor >= 6), F.concat(F.lit(OLD_PYTHON), shown))
        .otherwise(F.concat(F.lit(OTHER_PYTHON), shown))
    )
    jdk = (
        F.when(absent(name, raw), F.lit(ABSENT_JAVA)).when(java == "", F.lit(UNREADABLE_JAVA))
        .when(major >= JAVA_MINIMUM, F.lit(GOOD_JAVA))
        .when(major >= 8, F.concat(F.lit(OLD_JAVA), java)).otherwise(F.concat(F.lit(OLDER_JAVA), java))
    )
    return F.when(name == "Node.js", node).when(name == "Python", python).when(name == "Java", jdk)


def version_grade(name: Column, raw: Column) -> Column:
    """success, warning (too old or not readable) or error (not there)."""
    major, minor = major_version(name, raw), minor_version(name, raw)
    good = (
        F.when(name == "Node.js", major >= NODE_MINIMUM)
        .when(name == "Python", (major == PYTHON_MINIMUM[0]) & (minor >= PYTHON_MINIMUM[1]))
        .when(name == "Java", major >= JAVA_MINIMUM)
    )
    return (
        F.when(absent(name, raw), F.lit("error"))
        .when(good, F.lit("success"))
        .otherwise(F.lit("warning"))
    )
