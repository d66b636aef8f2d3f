"""Column expressions on text, amounts and dates. No Python runs per row here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Totals have cents; quantities and unit prices may be finer.
MONEY = "decimal(18,2)"
NUMBER = "decimal(18,6)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_code(prefix: str, number: Column | str, width: int = 4, suffix: str = "") -> Column:
    """Prefix and zero-padded number. Pads, never cuts: 12345 at width 4 stays 12345."""
    return F.format_string(f"{prefix}%0{width}d{suffix}", _col(number))


def date_stamp(prefix: str, as_of: Column, suffix: str = "") -> Column:
    """Prefix, date as yyyyMMdd, suffix."""
    return F.concat(F.lit(prefix), F.date_format(as_of, "yyyyMMdd"), F.lit(suffix))


def iso_timestamp(at: Column) -> Column:
    """ISO text without zone; microseconds only when there are any."""
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def money_text(amount: Column | str, sign: str = "¥") -> Column:
    """Amount with thousands separators and two decimals, after the currency sign."""
    return F.concat(F.lit(sign), F.format_number(_col(amount), 2))


def upper_all(values: Column | str) -> Column:
    """Every element of a list in upper case."""
    return F.transform(_col(values), lambda x: F.upper(x))


def whole_number_text(value: Column | str) -> Column:
    """Identifier as whole-number text: '1000314270.0' gives '1000314270'.

    Cuts toward zero. Decimal, so identifiers beyond 2^53 keep all digits; text
    that is not a number gives null.
    """
    wide = _col(value).cast("string").try_cast("decimal(38,10)")
    cut = F.when(wide < 0, F.ceil(wide)).otherwise(F.floor(wide))
    return cut.cast("string")


def first_number(text: Column | str) -> Column:
    """First run of decimal digits as bigint, full-width and Arabic ones included.

    Null when there is none or it does not fit.
    """
    digits = F.regexp_extract(_col(text), r"(?U)(\d+)", 1)
    ascii_digits = F.translate(
        digits, "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 3
    )
    return ascii_digits.try_cast("bigint")


# The Unicode white space characters and the ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    """Remove white space of any script at both ends, ideographic space included."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def parse_amount(text: Column | str) -> Column:
    """'1,234.50' as a decimal; null when it is not an amount."""
    return F.replace(strip(text), F.lit(","), F.lit("")).try_cast(MONEY)


def exact_number(text: Column | str) -> Column:
    """Text as a decimal of :data:`NUMBER`; null when it is no number or has digits that would be lost."""
    text = _col(text)
    number, point = text.try_cast(NUMBER), F.instr(text, F.lit("."))
    short = ((point == 0) | (F.length(text) - point <= 6)) & ~F.contains(F.lower(text), F.lit("e"))
    return F.when(short, number).when(text.try_cast("decimal(38,18)") == number, number)


def contains_ignoring_case(text: Column | str, term: str) -> Column:
    """Literal search: '%' and '_' mean themselves; an empty term matches all text."""
    return F.contains(F.lower(_col(text)), F.lower(F.lit(term)))


def log_level(channel: Column | str, exit_code: Column | str) -> Column:
    """Level of a line from where it came: stdout, stderr, close (with code), kill."""
    channel, code = _col(channel), _col(exit_code)
    return (
        F.when(channel == "stdout", F.lit("INFO"))
        .when(channel == "stderr", F.lit("ERROR"))
        .when(channel == "kill", F.lit("WARNING"))
        .when((channel == "close") & (code == 0), F.lit("SUCCESS"))
        .when(channel == "close", F.lit("ERROR"))
    )


def step_prefix(label: Column | str, message: Column | str) -> Column:
    """'[label] message', or the bare message when there is no label."""
    label = _col(label)
    return F.concat(
        F.when(label.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), label, F.lit("] "))),
        _col(message),
    )


def log_line(at: Column | str, level: Column | str, message: Column | str) -> Column:
    """Export form of a log entry: '[time] LEVEL: message'."""
    return F.concat(
        F.lit("["), F.date_format(_col(at), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "),
        _col(level), F.lit(": "), _col(message),
    )


# What to blank out in a log message, pattern to replacement.
REDACTIONS: Mapping[str, str] = {
    r"(--password[\s=]+)\S+": "$1***",
    r"(?i)((?:password|passwd|token|secret)\s*[:=]\s*)\S+": "$1***",
}


def redact(message: Column | str, rules: Mapping[str, str] = REDACTIONS) -> Column:
    out = _col(message)
    for pattern, replacement in rules.items():
        out = F.regexp_replace(out, pattern, replacement)
    return out


def file_extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; '' for none or a name that only starts with one."""
    return F.lower(F.regexp_extract(_col(path), r"(?<=[^/])(\.[^./]*)$", 1))


def last_suffix(path: Column | str) -> Column:
    """Lower-case text after the last dot: the format name of a table file."""
    return F.lower(F.element_at(F.split(_col(path), "[.]"), -1))


# Case-sensitive file suffix to script language.
LANGUAGES = {".py": "python", ".js": "nodejs", ".java": "java"}
LANGUAGES_COMPILED = {".py": "python", ".js": "nodejs", ".jar": "java", ".class": "java"}


def script_language(path: Column | str, suffixes: Mapping[str, str] = LANGUAGES) -> Column:
    out = F.lit(None).cast("string")
    for suffix, language in reversed(suffixes.items()):
        out = F.when(F.endswith(_col(path), F.lit(suffix)), F.lit(language)).otherwise(out)
    return out


def split_arguments(args: Column | str, drop_blank: bool = False) -> Column:
    """Split on single spaces; ``drop_blank`` also removes empty arguments.

    No text at all gives an empty list.
    """
    args = _col(args)
    parts = F.split(args, " ")
    if drop_blank:
        parts = F.filter(parts, lambda x: x.rlike(r"(?U)\S"))
    return F.when(F.coalesce(F.length(args), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(parts)


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MILLISECOND", _col(start), _col(end))


def usage_band(usage: Column | str) -> Column:
    usage = _col(usage)
    return F.when(usage < 50, "success").when(usage < 80, "warning").otherwise("error")


def percent_text(value: Column | str) -> Column:
    """One decimal and a percent sign, rounded by the exact binary value; ties go up.

    format_string alone rounds the printed digits: it makes 178.4 of 178.35, which as
    a double lies below the tie. Ten times the value is taken as product plus its
    rounding error (the value split into two short halves), so the tie is exact.
    """
    x = F.abs(_col(value).cast("double"))
    big = x * 134217729.0
    high = big - (big - x)
    tenths = x * 10.0
    error = (high * 10.0 - tenths) + (x - high) * 10.0
    whole = F.floor(tenths)
    rounded = whole + F.when((tenths - whole) + error >= 0.5, 1).otherwise(0)
    signed = F.when(_col(value) < 0, -rounded).otherwise(rounded)
    return F.format_string("%.1f%%", signed / 10.0)


def outcome_rule(message: Column, rules: Sequence[tuple[str, object]], otherwise) -> Column:
    """First rule whose phrase the message contains."""
    out = otherwise
    for phrase, result in reversed(list(rules)):
        value = result if isinstance(result, Column) else F.lit(result)
        out = F.when(F.contains(message, F.lit(phrase)), value).otherwise(out)
    return out
