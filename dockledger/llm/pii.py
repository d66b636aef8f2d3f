"""Personal data in texts: patterns propose, checksums confirm, context words adjust.

Built-in functions only. Positions are code points; a match's position is the summed length
of the pieces and matches before it, with the text split by the same pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base kinds. Look-behinds and possessive quantifiers leave the
# matches as they are and keep the search linear in texts with long runs.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Code points read before and after a match for context words.
BEFORE, AFTER = 40, 20


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn checksum."""
    digits = F.filter(F.split(F.reverse(_digits(match)), ""), lambda d: d != "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number in IBAN form leaves 1 on division by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.char_length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of span. A match that ``check`` refuses is dropped. The others score ``prior``, plus
    ``bonus`` where a context word stands near, and count from the threshold on."""

    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    prior: float
    bonus: float = 0.2
    context: str = r"(?!)"


BASE = (
    Kind("email", EMAIL, "@", lambda m: F.lit(True), 0.9, 0.1, r"(?i)mail|contact"),
    Kind("ip", IP, "[0-9]", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.7, 0.2, r"(?i)\bip\b|host|server"),
    Kind("card", CARD, "[0-9]", luhn, 0.8, 0.2, r"(?i)card|visa|credit"),
    Kind("phone", PHONE, r"\+", lambda m: F.char_length(_digits(m)).between(10, 15), 0.7, 0.2, r"(?i)phone|call|tel"),
)
MORE = (
    Kind("iban", IBAN, "[0-9]", mod97, 0.9, 0.1, r"(?i)iban|account|konto"),
    Kind(
        "ssn", SSN, "[0-9]", lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0.4, 0.4,
        r"(?i)\bssn\b|social security",
    ),
    Kind(
        "secret", SECRET, "[0-9]", lambda m: m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), 0.3, 0.5,
        r"(?i)token|secret|passw|api.?key",
    ),
)
THRESHOLD = 0.6


def _ends(step: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """Add where each match ends: prefix sums in blocks of about the root of their number.

    Arrays that a function reads by position are columns of their own, so that none is made
    again for every element.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    block = {k.name: F.greatest(F.ceil(F.sqrt(F.size(f"__m_{k.name}"))), F.lit(1)).cast("int") for k in kinds}
    step = step.select("*", *[
        F.transform(
            F.arrays_zip(F.slice(f"__p_{k.name}", 1, F.size(f"__m_{k.name}")).alias("p"), F.col(f"__m_{k.name}").alias("m")),
            lambda z: F.char_length(z["p"]) + F.char_length(z["m"]),
        ).alias(f"__l_{k.name}")
        for k in kinds
    ])

    def bases(k: Kind) -> Column:
        def add(acc: Column, b: Column) -> Column:
            inside = F.slice(f"__l_{k.name}", b * block[k.name] + 1, block[k.name])
            return F.concat(acc, F.array(F.element_at(acc, -1) + total(inside)))

        blocks = F.ceil(F.size(f"__m_{k.name}") / block[k.name]).cast("int")
        return F.aggregate(F.sequence(F.lit(0), blocks), F.array(F.lit(0)), add)

    step = step.select("*", *[bases(k).alias(f"__b_{k.name}") for k in kinds])

    def end(k: Kind) -> Column:
        def at(_: Column, i: Column) -> Column:
            b = F.floor(i / block[k.name]).cast("int")
            inside = F.slice(f"__l_{k.name}", b * block[k.name] + 1, i - b * block[k.name] + 1)
            return F.get(f"__b_{k.name}", b) + total(inside)

        return F.transform(f"__m_{k.name}", at)

    return step.select("*", *[
        F.when(F.size(f"__m_{k.name}") > 0, end(k)).otherwise(F.array().cast("array<int>")).alias(f"__e_{k.name}")
        for k in kinds
    ])


def find_spans(
    docs: DataFrame, kinds: Sequence[Kind] = BASE + MORE, always: int = len(BASE), text: str = "text",
    out: str = "spans",
) -> DataFrame:
    """Add the spans of each text: an array of (start, kind, end, score), sorted.

    Context words are looked for between a match and its neighbours of the same kind.
    Matches of a kind are leftmost and do not overlap; ``kind`` is the position in ``kinds``.
    Spans of the first ``always`` kinds stay whatever they score, those of the others need
    THRESHOLD. A null or empty text has none. Equal and repeated rows are searched each. A column
    called like ``out`` is replaced, all others stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    hints = list(dict.fromkeys(k.hint for k in kinds))
    # The caller's columns are one struct meanwhile, so that no name can clash.
    step = docs.select(F.struct(*docs.drop(out).columns).alias("__row"), body.alias("__t"))
    step = step.select("*", *[F.col("__t").rlike(h).alias(f"__h{i}") for i, h in enumerate(hints)])
    step = step.select("*", *[
        F.when(F.col(f"__h{hints.index(k.hint)}"), F.regexp_extract_all("__t", F.lit(k.pattern), F.lit(0)))
        .otherwise(none).alias(f"__m_{k.name}")
        for k in kinds
    ])
    step = step.select("*", *[
        F.when(F.size(f"__m_{k.name}") > 0, F.split("__t", k.pattern, -1)).otherwise(none).alias(f"__p_{k.name}")
        for k in kinds
    ])
    step = _ends(step, kinds)

    def spans(n: int, k: Kind) -> Column:
        def span(m: Column, i: Column) -> Column:
            left = F.get(f"__p_{k.name}", i)
            near = F.substr(left, F.greatest(F.char_length(left) - BEFORE + 1, F.lit(1))).rlike(k.context) | F.left(
                F.get(f"__p_{k.name}", i + 1), F.lit(AFTER)
            ).rlike(k.context)
            score = F.lit(k.prior) + F.when(near, F.lit(k.bonus)).otherwise(F.lit(0.0))
            end = F.get(f"__e_{k.name}", i)
            kept = k.check(m) & (F.lit(n < always) | (score >= THRESHOLD))
            return F.when(kept, F.struct(
                (end - F.char_length(m)).alias("start"), F.lit(n).alias("kind"), end.alias("end"), score.alias("score")
            ))

        return F.filter(F.transform(f"__m_{k.name}", span), lambda s: s.isNotNull())

    found = F.array_sort(F.concat(*[spans(n, k) for n, k in enumerate(kinds)]))
    # A generator: a filter on the spans, pushed through plain projections, would repeat the searches.
    return step.select("__row", F.inline(F.array(F.struct(found.alias(out))))).select("__row.*", out)


def span_text(spans: Column, kinds: Sequence[Kind] = BASE + MORE) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    ))


def mask(docs: DataFrame, text: str = "text", spans: str = "spans", kinds: Sequence[Kind] = BASE + MORE) -> DataFrame:
    """The text with each span replaced by its kind in brackets; a span inside one before it goes with that."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    body = F.coalesce(F.col(text), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(
            acc["text"], F.substr(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
            F.lit("["), F.get(names, s["kind"]), F.lit("]"),
        )
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(s["end"], acc["at"]).alias("at"), F.when(inside, acc["text"]).otherwise(new).alias("text")
        )

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["text"], F.substr(body, a["at"] + 1)))
    return docs.withColumn(text, done)


def personal_data(docs: DataFrame) -> DataFrame:
    """How many spans of each base kind a document has, their digest, and all spans."""
    found = find_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def of(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")

    return found.select(
        "doc_id",
        *[of(n).alias(f"n_{k.name}") for n, k in enumerate(BASE)],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
