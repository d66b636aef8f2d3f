"""JSON of unsure shape, parsed once: which fields are there, null, or of another type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What schema_of_variant says of a value of each kind.
KINDS = {
    "text": "STRING", "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL).*", "flag": "BOOLEAN",
    "list": "ARRAY<.*", "object": "OBJECT<.*",
}
_TYPES = {"text": "string", "number": "decimal(38,18)", "flag": "boolean", "list": "variant", "object": "variant"}


def parse_once(df: DataFrame, text: str, column: str = "document") -> DataFrame:
    """Rows with their text as a variant; null where the text is no JSON.

    The parser is a generator, so that conditions on the variant do not parse again.
    """
    return df.select("*", F.explode(F.array(F.try_parse_json(text))).alias(column))


def field_state(document: Column, name: str, kind: str) -> Column:
    """ok, absent, null or wrong type; null for a document that is no object."""
    value = F.try_variant_get(document, _path(name), "variant")
    return (
        F.when(~_is_object(document), F.lit(None).cast("string"))
        .when(value.isNull(), F.lit("absent"))
        .when(F.is_variant_null(value), F.lit("null"))
        .when(F.schema_of_variant(value).rlike(f"^{KINDS[kind]}$"), F.lit("ok"))
        .otherwise(F.lit("wrong type"))
    )


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _is_object(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(document).startswith("OBJECT<"), F.lit(False))


def read_fields(df: DataFrame, text: str, kinds: Mapping[str, str], states: str = "states", unknown: str = "unknown") -> DataFrame:
    """Rows with one column for each named field, what is wrong with each, and all other fields.

    ``kinds`` gives text, number, flag, list or object for each name. A field of its kind is typed: text stays as it is,
    a number has 18 places, lists and objects stay variants. Otherwise it is null and ``states``, a map of
    name to absent, null or wrong type, tells why. ``unknown`` is a map of the other fields' variants.
    Text that is no JSON object has ``states`` and ``unknown`` null.
    """
    (document,) = [c for c in ("_document", "__document") if c not in df.columns][:1]
    parsed = parse_once(df, text, document)
    whole = F.col(document)
    state = {name: field_state(whole, name, kind) for name, kind in kinds.items()}
    typed = [
        F.when(state[name] == "ok", F.try_variant_get(whole, _path(name), _TYPES[kind])).alias(name)
        for name, kind in kinds.items()
    ]
    wrong = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(n) for n in kinds]), F.array(*state.values())), lambda n, s: s != "ok"
    )
    others = F.map_filter(
        F.when(_is_object(whole), whole).cast("map<string,variant>"), lambda n, v: ~n.isin(list(kinds))
    )
    kept = [c for c in df.columns if c not in (*kinds, states, unknown)]
    return parsed.select(
        *kept, *typed, F.when(_is_object(whole), wrong).alias(states), others.alias(unknown)
    )
