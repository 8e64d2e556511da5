"""Lenient reading of JSON: a wrong type gives the default, never an error.

All helpers take a VARIANT column (see ``parse``) and a JSON path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from codeloom.functions.text import strip


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_variant(text: Column) -> Column:
    """VARIANT of the first JSON value of a text, null where there is none.

    Of a repeated key the last value counts, and NaN and the infinities are read (as their
    names).  The session is told here that keys may repeat, since its default loses such
    documents.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.from_json(text, VariantType(), {"allowSingleQuotes": "false"})


def last_of_keys(entries: Column) -> Column:
    """A list of (key, value) with each key once: at its first place, with its last value."""

    def once(all_: Column) -> Column:
        firsts = F.filter(all_, lambda e, n: ~F.exists(F.slice(all_, F.lit(1), n), lambda x: x["key"] == e["key"]))
        return F.transform(firsts, lambda e: F.element_at(F.filter(all_, lambda x: x["key"] == e["key"]), -1))

    return bind(entries, once)


def printed(value: Column) -> Column:
    """Text of a list item: None, True, False, and a fraction keeps its point (1.0)."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(text.isNull(), F.lit("None"))
        .when(kind(value) == "BOOLEAN", F.initcap(text))
        .when(kind(value).isin("DECIMAL", "DOUBLE", "FLOAT") & text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


#: Item which is read after a text; a noncharacter, which no text is meant to hold.
_END = "\ufdd0"


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, null when the text is not exactly one JSON value.

    The built-in parser stops after the first value.  Here it reads a list of the text and
    an end mark: the mark is the second and last item only if the text is one value, and a
    text which closes the list itself never gets to it.  A text with a list that ends in the
    mark itself is not read.
    """
    listed = read_variant(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))

    def only(values: Column) -> Column:
        ended = (text_at(values, "$[1]") == _END) & at(values, "$[2]").isNull()
        return F.when(ended, at(values, "$[0]"))

    return F.when(~F.contains(text, F.lit(f'"{_END}"]')), bind(listed, only))


def kind(value: Column) -> Column:
    """Upper-case head of the variant's type: OBJECT, ARRAY, STRING, BIGINT, ..."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value) == "OBJECT", F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value) == "ARRAY", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def truthy(value: Column) -> Column:
    """False for null, '', 0, false and empty lists and objects; text such as '0' is true."""
    text = F.try_variant_get(value, "$", "string")
    # Only texts which look like an empty value need a look at the type.
    empty_looks = text.rlike(r"^(false|-?0(\.0*)?([eE].*)?|\[\]|\{\})$")
    return (
        F.when(text.isNull() | (text == ""), F.lit(False))
        .when(empty_looks, kind(value) == "STRING")
        .otherwise(F.lit(True))
    )


def truthy_text(value: Column, path: str) -> Column:
    """Text of the value at a path where it is true in the sense of ``truthy``."""
    return F.when(truthy(at(value, path)), text_at(value, path))


def to_int(value: Column, path: str, default: int) -> Column:
    """Integer of a number (truncated), a boolean, or a text of digits; else the default."""
    item = at(value, path)
    text = strip(text_at(value, path))
    number = F.when(is_number(item), F.try_variant_get(item, "$", "double").cast("bigint"))
    boolean = F.when(kind(item) == "BOOLEAN", F.try_variant_get(item, "$", "boolean").cast("bigint"))
    digits = F.when(
        (kind(item) == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")
    )
    return F.coalesce(number, boolean, digits, F.lit(default).cast("bigint"))


def to_float(value: Column, path: str, default: Column) -> Column:
    """Double of a number, boolean or numeric text; else the default."""
    item = at(value, path)
    boolean = F.when(kind(item) == "BOOLEAN", F.try_variant_get(item, "$", "boolean").cast("double"))
    number = F.when(is_number(item), F.try_variant_get(item, "$", "double"))
    text = F.when(kind(item) == "STRING", strip(text_at(value, path)).try_cast("double"))
    return F.coalesce(boolean, number, text, default)


def clean_strings(items: Column) -> Column:
    """Strip every text of an ARRAY<STRING> and drop the blank ones."""
    return F.filter(F.transform(items, strip), lambda s: s != "")


def to_string_list(value: Column, path: str) -> Column:
    """Stripped non-blank strings of a JSON array; a non-array is an empty list.

    Items which are no texts appear in their printed form (None, True, 1.0).
    """
    item = at(value, path)
    texts = F.transform(F.try_variant_get(item, "$", "array<variant>"), printed)
    empty = F.array().cast("array<string>")
    return F.when(is_array(item), F.coalesce(clean_strings(texts), empty)).otherwise(empty)


def to_object_list(value: Column, path: str) -> Column:
    """Objects of a JSON array as ARRAY<VARIANT>; everything else is dropped."""
    item = at(value, path)
    objects = F.filter(F.try_variant_get(item, "$", "array<variant>"), is_object)
    return F.coalesce(F.when(is_array(item), objects), F.array().cast("array<variant>"))


def to_object_json(value: Column, path: str) -> Column:
    """JSON text of an object, ``{}`` for anything else."""
    item = at(value, path)
    return F.when(is_object(item), F.to_json(item)).otherwise(F.lit("{}"))
