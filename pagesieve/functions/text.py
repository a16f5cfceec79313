"""Markup text helpers: entities, whitespace, type coercion, presence."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENTS = r"<!--[\s\S]*?-->"
_RAW_BLOCKS = r"(?i)<(script|style)\b[^>]*>[\s\S]*?</\1\s*>"
_TAGS = r"<[^>]*>"


def without_code(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, _COMMENTS, ""), _RAW_BLOCKS, "")


def collapse(text: Column) -> Column:
    """Runs of blanks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _entity_table() -> Column:
    """Named references as one literal map (folded once by the optimizer)."""
    names = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'"}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _decode_piece(piece: Column, table: Column) -> Column:
    """Decode one '&'-led piece: 'amp;rest' or '#233;rest'."""
    name = F.regexp_extract(piece, r"^(#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
    rest = F.substring(piece, F.length(name) + 2, F.length(piece))
    code = F.when(
        F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("int")
    ).otherwise(F.substring(name, F.lit(2), F.length(name)).try_cast("int"))
    # UTF-32 bytes of the code point give the character for every plane.
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    value = F.when(F.startswith(name, F.lit("#")), F.when(code.between(1, 1114111), wide)).otherwise(
        F.try_element_at(table, name)
    )
    return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), piece))


def decode_entities(text: Column) -> Column:
    """Character references to characters; text without '&' passes untouched.

    The four everyday references stay in generated code; the full table is
    consulted only for text that still holds an ampersand reference.
    """
    pieces = F.split(text, "&", -1)
    table = _entity_table()
    decoded = F.concat(
        F.get(pieces, F.lit(0)),
        F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: _decode_piece(p, table)), ""),
    )
    common = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        common = F.replace(common, F.lit(name), F.lit(char))
    only_common = F.regexp_replace(text, "&(amp|lt|gt|quot);", "")
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(~F.contains(only_common, F.lit("&")), common)
        .otherwise(decoded)
    )


def strip_ends(text: Column) -> Column:
    """Trim every kind of blank, non-breaking ones included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def inner_text(markup: Column) -> Column:
    """Text of a markup fragment: pieces trimmed, empties dropped, space-joined."""
    spaced = F.regexp_replace(markup, r"\s*+(?:" + _TAGS + r"\s*+)++", " ")
    return strip_ends(decode_entities(spaced))


def visible_text(html: Column) -> Column:
    """Tags to spaces, blanks collapsed: the crude text view of a page."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, _TAGS.replace("*", "+"), " "), r"\s+", " "))


def is_present(value: Column) -> Column:
    """Not NULL and not blank."""
    return value.isNotNull() & (strip_ends(value) != "")


# --- coercion ---------------------------------------------------------------------------

# Words read as yes and no.
TRUE_WORDS = ("true", "yes", "1", "available", "in stock")
FALSE_WORDS = ("false", "no", "0", "unavailable", "out of stock")


def number_text(value: Column) -> Column:
    """Digits, dots and signs of a value; thousands commas dropped."""
    return F.replace(F.regexp_replace(value, r"[^0-9.,+\-]", ""), F.lit(","), F.lit(""))


def to_number(value: Column) -> Column:
    """Double or NULL when the cleaned text is no number."""
    text = number_text(value)
    return F.when(F.rlike(text, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")), text.try_cast("double"))


def to_boolean(value: Column) -> Column:
    word = F.lower(strip_ends(value))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def coerced(value: Column, field_type: Column) -> Column:
    """struct(value_num, value_bool, value_str, failed, suspect): never a mixed column.

    ``suspect`` marks numbers assembled from text that held more than one
    number, such as a rating followed by a count.
    """
    kind = F.lower(field_type)
    number, flag = to_number(value), to_boolean(value)
    numbers_in_text = F.size(F.regexp_extract_all(value, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    return F.struct(
        F.when(kind == "number", number).alias("value_num"),
        F.when(kind == "boolean", flag).alias("value_bool"),
        F.when((kind == "number") & number.isNotNull(), F.lit(None).cast("string"))
        .when((kind == "boolean") & flag.isNotNull(), F.lit(None).cast("string"))
        .otherwise(value)
        .alias("value_str"),
        (
            value.isNotNull()
            & (((kind == "number") & number.isNull()) | ((kind == "boolean") & flag.isNull()))
        ).alias("failed"),
        F.coalesce((kind == "number") & number.isNotNull() & (numbers_in_text > 1), F.lit(False)).alias("suspect"),
    )


def metadata_key(label: Column) -> Column:
    """snake_case column name for a variant group label."""
    from pagesieve.functions.words import STANDARD_KEYS

    normal = collapse(F.lower(label))
    known = F.lit(None).cast("string")
    for phrase, key in STANDARD_KEYS.items():
        known = F.when(normal == phrase, F.lit(key)).otherwise(known)
    snake = F.regexp_replace(F.regexp_replace(normal, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(known, F.nullif(snake, F.lit("")), F.lit("variant"))
