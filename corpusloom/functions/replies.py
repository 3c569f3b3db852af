"""Reading model replies: fences, strict JSON, typed fields of a variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, strip

# --- Fixed values -------------------------------------------------------------------------------------------------

FENCE = "```"
FENCED_BLOCK = r"(?sU)```(?:json)?[\s\x1c-\x1f]*\n?(.*?)\n?[\s\x1c-\x1f]*```"
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]


def strip_code_fence(c: Column | str, dialect: str) -> Column:
    """Take the fence off a reply.

    `first_line`: the whole first line goes when it starts a fence, and a closing fence at the end; `json_prefix`: a json
    or bare fence in front and one at the end; `anywhere`: content of the first fenced block; `none`: only stripped.
    """
    text = strip(c)
    tail = F.lit(r"```\z")
    if dialect == "none":
        return text
    if dialect == "first_line":
        body = F.regexp_replace(text, F.lit(r"\A[^\n]*(\n|\z)"), F.lit(""))
        return F.when(F.startswith(text, F.lit(FENCE)), strip(F.regexp_replace(body, tail, F.lit("")))).otherwise(text)
    if dialect == "json_prefix":
        body = F.regexp_replace(text, F.lit(r"\A(```json)?(```)?"), F.lit(""))
        return strip(F.regexp_replace(body, tail, F.lit("")))
    if dialect == "anywhere":
        block = F.regexp_extract(text, FENCED_BLOCK, 1)
        return F.when(text.rlike(FENCED_BLOCK), strip(block)).otherwise(text)
    raise ValueError(f"unknown fence dialect {dialect!r}")


def strict_json(c: Column | str) -> Column:
    """The text as a variant if it is exactly one JSON value, else null.

    Spark's parser stops after the first value, so the text is tried as a list item and as a field value: only a complete
    single value passes both.
    """
    text = _col(c)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    items = F.transform(F.array(F.try_variant_get(listed, "$", "array<variant>")), lambda i: F.when(F.size(i) == 1, i[0]))
    return F.when(field.isNotNull(), F.get(items, F.lit(0)))


def first_json_object(c: Column | str) -> Column:
    """The JSON object starting at the first brace, whatever follows it."""
    text = _col(c)
    at = F.instr(text, "{")
    return F.when(at > 0, F.try_parse_json(F.substring(text, at, F.length(text))))


def answer_object(c: Column | str) -> Column:
    """A reply's object: strict inside a fence, the first object of the text outside of one."""
    text = strip(c)
    fenced = text.rlike(FENCED_BLOCK)
    found = F.when(fenced, strict_json(strip_code_fence(text, "anywhere"))).otherwise(first_json_object(text))
    return F.when(is_object(found), found)


def at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """Schema text of a variant: null when absent, `VOID` for a JSON null."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def has(v: Column, name: str) -> Column:
    return at(v, name).isNotNull()


def text_at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def is_text(v: Column, name: str, limit: int | None = None) -> Column:
    ok = F.coalesce(kind(at(v, name)) == "STRING", F.lit(False))
    return ok if limit is None else ok & (F.length(text_at(v, name)) <= limit)


def text_or_absent(v: Column, name: str, limit: int | None = None) -> Column:
    """A string, or no such field (a JSON null does not pass)."""
    return ~has(v, name) | is_text(v, name, limit)


def is_optional_text(v: Column, name: str) -> Column:
    """A string, null or absent."""
    return F.coalesce(kind(at(v, name)).isin("STRING", "VOID"), F.lit(True))


def is_optional_int(v: Column, name: str) -> Column:
    """A whole number (also as text or with a zero fraction), null or absent."""
    shape = kind(at(v, name))
    number = F.try_variant_get(v, f"$.{name}", "double")
    whole = shape.isin("BIGINT", "BOOLEAN", "VOID") | (
        (F.startswith(shape, F.lit("DECIMAL")) | (shape == "DOUBLE")) & (number == F.floor(number))
    )
    written = (shape == "STRING") & F.trim(text_at(v, name)).rlike(r"\A[+-]?\d+(\.0*)?\z")
    return F.coalesce(whole | written, F.lit(True))


def int_at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "double").cast("int")


def is_flag(v: Column, name: str) -> Column:
    """A boolean, or a number or word that reads as one."""
    word = F.lower(text_at(v, name))
    return F.coalesce(
        kind(at(v, name)).isin("BOOLEAN", "BIGINT", "STRING") & word.isin(TRUE_WORDS + FALSE_WORDS), F.lit(False)
    )


def flag_at(v: Column, name: str) -> Column:
    return F.lower(text_at(v, name)).isin(TRUE_WORDS)


def items_at(v: Column, name: str) -> Column:
    """List items as variants, null when the field is not a list."""
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def all_items(items: Column, test) -> Column:
    """Does the list exist and every item pass?"""
    return F.coalesce(F.forall(items, test), F.lit(False))


def is_text_list(v: Column, name: str) -> Column:
    return all_items(items_at(v, name), lambda i: kind(i) == "STRING")


def texts_at(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
