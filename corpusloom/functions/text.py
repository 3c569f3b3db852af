"""String rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.model import LANGUAGE_SAMPLE_CHARS

# --- Fixed values -------------------------------------------------------------------------------------------------

# Whitespace as the source rules see it: Unicode White_Space plus the four ASCII separators Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
WORD_PUNCTUATION = ".,;:!?\"'()[]{}—–-"
SPANISH_MARKS = ["ñ", "¿", "¡"]
SPANISH_MARK_WEIGHT = 3
MIN_WORDS = 5
MIN_DENSITY = 0.15
MIN_SHARE = 0.6
ENGLISH_STOPWORDS = (
    "the is and a of to in it that for was on are with as this be at by from or an have has not but what which their "
    "will been would could should there about were they each than other them into its when only can these some then "
    "very more also after our just"
).split()
SPANISH_STOPWORDS = (
    "el la de que en un una es se no por con los las del para lo su como al más pero ya o entre cuando todo esta ser "
    "son dos también fue había era tiene le me sin sus muy nos ni otro ese todos ella donde bien estos desde poco hay "
    "hasta aquí"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), F.lit(rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z"), F.lit(""))


def normalize_ws(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(_col(c), F.lit(rf"(?U){SPACE}+"), F.lit(" ")))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def chunk_id(order: Column | str) -> Column:
    return F.format_string("chunk-%03d", _col(order))


def detect_language(c: Column | str) -> Column:
    """`en`, `es` or `unknown` from stop-word counts in the first 1000 characters."""
    sample = F.lower(truncate(c, LANGUAGE_SAMPLE_CHARS))
    words = F.filter(
        F.transform(F.split(sample, rf"(?U){SPACE}+"), lambda w: F.btrim(w, F.lit(WORD_PUNCTUATION))),
        lambda w: w != "",
    )
    marks = sum(
        (F.when(F.contains(sample, F.lit(m)), SPANISH_MARK_WEIGHT).otherwise(0) for m in SPANISH_MARKS), F.lit(0)
    )

    def verdict(s: Column) -> Column:
        total, best = s.en + s.es, F.greatest(s.en, s.es)
        return (
            F.when(s.words < MIN_WORDS, "unknown")
            .when(total == 0, "unknown")
            .when(best / s.words < MIN_DENSITY, "unknown")
            .when(best / total < MIN_SHARE, "unknown")
            .when(s.en > s.es, "en")
            .when(s.es > s.en, "es")
            .otherwise("unknown")
        )

    # One-element arrays bind the word list and the counts once instead of repeating them in every branch.
    counts = F.transform(
        F.array(words),
        lambda ws: F.struct(
            F.size(ws).alias("words"),
            F.size(F.filter(ws, lambda w: w.isin(ENGLISH_STOPWORDS))).alias("en"),
            (F.size(F.filter(ws, lambda w: w.isin(SPANISH_STOPWORDS))) + marks).alias("es"),
        ),
    )
    return F.coalesce(F.element_at(F.transform(counts, verdict), 1), F.lit("unknown"))


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"[^/]*\z", 0)


def sanitize_filename(c: Column | str) -> Column:
    """A flat, safe file name."""
    name = F.regexp_replace(basename(c), F.lit(r"\\"), F.lit("_"))
    name = F.regexp_replace(name, F.lit(r"\x00"), F.lit(""))
    name = F.regexp_replace(name, F.lit(r"\.{2,}"), F.lit("."))
    name = F.regexp_replace(name, F.lit(r"[^\p{L}\p{N}_.\-]"), F.lit("_"))
    name = F.btrim(F.regexp_replace(name, F.lit("_+"), F.lit("_")), F.lit("_."))
    return F.when(name == "", "unnamed_file").otherwise(name)


def _tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def element_tokens(id_: Column, type_: Column, name: Column, content: Column, evidence: Column) -> Column:
    """Token estimate of a context element: a quarter of its characters, at least one."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (id_, type_, name, content, evidence)]
    return _tokens(F.concat_ws(" ", *parts))


def relation_tokens(source: Column, target: Column, type_: Column, description: Column) -> Column:
    parts = [F.coalesce(_col(c), F.lit("")) for c in (source, target, type_, description)]
    return _tokens(F.concat_ws(" ", *parts))


def annotate_unverified(content: Column | str, verified: Column | str) -> Column:
    return F.when(_col(verified), _col(content)).otherwise(F.concat(F.lit("[UNVERIFIED] "), _col(content)))


def clamp_score(v: Column | str) -> Column:
    """Integer part limited to 0..10; missing counts as 0."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(_col(v).cast("int"), F.lit(0))))


def evidence_preview(c: Column | str, n: int = 200) -> Column:
    return F.when(F.length(_col(c)) > n, F.concat(truncate(c, n), F.lit("…"))).otherwise(_col(c))


def rate_percent(rate: Column | str) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(_col(rate) * 100 + 0.5).cast("int")


def chunk_label(style: str, chunk: Column | str, page: Column | str, section: Column | str) -> Column:
    """Header put before a chunk in prompts.

    `id`: chunk id only; `fields`: id, page, section when not null; `tags`: chunk, section, page when not empty or 0.
    """
    chunk, page, section = _col(chunk), _col(page), _col(section)
    if style == "id":
        return F.concat(F.lit("[chunk_id="), chunk, F.lit("]"))
    if style == "fields":
        parts = [
            F.concat(F.lit("chunk_id="), chunk),
            F.concat(F.lit("page="), page.cast("string")),
            F.concat(F.lit("section="), section),
        ]
        return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    if style == "tags":
        parts = [
            F.concat(F.lit("[chunk:"), chunk, F.lit("]")),
            F.when(section != "", F.concat(F.lit("[section:"), section, F.lit("]"))),
            F.when(page != 0, F.concat(F.lit("[page:"), page.cast("string"), F.lit("]"))),
        ]
        return F.concat_ws(" ", *parts)
    raise ValueError(f"unknown label style {style!r}")


def owner_key(kind: str, *places: Column | str) -> Column:
    """Names a row inside its document by what it is and where it stands, whatever id it came with."""
    return F.concat_ws(":", F.lit(kind), *[_col(p).cast("string") for p in places])


def stable_id(prefix: str, *keys: Column | str) -> Column:
    """Reproducible id from the row's key."""
    joined = F.concat_ws("\x1f", *[_col(k).cast("string") for k in keys])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))
