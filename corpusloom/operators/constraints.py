"""Length and domain rules of the stored tables; rows that break one are set aside with the reasons."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.model import (
    ELEMENT_TYPES,
    FINDING_TYPES,
    MAX_ANSWER_CHARS,
    MAX_ANSWER_REFS,
    MAX_DESCRIPTION_CHARS,
    MAX_EVIDENCE_CHARS,
    MAX_QUESTION_CHARS,
    MAX_SUGGESTION_CHARS,
    MISSING_CLASSES,
    RELATION_TYPES,
    SEVERITIES,
    SUGGESTION_CATEGORIES,
)

# --- Fixed values -------------------------------------------------------------------------------------------------

CONSTRAINTS = {
    "elements": {"domain": {"type": ELEMENT_TYPES}},
    "relations": {"domain": {"type": RELATION_TYPES}},
    "findings": {
        "max_length": {"description": MAX_DESCRIPTION_CHARS},
        "domain": {"type": FINDING_TYPES, "severity": SEVERITIES},
    },
    "refs": {"max_length": {"evidence": MAX_EVIDENCE_CHARS}},
    "missing_elements": {"domain": {"classification": MISSING_CLASSES, "severity": SEVERITIES}},
    "suggestions": {
        "max_length": {"description": MAX_SUGGESTION_CHARS},
        "domain": {"category": SUGGESTION_CATEGORIES, "priority": SEVERITIES},
    },
    "answers": {"max_length": {"answer": MAX_ANSWER_CHARS}},
    "nested_answers": {"max_length": {"answer": MAX_ANSWER_CHARS}, "max_items": {"source_refs": MAX_ANSWER_REFS}},
    "questions": {"max_length": {"question": MAX_QUESTION_CHARS}, "min_length": {"question": 1}},
}


class Constrained(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def check_constraints(df: DataFrame, rules: str | dict) -> Constrained:
    """Split by the rules of a table (by name) or a rule mapping; null is refused wherever a rule names the column."""
    rules = CONSTRAINTS[rules] if isinstance(rules, str) else rules
    tests = []
    for column, limit in rules.get("max_length", {}).items():
        tests.append((F.length(column) <= limit, f"{column} too long"))
    for column, least in rules.get("min_length", {}).items():
        tests.append((F.length(column) >= least, f"{column} too short"))
    for column, most in rules.get("max_items", {}).items():
        tests.append((F.size(column) <= most, f"more than {most} {column}"))
    for column, domain in rules.get("domain", {}).items():
        tests.append((F.col(column).isin(domain), f"{column} not allowed"))
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), text) for ok, text in tests]))
    judged = df.withColumn("reasons", reasons)
    return Constrained(
        judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
    )
