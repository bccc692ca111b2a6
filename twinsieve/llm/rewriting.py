"""Rewriting steps on text, as Spark columns and as the SQL that checks them.

A step is ("regex", pattern, replacement), ("replace", from, to), ("lower",), ("trim",) of spaces, or
("wrap", before, behind). Patterns use only what both
regular expression dialects share; replacements have no group references.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Steps = Sequence[tuple[str, ...]]


def rewritten(text: Column, steps: Steps) -> Column:
    for kind, *args in steps:
        if kind == "lower":
            text = F.lower(text)
        elif kind == "trim":
            text = F.trim(text)
        elif kind == "wrap":
            text = F.concat(F.lit(args[0]), text, F.lit(args[1]))
        elif kind == "regex":
            text = F.regexp_replace(text, args[0], args[1])
        else:
            text = F.replace(text, F.lit(args[0]), F.lit(args[1]))
    return text


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewritten_sql(text: str, steps: Steps) -> str:
    for kind, *args in steps:
        if kind == "lower":
            text = f"lower({text})"
        elif kind == "trim":
            text = f"trim({text}, ' ')"
        elif kind == "wrap":
            text = f"({literal(args[0])} || {text} || {literal(args[1])})"
        elif kind == "regex":
            text = f"regexp_replace({text}, {literal(args[0])}, {literal(args[1])}, 'g')"
        else:
            text = f"replace({text}, {literal(args[0])}, {literal(args[1])})"
    return text
