"""Values as they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowdelta.options import DiffOptions

EMPTY_OR_NULL = "EMPTY_OR_NULL"
_EDGES = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def unicode_trim(value: Column) -> Column:
    """Without white space of any script at both ends. Values without any are left alone, which is cheaper than the pattern."""
    return F.when(value.rlike(r"^\p{IsWhite_Space}|\p{IsWhite_Space}$"), F.regexp_replace(value, _EDGES, "")).otherwise(value)


def is_empty_or_null(value: Column) -> Column:
    """Blank, or the word null in any case."""
    bare = unicode_trim(value)
    return (bare == "") | (F.lower(bare) == "null")


def normalized(value: Column, options: DiffOptions) -> Column:
    """The value under the options; only what they ask for is part of the expression."""
    out = unicode_trim(value) if options.ignore_whitespace else value
    if not options.case_sensitive:
        out = F.lower(out)
    if options.ignore_empty_vs_null:
        sentinel = EMPTY_OR_NULL if options.case_sensitive else EMPTY_OR_NULL.lower()
        out = F.when(is_empty_or_null(value), F.lit(sentinel)).otherwise(out)
    return out
