"""The view's search language: text to tokens, tokens to a predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchToken:
    type: str  # term, exclude, phrase or column
    value: str
    column: str | None = None
    operator: str = "AND"

    @property
    def label(self) -> str:
        forms = {"exclude": f"-{self.value}", "phrase": f'"{self.value}"', "column": f"{self.column}:{self.value}"}
        return forms.get(self.type, self.value)


_LEXEME = re.compile(r'\s+|(?P<or>or)|(?P<minus>-?+)(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))|-', re.IGNORECASE)
_STRICT = re.compile(r'\s+|(?P<or>or)(?=\s|$)|(?P<minus>-?+)(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))|-', re.IGNORECASE)


def parse_search(query: str, strict_or: bool = False) -> list[SearchToken]:
    """Words are joined by AND, ``OR`` begins another alternative, ``-word`` excludes, ``"two words"`` is a phrase, ``column:value`` looks in one
    column (where the colon is neither first nor last, whether or not a minus stands before it).

    A word that begins with "or" is read as OR and the rest of it, unless ``strict_or`` asks for OR as a word of its own.
    """
    tokens: list[SearchToken] = []
    operator = "AND"
    for m in (_STRICT if strict_or else _LEXEME).finditer(query):
        if m["or"]:
            operator = "OR"
            continue
        if m["phrase"] is not None:
            tokens.append(SearchToken("exclude" if m["minus"] else "phrase", m["phrase"], None, operator))
        elif m["word"]:
            column, colon, value = m["word"].partition(":")
            if column and colon and value:
                tokens.append(SearchToken("column", value, column, operator))
            else:
                tokens.append(SearchToken("exclude" if m["minus"] else "term", m["word"], None, operator))
        else:
            continue
        operator = "AND"
    return tokens


def tokens_to_query(tokens: list[SearchToken]) -> str:
    return " ".join(("OR " if t.operator == "OR" and n else "") + t.label for n, t in enumerate(tokens))


def remove_token(tokens: list[SearchToken], index: int) -> str:
    """The query without one token."""
    return tokens_to_query([t for n, t in enumerate(tokens) if n != index])


def search_predicate(tokens: list[SearchToken], all_text: Column, cell: dict[str, Column]) -> Column:
    """OR over the alternatives of AND over their tokens; case doesn't count in values, it does in column names."""
    if not tokens:
        return F.lit(True)
    groups: list[list[Column]] = []
    for n, t in enumerate(tokens):
        value = F.lit(t.value.lower())
        if t.type == "column":
            hit = F.lower(cell.get(t.column, F.lit(""))).contains(value)
        else:
            hit = F.lower(all_text).contains(value)
            hit = ~hit if t.type == "exclude" else hit
        if n == 0 or t.operator == "OR":
            groups.append([])
        groups[-1].append(hit)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])
