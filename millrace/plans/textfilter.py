"""The free-text filter language, compiled to Column expressions.

Blanks outside double quotes separate tokens and all tokens must hold. A bare token is a substring, a
quoted one a phrase bounded by characters that are neither letters nor digits, a leading ``-`` negates,
and ``|`` between alternatives (not first, token longer than two characters) means any of them. Case is
ignored. An empty filter holds for every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"[\p{L}\p{Nd}]"


@dataclass(frozen=True)
class Term:
    """``words``: alternatives, each (text, is_phrase); an empty text holds always."""

    words: tuple[tuple[str, bool], ...]
    negated: bool = False


def _word(token: str) -> tuple[str, bool]:
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return token[1:-1], True
    return token, False


def _cut(text: str, at: str) -> list[str]:
    """Parts of ``text`` between the characters ``at`` that stand outside quotes."""
    parts, quoted, part = [], False, []
    for c in text:
        if c == at and not quoted:
            parts.append("".join(part))
            part = []
            continue
        quoted ^= c == '"'
        part.append(c)
    return [*parts, "".join(part)]


def parse(text: str | None) -> list[Term]:
    terms = []
    for token in _cut((text or "").lower(), " "):
        if not token or token == "-":
            continue
        if token[0] == "-":
            terms.append(Term((_word(token[1:]),), negated=True))
        elif len(token) > 2 and token.find("|") > 0:
            terms.append(Term(tuple(_word(w) for w in _cut(token, "|") if w)))
        else:
            terms.append(Term((_word(token),)))
    return terms


def _holds(text: Column, word: tuple[str, bool]) -> Column:
    body, phrase = word
    if not phrase:
        return text.contains(body) if body else F.lit(True)
    return text.rlike(f"(?<!{_EDGE}){re.escape(body)}(?!{_EDGE})")


def matches(text: Column | str, filter_text: str | None) -> Column:
    """True where ``text`` passes the filter; a null text counts as empty."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    out = F.lit(True)
    for term in parse(filter_text):
        any_of = reduce(lambda a, b: a | b, (_holds(low, w) for w in term.words))
        out = out & (~any_of if term.negated else any_of)
    return out
