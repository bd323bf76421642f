"""The message pattern language, compiled to the cheapest Column that Spark can push down.

% stands for any run of characters, _ for one, [abc] for one of a set (no ranges, no negation, closed by the first
bracket); everything else stands for itself and there is no escape. A set that is empty or not closed matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class OneOf:
    members: str


class AnyOne:
    pass


class AnyRun:
    pass


def parse_pattern(pattern: str) -> list | None:
    """Tokens of a pattern, or None if it can't match anything."""
    tokens: list = []
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            end = pattern.find("]", at + 1)
            if end <= at + 1:
                return None
            tokens.append(OneOf(pattern[at + 1 : end]))
            at = end
        elif c == "%":
            if not (tokens and isinstance(tokens[-1], AnyRun)):
                tokens.append(AnyRun())
        elif c == "_":
            tokens.append(AnyOne())
        elif tokens and isinstance(tokens[-1], Literal):
            tokens[-1] = Literal(tokens[-1].text + c)
        else:
            tokens.append(Literal(c))
        at += 1
    return tokens


#: Characters that mean something in a regular expression of Java or RE2.
_SPECIAL = set("\\.^$|?*+()[]{}-&~#/")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def to_regex(pattern: str) -> str | None:
    """An anchored regular expression that Java, RE2 and Python read alike; None for a pattern that never matches."""
    tokens = parse_pattern(pattern)
    if tokens is None:
        return None
    parts = []
    for t in tokens:
        if isinstance(t, Literal):
            parts.append(_quoted(t.text))
        elif isinstance(t, OneOf):
            parts.append("[" + _quoted(t.members) + "]")
        else:
            parts.append("." if isinstance(t, AnyOne) else ".*")
    return "(?s)^" + "".join(parts) + r"\z"


def matches(target: Column, pattern: str) -> Column:
    """Whether the whole target matches, in the cheapest form: equality, prefix, suffix, contains, LIKE, or a regular expression."""
    tokens = parse_pattern(pattern)
    if tokens is None:
        return F.lit(False)
    if not tokens:
        return target == ""
    runs = [t for t in tokens if isinstance(t, AnyRun)]
    words = [t.text for t in tokens if isinstance(t, Literal)]
    if len(runs) + len(words) == len(tokens):
        head, tail = isinstance(tokens[0], AnyRun), isinstance(tokens[-1], AnyRun)
        if not words:
            return target.isNotNull()
        if not runs:
            return target == words[0]
        if len(words) == 1:
            return target.contains(words[0]) if head and tail else target.endswith(words[0]) if head else target.startswith(words[0])
    if any(isinstance(t, OneOf) for t in tokens):
        return target.rlike(to_regex(pattern))
    return target.like("".join(t.text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if isinstance(t, Literal) else "_" if isinstance(t, AnyOne) else "%" for t in tokens))


def contains_pattern(pattern: str) -> str:
    """The pattern as a search anywhere in the message."""
    return f"%{pattern}%"
