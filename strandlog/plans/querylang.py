"""The query expression: matcher{label=value,...}[range] offset duration.

query   := value '{' [ label (',' label)* ] '}' '[' duration ']' [ 'offset' duration ]
label   := name '=' value
value   := quoted string | name | number
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from ..functions.labels import check_labels
from ..functions.times import format_duration, parse_duration, window_bounds
from ..model import InvalidLabel, InvalidQuery


@dataclass(frozen=True)
class LogQuery:
    """A parsed expression; window() gives its closed bounds in nanoseconds."""

    matcher: str
    labels: dict[str, str] = field(default_factory=dict)
    range_nanos: int = 0
    offset_nanos: int = 0

    def __post_init__(self):
        if not self.matcher:
            raise InvalidQuery("the matcher is empty")
        if self.range_nanos <= 0:
            raise InvalidQuery("the range must be positive")
        if self.offset_nanos < 0:
            raise InvalidQuery("the offset can't be negative")

    def window(self, now_nanos: int) -> tuple[int, int]:
        return window_bounds(self.range_nanos, self.offset_nanos, now_nanos)


#: A duration's token: ASCII digits, a point only with digits behind it, a unit; narrower than what parse_duration takes.
_DURATION = re.compile(r"(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|μs|ms|s|m|h))+")


#: Escapes of a quoted string with one character.
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}


def unquote(body: str) -> str:
    """The text of a quoted string's inside; byte escapes are bytes of UTF-8."""
    out = bytearray()
    at = 0
    while at < len(body):
        c = body[at]
        if c == "\n":
            raise InvalidQuery("a quoted string can't go over lines")
        if c != "\\":
            out += c.encode("utf-8", "surrogatepass")
            at += 1
            continue
        e = body[at + 1 : at + 2]
        if e in _ESCAPES and e:
            out += _ESCAPES[e].encode()
            at += 2
        elif e in ("x", "u", "U"):
            size = {"x": 2, "u": 4, "U": 8}[e]
            digits = body[at + 2 : at + 2 + size]
            code = _number(digits, size, 16)
            if e == "x":
                out.append(code)
            elif code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise InvalidQuery("no such character")
            else:
                out += chr(code).encode()
            at += 2 + size
        elif e and e in "01234567":
            code = _number(body[at + 1 : at + 4], 3, 8)
            if code > 255:
                raise InvalidQuery("no such byte")
            out.append(code)
            at += 4
        else:
            raise InvalidQuery(f"unknown escape \\{e}")
    return out.decode("utf-8", "replace")


def _number(digits: str, size: int, base: int) -> int:
    if len(digits) != size or not all(d in "0123456789abcdefABCDEF"[: 22 if base == 16 else 8] for d in digits):
        raise InvalidQuery("a broken escape")
    return int(digits, base)


def _starts_name(c: str) -> bool:
    return c == "_" or unicodedata.category(c).startswith("L")


def _goes_on(c: str) -> bool:
    return c in "_.:/-" or unicodedata.category(c)[0] in "LN"


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; at each place the first rule that fits wins: string, duration, name, number, punctuation."""
    out = []
    at = 0
    while at < len(text):
        c = text[at]
        if c in " \t\n\r\f\v":
            at += 1
        elif c == '"':
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                raise InvalidQuery("a string isn't closed")
            out.append(("string", unquote(text[at + 1 : end])))
            at = end + 1
        elif m := _DURATION.match(text, at):
            out.append(("duration", m[0]))
            at = m.end()
        elif _starts_name(c):
            end = at + 1
            while end < len(text) and _goes_on(text[end]):
                end += 1
            out.append(("name", text[at:end]))
            at = end
        elif c.isascii() and c.isdigit():
            end = at
            while end < len(text) and text[end].isascii() and text[end].isdigit():
                end += 1
            if text[end : end + 1] == "." and text[end + 1 : end + 2].isascii() and text[end + 1 : end + 2].isdigit():
                end += 1
                while end < len(text) and text[end].isascii() and text[end].isdigit():
                    end += 1
            out.append(("number", text[at:end]))
            at = end
        elif c in "{}[],=":
            out.append((c, c))
            at += 1
        else:
            raise InvalidQuery(f"unexpected {c!r}")
    return out


def parse_query(text: str) -> LogQuery:
    """Parses an expression; every failure is an InvalidQuery."""
    held = tokens(text)
    at = 0

    def take(*kinds: str) -> str:
        nonlocal at
        if at >= len(held) or held[at][0] not in kinds:
            found = held[at][1] if at < len(held) else "the end"
            raise InvalidQuery(f"expected {' or '.join(kinds)}, found {found}")
        at += 1
        return held[at - 1][1]

    def comes(kind: str) -> bool:
        return at < len(held) and held[at][0] == kind

    value = ("string", "name", "number")
    matcher = take(*value)
    take("{")
    pairs = []
    while not comes("}"):
        if pairs:
            take(",")
        name = take("name")
        take("=")
        pairs.append((name, take(*value)))
    take("}")
    take("[")
    span = parse_duration(take("duration"))
    take("]")
    offset = 0
    if comes("name") and held[at][1] == "offset":
        at += 1
        offset = parse_duration(take("duration"))
    if at < len(held):
        raise InvalidQuery(f"unexpected {held[at][1]!r} after the query")
    try:
        labels = check_labels(pairs)
    except InvalidLabel as e:
        raise InvalidQuery(str(e)) from e
    return LogQuery(matcher, labels, span, offset)


def format_query(query: LogQuery) -> str:
    """A text that parses to the query: strings quoted, labels by name, no zero offset."""
    labels = ",".join(f"{n}={_quoted(v)}" for n, v in sorted(query.labels.items()))
    tail = f" offset {format_duration(query.offset_nanos)}" if query.offset_nanos else ""
    return f"{_quoted(query.matcher)}{{{labels}}}[{format_duration(query.range_nanos)}]{tail}"


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).replace("\\/", "/").replace("\x7f", "\\x7f")
