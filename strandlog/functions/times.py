"""Durations and timestamps in whole nanoseconds."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import InvalidQuery, MAX_NANOS

#: Units of a duration in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
DURATION = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Nanoseconds of numbers with units such as 1h30m or 1.5s; fractions below one nanosecond are cut."""
    at, total = 0, 0
    while at < len(text):
        m = DURATION.match(text, at)
        if not m:
            raise InvalidQuery(f"not a duration: {text!r}")
        number, unit = re.fullmatch(r"([\d.]+)(\D+)", m[0]).groups()
        total += int(Decimal(number) * UNITS[unit])
        at = m.end()
    if not text or total > MAX_NANOS:
        raise InvalidQuery(f"not a duration: {text!r}")
    return total


def format_duration(nanos: int) -> str:
    if nanos == 0:
        return "0s"
    out = ""
    for unit in ("h", "m", "s", "ms", "us", "ns"):
        count, nanos = divmod(nanos, UNITS[unit])
        out += f"{count}{unit}" if count else ""
    return out


_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9})\d*)?(Z|[+-]\d\d:\d\d)", re.ASCII)


def parse_rfc3339(text: str) -> int:
    """Nanoseconds since the epoch of an RFC 3339 time with up to nine fraction digits."""
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    zone = m[8]
    shift = 0 if zone == "Z" else (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 3600 + int(zone[4:6]) * 60)
    base = dt.datetime(*(int(m[i]) for i in range(1, 7)), tzinfo=dt.timezone.utc)
    seconds = (base - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).days * 86_400 + base.hour * 3600 + base.minute * 60 + base.second - shift
    return seconds * 1_000_000_000 + int((m[7] or "").ljust(9, "0") or 0)


def format_rfc3339(nanos: int) -> str:
    seconds, rest = divmod(nanos, 1_000_000_000)
    base = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
    return base.strftime("%Y-%m-%dT%H:%M:%S") + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"


def rfc3339_nanos(text: Column) -> Column:
    """RFC 3339 text as nanoseconds; null where it isn't one. Digits beyond microseconds are kept."""
    shape = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:[.,](\d{1,9})\d*)?(Z|[+-]\d\d:\d\d)$"
    digits = F.rpad(F.regexp_extract(text, shape, 2), 9, "0").cast("long")
    base = F.try_to_timestamp(F.concat(F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 3)))
    return F.when(text.rlike(shape), F.unix_micros(base) * 1000 + digits)


def window_bounds(range_nanos: int, offset_nanos: int, now_nanos: int) -> tuple[int, int]:
    """The closed window of a query: it ends offset before now and is range long."""
    end = now_nanos - offset_nanos
    return end - range_nanos, end
