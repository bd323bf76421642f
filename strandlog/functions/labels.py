"""Label sets and their canonical text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DuplicateLabel, InvalidLabel

#: Escapes inside a label's name and value, in the order they are applied.
ESCAPES = (("%", "%25"), ("|", "%7C"), ("=", "%3D"))


def escaped(part: Column) -> Column:
    """A label's name or value as it stands in the canonical text."""
    for plain, code in ESCAPES:
        part = F.replace(part, F.lit(plain), F.lit(code))
    return part


def _plain(part: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        part = F.replace(part, F.lit(code), F.lit(plain))
    return part


def label_key(labels: Column) -> Column:
    """name=value pairs sorted by name, escaped and joined by |; the same for any order of the labels."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda p: F.concat(escaped(p["key"]), F.lit("="), escaped(p["value"]))), "|")


def label_map(key: Column) -> Column:
    """The labels of a canonical text; a broken one is an error when the row is read."""
    broken = key.rlike("%(?!25|7C|3D)") | ((key != "") & ~key.rlike(r"^[^=|]+=[^=|]*(\|[^=|]+=[^=|]*)*\z"))
    pairs = F.transform(F.split(key, r"\|", -1), lambda p: F.struct(_plain(F.substring_index(p, "=", 1)).alias("key"), _plain(F.substring_index(p, "=", -1)).alias("value")))
    return F.when(broken, F.raise_error(F.concat(F.lit("not a label key: "), key)).cast("map<string,string>")).when(key == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


def python_label_key(labels: dict[str, str]) -> str:
    def code(part: str) -> str:
        for plain, escaped in ESCAPES:
            part = part.replace(plain, escaped)
        return part

    return "|".join(f"{code(n)}={code(v)}" for n, v in sorted(labels.items()))


def check_labels(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Pairs as a mapping, if names are unique and valid."""
    out: dict[str, str] = {}
    for name, value in pairs:
        if not name or "\0" in name or "\0" in value:
            raise InvalidLabel(f"invalid label {name!r}")
        if name in out:
            raise DuplicateLabel(f"label {name!r} stands twice")
        out[name] = value
    return out


def labels_valid(labels: Column) -> Column:
    """The same check on a map column (whose names are unique by its type)."""
    return F.forall(F.map_entries(labels), lambda p: (p["key"] != "") & ~p["key"].contains("\0") & ~p["value"].contains("\0"))


def has_labels(labels: Column, wanted: dict[str, str], promoted: dict[str, Column] | None = None) -> Column:
    """Whether every wanted label has its value; promoted columns are compared bare, so that the scan can take the filter.

    A missing label equals an empty wanted value.
    """
    out = F.lit(True)
    for name, value in sorted(wanted.items()):
        own = (promoted or {}).get(name, labels[name])
        out = out & ((F.coalesce(own, F.lit("")) == "") if value == "" else (own == value))
    return out
