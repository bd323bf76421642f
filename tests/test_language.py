"""The query expression, the pattern language, labels and times."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions.labels import check_labels, label_key, label_map, python_label_key
from strandlog.functions.matcher import matches, to_regex
from strandlog.functions.times import format_duration, format_rfc3339, parse_duration, parse_rfc3339
from strandlog.model import DuplicateLabel, InvalidLabel, InvalidOptions, InvalidQuery, Options
from strandlog.plans.querylang import LogQuery, format_query, parse_query


def plain_match(target: str, pattern: str) -> bool:
    """The pattern language by recursion, nothing shared with the compiler."""
    if not pattern:
        return not target
    c = pattern[0]
    if c == "[":
        end = pattern.find("]")
        if end < 0 or end == 1:
            return False
        return bool(target) and target[0] in pattern[1:end] and plain_match(target[1:], pattern[end + 1 :])
    if c == "%":
        return any(plain_match(target[k:], pattern[1:]) for k in range(len(target) + 1))
    return bool(target) and (c == "_" or target[0] == c) and plain_match(target[1:], pattern[1:])


def never(pattern: str) -> bool:
    return to_regex(pattern) is None


#: Parts that the cases below are put together from: texts, and patterns with what each part of them may stand for.
TEXTS = ["", "q", "qr", "rq", "q]r", "q[r", "%", "_", "q%r", "q.r", "qxr", "q^", "q\\r", "q\nr", "ö", "語語", "🙂", "qqqq"]
PATTERNS = ["", "q", "%", "_", "__", "q%", "%r", "q_r", "q%r", "[qr]", "[qr]%", "[^q]", "[q-s]", "[]", "[]q]", "[[]", "[qr", "q]r", "]", "[%]", "[_]%", "q.r", "q\\r", "%[.%]%", "%_%", "_%_", "%q%q%", "[ö語]_", "_🙂", "[🙂]"]


def test_every_pattern_on_every_text(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = rows.select("i", *[matches(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    for r in got:
        assert [bool(x) for x in r[1:]] == [not never(p) and plain_match(TEXTS[r.i], p) for p in PATTERNS], TEXTS[r.i]
    assert {p for p in PATTERNS if never(p)} == {"[]", "[]q]", "[qr"}


def test_matcher_equals_plain_version_on_random_patterns(spark):
    draw = random.Random(5)
    alphabet = "ab%_[]\\^-.é\n"
    pairs = []
    while len(pairs) < 400:
        pattern = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 6)))
        target = "".join(draw.choice("ab\\^-.é\n]%_") for _ in range(draw.randint(0, 6)))
        if not (never(pattern) and plain_match(target, pattern)):
            pairs.append((target, pattern))
    for t, p in pairs:
        regex = to_regex(p)
        assert (regex is not None and re.search(regex.replace(r"\z", r"\Z"), t) is not None) == (plain_match(t, p) and regex is not None)
    for at in range(0, len(pairs), 100):
        part = pairs[at : at + 100]
        row = spark.range(1).select(*[matches(F.lit(t), p).alias(f"m{i}") for i, (t, p) in enumerate(part)]).first()
        assert [bool(x) for x in row] == [plain_match(t, p) for t, p in part]


def test_contains_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("abc",)], "message string").write.parquet(str(tmp_path / "x"))
    plan = spark.read.parquet(str(tmp_path / "x")).where(matches(F.col("message"), "%b%"))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(message,b)" in plan


#: Every kind of value that the grammar has, as it is written and what it says.
VALUES = [('""', ""), ('"two words"', "two words"), ('"%"', "%"), ('"{[,=]}"', "{[,=]}"), ('"tab\\t\\x41\\u00e9"', "tab\tAé"), ('"\\""', '"'), ("word", "word"), ("_x.y:z/1-2", "_x.y:z/1-2"), ("größe9", "größe9"), ("12", "12"), ("0.25", "0.25"), ("offset", "offset")]
DURATIONS = [("1ns", 1), ("2us", 2_000), ("2µs", 2_000), ("2μs", 2_000), ("3ms", 3_000_000), ("4s", 4 * 10**9), ("5m", 300 * 10**9), ("6h", 21_600 * 10**9), ("0.5s", 5 * 10**8), ("1h2m3.004s", 3_723_004_000_000)]


@pytest.mark.parametrize("space", ["", " ", "\n\t "])
def test_what_the_grammar_has_is_read(space):
    for k, (text, says) in enumerate(VALUES):
        other, other_says = VALUES[(k + 5) % len(VALUES)]
        span, nanos = DURATIONS[k % len(DURATIONS)]
        back, back_nanos = DURATIONS[(k + 3) % len(DURATIONS)]
        matcher, wanted = (text, says) if says else ("m", "m")
        for pairs, labels in (([], {}), ([("l", text)], {"l": says}), ([("l", text), ("größe", other)], {"l": says, "größe": other_says})):
            inside = f"{space},{space}".join(f"{n}{space}={space}{v}" for n, v in pairs)
            for tail, offset in (("", 0), (f"{space}offset {space}{back}", back_nanos)):
                query = parse_query(f"{space}{matcher}{space}{{{space}{inside}{space}}}{space}[{space}{span}{space}]{tail}{space}")
                assert query == LogQuery(wanted, labels, nanos, offset)
                assert parse_query(format_query(query)) == query


#: One breach of each rule, made by changing one part of m{l=v}[1h] offset 1m.
BREACHES = {
    "nothing at all": "", "no matcher": "{l=v}[1h]", "an empty matcher": '""{l=v}[1h]', "a duration as the matcher": "1m{l=v}[1h]", "two tokens as the matcher": "7m2{l=v}[1h]", "a sign outside quotes": "%{l=v}[1h]", "no braces": "m[1h]", "an open brace": "m{l=v[1h]", "a comma alone": "m{,}[1h]", "a comma at the end": "m{l=v,}[1h]",
    "no comma": "m{l=v k=v}[1h]", "a label without a value": "m{l}[1h]", "a value that is missing": "m{l=}[1h]", "a name in quotes": 'm{"l"=v}[1h]', "a number as the name": "m{1=v}[1h]", "a duration as a value": "m{l=1m}[1h]", "a label twice": "m{l=v,l=w}[1h]", "an empty name": 'm{""=v}[1h]',
    "no range": "m{l=v}", "an empty range": "m{l=v}[]", "a range of nothing": "m{l=v}[0h]", "a number as the range": "m{l=v}[1]", "an unknown unit": "m{l=v}[1w]", "a point without digits behind it": "m{l=v}[1.s]", "a point without digits before it": "m{l=v}[.5h]", "digits of another script": "m{l=v}[\u0665m]", "a space in a duration": "m{l=v}[1h 1m]", "an open bracket": "m{l=v}[1h",
    "an offset without a duration": "m{l=v}[1h] offset", "an offset below nothing": "m{l=v}[1h] offset -1m", "another word for offset": "m{l=v}[1h] before 1m", "something after the end": "m{l=v}[1h] offset 1m x", "an open quote": '"m{l=v}[1h]', "an unknown escape": '"\\m"{l=v}[1h]', "a line end in quotes": '"m\n"{l=v}[1h]', "half a character": '"\\ud800"{l=v}[1h]',
}


@pytest.mark.parametrize("what", BREACHES)
def test_what_breaks_a_rule_is_refused(what):
    with pytest.raises(InvalidQuery):
        parse_query(BREACHES[what])


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(min_size=1, alphabet=st.characters(exclude_categories=["Cs"])), st.dictionaries(st.from_regex(r"[A-Za-z_][A-Za-z0-9_.:/-]*", fullmatch=True), st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=4), st.integers(1, 10**15), st.integers(0, 10**15))
def test_format_is_the_inverse_of_parse(matcher, labels, span, offset):
    q = LogQuery(matcher, labels, span, offset)
    assert parse_query(format_query(q)) == q


def test_window_is_before_now():
    assert LogQuery("x", {}, 100, 30).window(1000) == (870, 970)


def test_durations_and_times():
    assert parse_duration("2h15m") == 8100 * 10**9 and parse_duration("2.5us") == 2500 and parse_duration(".5s") == parse_duration("500.ms") == 5 * 10**8 and parse_duration(format_duration(987654321987)) == 987654321987
    for bad in ("", "1w", "-2m", "7", "1h 2m", "\u0665m"):
        with pytest.raises(InvalidQuery):
            parse_duration(bad)
    assert parse_rfc3339("2024-01-01T10:00:00.123456789+02:00") == 1704096000123456789
    assert format_rfc3339(1704096000123456789) == "2024-01-01T08:00:00.123456789Z"
    with pytest.raises(ValueError):
        parse_rfc3339("2024-01-01 10:00:00Z")


def test_label_keys(spark):
    sets = [{}, {"b": "1", "a": "x=y|z%"}, {"a": ""}, {"é": "ü"}]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, labels map<string,string>")
    got = rows.select("i", label_key(F.col("labels")).alias("k")).withColumn("back", label_map(F.col("k"))).orderBy("i").collect()
    assert [r.k for r in got] == [python_label_key(s) for s in sets] and [r.back for r in got] == sets
    assert got[1].k == "a=x%3Dy%7Cz%25|b=1"
    with pytest.raises(Exception, match="not a label key"):
        spark.createDataFrame([("a=%41",)], "k string").select(label_map(F.col("k"))).collect()
    with pytest.raises(DuplicateLabel):
        check_labels([("a", "1"), ("a", "2")])
    for bad in (("", "x"), ("a\0", "x"), ("a", "\0")):
        with pytest.raises(InvalidLabel):
            check_labels([bad])


def test_options():
    assert Options.from_env({"STRANDLOG_MAX_LEVELS": "6", "STRANDLOG_COMPACTION_WORKERS": "many", "STRANDLOG_COMPRESSION": " ZSTD "}) == Options(max_levels=6, compression="zstd")
    for bad in ({"STRANDLOG_MAX_LEVELS": "1"}, {"STRANDLOG_COMPRESSION": "rar"}):
        with pytest.raises(InvalidOptions):
            Options.from_env(bad)
