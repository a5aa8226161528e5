import math

import pytest

from graticule.plans import units
from graticule.plans.ast import Aggregate, Binary, Matrix, Number, Selector, Subquery, Unary
from graticule.plans.parser import ParseError, UnsupportedError, parse, parse_selector, type_of
from graticule.plans.printer import to_text

CANONICAL = [
    "up", 'up{env="prod"}', '{__name__!=""}', "up[5m]", "up[5m] offset 1d", "up[5m:30s] @ end()", "up @ 1600000000.000 offset 1d", "-up", "(up)",
    "sum by (env) (rate(up[5m]))", "sum without (a, b) (up)", "topk by (env) (3, up)", 'count_values("v", up)', "a + on (x) group_left (y) b", "a > bool 2", "a and ignoring (x) b",
    "rate(count(foo)[5m:])", 'label_replace(up, "a", "$1", "b", "(.*)")', "1 / avg(up)", "2 ^ 3 ^ 2", "a atan2 b", "time()", "up[1h30m]", "up offset -5m",
]


@pytest.mark.parametrize("text", CANONICAL)
def test_canonical_text_round_trips(text):
    assert to_text(parse(text)) == text
    assert parse(to_text(parse(text))) == parse(text)


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ('up{job="x", instance="y"}', 'up{instance="y",job="x"}'), ("sum(up) by (env)", "sum by (env) (up)"), ("up[60s]", "up[1m]"), ("up[7d]", "up[1w]"), ("up[90m]", "up[1h30m]"),
        ("up offset 1d @ 1600000000", "up @ 1600000000.000 offset 1d"), ("up # comment\n+ 1", "up + 1"), ("0x10 + up", "16 + up"), ("1e3 * up", "1000 * up"), ("5m + up", "300 + up"), ("up{a='x'}", 'up{a="x"}'),
        ('{"http.requests",a="b"}', 'http.requests{a="b"}'), ("SUM(up)", "sum(up)"), ("-Inf + up", "-Inf + up"),
    ],
)
def test_other_spellings(text, canonical):
    assert to_text(parse(text)) == canonical


def test_precedence():
    e = parse("a or b and c == d + e * f ^ g")
    assert e.op == "or" and e.right.op == "and" and e.right.right.op == "==" and e.right.right.right.op == "+"
    assert parse("-2 ^ 2") == Unary("-", Binary("^", Number(2.0), Number(2.0)))
    assert parse("a - b - c").left == parse("a - b")
    assert parse("a ^ b ^ c").right == parse("b ^ c")


@pytest.mark.parametrize(
    "text",
    ["", "up{", "{}", '{a=~".*"}', "sum(up[5m])", "rate(up)", "up[5m][5m]", "1 and up", "1 == 1", "up + on(a) 1", "nosuch(up)", "topk(up)", "up offset 5m offset 5m", "up @ 1 @ 2", "(up)[5m]", "up > bool on(a) group_left(a) b", "a and on(x) group_left b", 'up{a=~"(?=x)"}', 'up{a=~"("}', "up[0s]", "sum by (a) (1)", "clamp(up, 1)", "-up[5m]", "up $ 1"],
)
def test_rejected(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("name", ["histogram_avg", "histogram_count", "histogram_stddev", "histogram_stdvar", "histogram_sum", "info", "max_of", "min_of", "start_timestamp"])
def test_unsupported_functions(name):
    with pytest.raises(UnsupportedError, match="unsupported PromQL function"):
        parse(f"{name}(up)")


def test_unsupported_aggregation():
    with pytest.raises(UnsupportedError, match="unsupported PromQL aggregation"):
        parse("limit_ratio(0.5, up)")


def test_types():
    assert type_of(parse("up[5m]")) == "range vector" and type_of(parse("time()")) == "scalar" and type_of(parse('"x"')) == "string" and type_of(parse("up")) == "instant vector"
    assert isinstance(parse("up[5m]"), Matrix) and isinstance(parse("up[5m:]"), Subquery) and isinstance(parse("sum(up)"), Aggregate)
    assert isinstance(parse_selector("(up)"), Selector)
    with pytest.raises(ParseError):
        parse_selector("up + 1")


def test_units():
    assert units.parse_duration("1h30m") == 5_400_000 and units.parse_duration("1d") == 86_400_000 and units.parse_duration("250ms") == 250
    for bad in ("", "5", "m5", "1m1h"):
        with pytest.raises(ValueError):
            units.parse_duration(bad)
    assert units.format_duration(0) == "0s" and units.format_duration(86_400_000) == "1d" and units.format_duration(8 * 86_400_000) == "8d"
    assert units.parse_time("1.0005") == 1001 and units.parse_time("2024-01-02T03:04:05.9999Z") == 1_704_164_645_999
    assert units.parse_step("15") == 15_000 and units.parse_step("1m") == 60_000
    for bad in ("0", "-1", "abc", "NaN"):
        with pytest.raises(ValueError):
            units.parse_step(bad)
    assert units.parse_bytes("512M") == 512 << 20 and units.parse_bytes("10") == 10
    for bad in ("1KB", "1KiB", "-1", "x"):
        with pytest.raises(ValueError):
            units.parse_bytes(bad)
    shown = {1.0: "1", 0.1: "0.1", 1e21: "1000000000000000000000", 1.5e-7: "0.00000015", math.inf: "+Inf", -math.inf: "-Inf", -2.5: "-2.5", 123456789.125: "123456789.125", 1e-10: "0.0000000001"}
    assert {v: units.format_float(v) for v in shown} == shown and units.format_float(math.nan) == "NaN"
