"""Plans as data: a query, the expression that stays local, and the partitions (expression, what sources are asked, sources)."""

import json

import pytest

from graticule.plans import registry as R
from graticule.plans.parser import ParseError, parse
from graticule.plans.planner import Planner, Span

ONE = {"a-prod": {"env": "prod"}, "b-staging": {"env": "staging"}}
TWO = {"a": {"env": "prod", "region": "eu"}, "b": {"env": "prod", "region": "us"}, "c": {"env": "staging", "region": "eu"}}
P0, P1 = '{__partition_idx__="0"}', '{__partition_idx__="1"}'
ALL1, ALL2 = ["a-prod", "b-staging"], ["a", "b", "c"]

INSTANT = [
    (ONE, "up", P0, [("up", "up", ALL1)]),
    (ONE, 'up{env="prod"}', P0, [('up{env="prod"}', "up", ["a-prod"])]),
    (ONE, '{env="prod"}', P0, [('{env="prod"}', '{__name__!=""}', ["a-prod"])]),
    (ONE, "sum by (env) (rate(up[5m]))", P0, [("sum by (env) (rate(up[5m]))", "sum(rate(up[5m]))", ALL1)]),
    (ONE, "sum(rate(up[5m]))", f"sum({P0})", [("sum by (env) (rate(up[5m]))", "sum(rate(up[5m]))", ALL1)]),
    (ONE, "count(up)", f"sum({P0})", [("count by (env) (up)", "count(up)", ALL1)]),
    (ONE, "sum without (env, x) (up)", f"sum without (env, x) ({P0})", [("sum without (x) (up)", "sum without (x) (up)", ALL1)]),
    (ONE, "1 / avg(up)", f"1 / (sum({P0}) / sum({P1}))", [("sum by (env) (up)", "sum(up)", ALL1), ("count by (env) (up)", "count(up)", ALL1)]),
    (ONE, "stddev(up)", f"stddev({P0})", [("up", "up", ALL1)]),
    (TWO, "topk(3, up)", f"topk(3, {P0})", [("topk by (env, region) (3, up)", "topk(3, up)", ALL2)]),
    (TWO, "quantile by (env, region) (0.5, up)", P0, [("quantile by (env, region) (0.5, up)", "quantile(0.5, up)", ALL2)]),
    (TWO, 'count_values by (env, region) ("v", up)', f'count_values by (env, region) ("v", {P0})', [("up", "up", ALL2)]),
    (ONE, 'up{env="prod"} + up{env="staging"}', '{__partition_idx__="n/a"}', []),
    (ONE, "a + on (job) b", f"{P0} + on (job) {P1}", [("a", "a", ALL1), ("b", "b", ALL1)]),
    (ONE, "a + on (job, env) b", P0, [("a + on (job, env) b", "a + on (job) b", ALL1)]),
    (ONE, "a * on () group_left () vector(2)", P0, [("a * on () group_left () vector(2)", "a * on () group_left () vector(2)", ALL1)]),
    (ONE, 'a{env="prod"} or a{env="staging"}', f"{P0} or {P1}", [('a{env="prod"}', "a", ["a-prod"]), ('a{env="staging"}', "a", ["b-staging"])]),
    (ONE, "a unless b", P0, [("a unless b", "a unless b", ALL1)]),
    (ONE, "vector(1) unless a", f"vector(1) unless {P0}", [("a", "a", ALL1)]),
    (ONE, "absent(up)", f'label_replace(absent({P0}), "__partition_idx__", "", "", "")', [("group by (env) (up)", "group(up)", ALL1)]),
    (ONE, 'absent(up{job="x"})', f'label_replace(label_replace(absent({P0}), "__partition_idx__", "", "", ""), "job", "x", "", "")', [('group by (env) (up{job="x"})', 'group(up{job="x"})', ALL1)]),
    (ONE, "up[5m] offset 1d @ 1600000000", f"{P0}[5m] @ 1600000000.000 offset 1d", [("up[5m] @ 1600000000.000 offset 1d", "up[5m] @ 1600000000.000 offset 1d", ALL1)]),
    (ONE, "up offset 1d", P0, [("up offset 1d", "up offset 1d", ALL1)]),
    (ONE, "vector(time()) > bool 3", "vector(time()) > bool 3", []),
    (ONE, 'clamp_max(queue, scalar(max(cap{env="prod"})))', f"clamp_max({P0}, scalar(max({P1})))", [("queue", "queue", ALL1), ('max by (env) (cap{env="prod"})', "max(cap)", ["a-prod"])]),
    (ONE, 'label_replace(up, "x", "$1", "env", "(.*)")', f'label_replace({P0}, "x", "$1", "env", "(.*)")', [("up", "up", ALL1)]),
    (ONE, "sort(up)", f"sort({P0})", [("up", "up", ALL1)]),
    (ONE, "year()", "year()", []),
]

RANGE = [
    ("rate(up[5m])", P0, [("rate(up[5m])", "rate(up[5m])", True)]),
    ("rate(count(foo)[5m:])", f"rate(sum({P0})[5m:])", [("count by (env) (foo)[10m:]", "count(foo)[10m:]", False)]),
    ("rate(count(foo)[5m:] offset 1d)", f"rate(sum({P0})[5m:] offset 1d)", [("count by (env) (foo)[10m:] offset 1d", "count(foo)[10m:] offset 1d", False)]),
    ("absent_over_time(rate(up[5m])[1h:])", f'label_replace(absent({P0}), "__partition_idx__", "", "", "")', [("group by (env) (present_over_time(rate(up[5m])[1h:]))", "group(present_over_time(rate(up[5m])[1h:]))", True)]),
]


@pytest.mark.parametrize(("sources", "query", "local", "parts"), INSTANT, ids=[c[1] for c in INSTANT])
def test_instant_plans(sources, query, local, parts):
    d = Planner(sources).plan(parse(query), Span(0, 0)).describe()
    assert (d["expr"], [(p["expr"], p["downstreamExpr"], p["downstreams"]) for p in d["partitions"]]) == (local, parts)
    assert not d["isRange"] and all(p["time"] == 0 for p in d["partitions"])
    assert json.loads(json.dumps(d)) == d


@pytest.mark.parametrize(("query", "local", "parts"), RANGE, ids=[c[0] for c in RANGE])
def test_range_plans(query, local, parts):
    d = Planner(ONE).plan(parse(query), Span(100_000, 400_000, 120_000)).describe()
    assert (d["expr"], [(p["expr"], p["downstreamExpr"], p["isRange"]) for p in d["partitions"]]) == (local, parts)
    for p in d["partitions"]:
        assert p["step"] == 120_000_000_000 if p["isRange"] else p["time"] == 400_000


@pytest.mark.parametrize("query", ["up[5m]", "up[5m:1m]"])
def test_range_vectors_are_no_range_results(query):
    with pytest.raises(ParseError, match='invalid expression type "range vector" for range query'):
        Planner(ONE).plan(parse(query), Span(0, 100, 10))


def test_routing_with_missing_labels():
    p = Planner({"x": {"env": "prod"}, "y": {"planet": "mars"}, "z": {"env": "prod", "region": "eu"}})
    assert p.names == ["env", "planet", "region"]
    assert p.routed(parse('up{region=""}').matchers) == ("x", "y")
    assert p.routed(parse('up{env=~"pr.*",region!=""}').matchers) == ("z",)
    assert p.routed(parse('up{env!~"prod|"}').matchers) == ()


def test_registry_is_complete():
    assert len(R.FUNCTIONS) == 82 and len(R.AGGREGATIONS) == 13
    assert not set(R.FUNCTIONS) & R.UNSUPPORTED_FUNCTIONS
