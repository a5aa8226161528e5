"""Semantics on small data, against hand-computed values."""

import math
import statistics
import threading

import pytest

from graticule.engine import Engine, Limits
from graticule.sources.catalog import Catalog, Source


def frame(spark, rows, labels=("__name__", "job", "le")):
    schema = ", ".join([*(f"`{x}` string" for x in labels), "t long", "v double"])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def engine(spark):
    prod = [("up", "a", "", t * 1000, float(t)) for t in range(0, 601, 60)] + [("up", "b", "", 0, 5.0), ("reqs", "a", "", 0, 10.0), ("reqs", "a", "", 60_000, 20.0), ("reqs", "a", "", 120_000, 5.0), ("reqs", "a", "", 180_000, 15.0)]
    prod += [("odd", "nan", "", 0, math.nan), ("odd", "one", "", 0, 1.0), ("odd", "inf", "", 0, math.inf), ("odd", "neg", "", 0, -2.5)]
    prod += [("lat", "a", le, 0, n) for le, n in (("0.1", 10.0), ("0.5", 30.0), ("1", 40.0), ("+Inf", 50.0))]
    staging = [("up", "a", "", t * 1000, 100.0) for t in range(0, 601, 60)]
    return Engine(spark, Catalog([Source("p", frame(spark, prod), {"env": "prod", "region": "eu"}), Source("s", frame(spark, staging), {"env": "staging"})]))


def values(engine, query, at=600, **drop):
    out = engine.query(query, at)
    assert out["status"] == "success", out
    data = out["data"]
    if data["resultType"] == "scalar":
        return float(data["result"][1].replace("Inf", "inf"))
    return {tuple(sorted(r["metric"].items())): float(r["value"][1].replace("Inf", "inf")) for r in data["result"]}


def one(engine, query, at=600):
    v = values(engine, query, at)
    assert len(v) == 1, v
    return next(iter(v.values()))


def test_lookback_is_left_open(engine):
    assert one(engine, 'up{job="b"}', 299.999) == 5.0
    assert values(engine, 'up{job="b"}', 300) == {}
    assert one(engine, 'up{job="a",env="prod"}', 59.999) == 0.0
    assert one(engine, 'up{job="a",env="prod"}', 60) == 60.0


def test_both_ways_of_looking_back_agree(spark, engine):
    fine = Engine(spark, engine.catalog, 300_000)
    dense = {(r.job, r.env, r.ts): r.value for r in fine.range_frame("up", 0, 900_000, 30_000).collect()}  # windows overlap ten times
    for at in range(0, 900_001, 90_000):
        single = {(r.job, r.env, r.ts): r.value for r in fine.instant_frame("up", at).collect()}
        assert single == {k: v for k, v in dense.items() if k[2] == at}


def test_envelope_and_labels(engine):
    out = engine.query("up", 600)
    assert out["data"]["resultType"] == "vector"
    assert {"metric": {"__name__": "up", "env": "staging", "job": "a"}, "value": [600.0, "100"]} in out["data"]["result"]
    assert engine.query("up", 600, limit=1)["warnings"] == ["results truncated due to limit"]
    assert len(engine.query("up", 600, limit=2)["data"]["result"]) == 2 and "warnings" not in engine.query("up", 600, limit=2)
    assert engine.query('"x"', 1)["data"] == {"resultType": "string", "result": [1.0, "x"]}
    assert engine.query("1 / 0", 1)["data"] == {"resultType": "scalar", "result": [1.0, "+Inf"]}
    assert engine.query("up[2m]", 600)["data"]["result"][0]["values"] == [[540.0, "540"], [600.0, "600"]]
    ranged = engine.query_range('up{env="prod",job="a"}', 0, 120, "1m")["data"]
    assert ranged == {"resultType": "matrix", "result": [{"metric": {"__name__": "up", "env": "prod", "job": "a", "region": "eu"}, "values": [[0.0, "0"], [60.0, "60"], [120.0, "120"]]}]}


@pytest.mark.parametrize("query", ["up{", "rate(up)", "info(up)"])
def test_bad_queries(engine, query):
    out = engine.query(query, 0)
    assert out["status"] == "error" and out["errorType"] == "bad_data" and out["code"] == 400


def test_bad_parameters(engine):
    assert engine.query("up", "yesterday")["code"] == 400
    assert engine.query_range("up", 10, 0, 1)["code"] == 400
    assert engine.query_range("up", 0, 10, 0)["code"] == 400
    assert "range vector" in engine.query_range("up[5m]", 0, 10, 1)["error"]


def test_counters(engine):
    # 10, 20, 5, 15: increase 10 + 5 + 10 over 180 s of a 240 s window that ends at 200 s: 40 s before it and 20 s after
    at, window = 200, "reqs[4m]"
    raw = 25.0
    zero = 180 * 10 / 25  # never before the counter was zero
    assert one(engine, f"increase({window})", at) == pytest.approx(raw * (180 + min(40, zero) + 20) / 180)
    assert one(engine, f"rate({window})", at) == pytest.approx(raw * 240 / 180 / 240)
    assert one(engine, f"delta({window})", at) == pytest.approx(5 * 240 / 180)
    assert one(engine, f"irate({window})", at) == pytest.approx(10 / 60)
    assert one(engine, f"idelta({window})", at) == 10.0
    assert one(engine, f"resets({window})", at) == 1.0 and one(engine, f"changes({window})", at) == 3.0
    assert one(engine, f"integral({window})", at) == pytest.approx(60 * (15 + 12.5 + 10))
    assert values(engine, "rate(reqs[1m])", 60) == {}  # a single sample


def test_extrapolation_stops_half_an_interval_out(engine):
    # samples at 0..180 in a window of 600: far edges count half a mean interval; the start at most back to zero
    assert one(engine, "delta(reqs[10m])", 400) == pytest.approx(5 * (180 + 30 + 30) / 180)
    assert one(engine, "increase(reqs[10m])", 400) == pytest.approx(25 * (180 + 30 + 30) / 180)


def test_special_values(engine):
    odd = {dict(k)["job"]: v for k, v in values(engine, "odd", 0).items()}
    assert math.isnan(odd["nan"]) and odd["inf"] == math.inf

    def by_job(query):
        return {dict(k).get("job"): v for k, v in values(engine, query, 0).items()}

    assert set(by_job("odd > 0")) == {"one", "inf"} and set(by_job("odd != 1")) == {"nan", "inf", "neg"} and set(by_job("odd == odd")) == {"one", "inf", "neg"}
    assert by_job("odd / 0")["one"] == math.inf and by_job("odd / 0")["neg"] == -math.inf and math.isnan(by_job("(odd * 0) / 0")["one"])
    assert math.isnan(by_job("odd % 0")["one"]) and by_job("odd % 2")["neg"] == -0.5
    assert by_job("floor(odd)")["neg"] == -3.0 and by_job("ceil(odd)")["neg"] == -2.0 and by_job("round(odd)")["neg"] == -2.0 and by_job("floor(odd)")["inf"] == math.inf
    assert math.isnan(by_job("ln(odd)")["neg"]) and by_job("ln(odd * 0)")["one"] == -math.inf
    assert math.isnan(by_job("clamp(odd, 0, 1)")["nan"]) and by_job("clamp(odd, 0, 1)")["inf"] == 1.0 and by_job("clamp(odd, 1, 0)") == {}
    assert one(engine, "max(odd)", 0) == math.inf and one(engine, "min(odd)", 0) == -2.5 and math.isnan(one(engine, "sum(odd)", 0))
    assert one(engine, 'max(odd{job="nan"})', 0) != 0
    assert set(by_job("topk(2, odd)")) == {"inf", "one"} and set(by_job("bottomk(1, odd)")) == {"neg"} and by_job("topk(0, odd)") == {}
    assert values(engine, 'count_values("v", odd)', 0) == {(("v", x),): 1.0 for x in ("NaN", "1", "+Inf", "-2.5")}
    assert math.isnan(by_job("hour(odd)")["nan"]) and by_job("hour(odd)")["one"] == 0.0
    assert one(engine, "quantile(-1, odd)", 0) == -math.inf and one(engine, "quantile(2, odd)", 0) == math.inf


def test_matching_errors(engine):
    assert "many-to-many" in engine.query('up{env="staging"} + on (job) group_left () up', 0)["error"]
    assert "group_left" in engine.query("up + on (env) sum by (env) (up)", 0)["error"]
    assert engine.query("up * on (env) group_left () sum by (env) (up)", 0)["status"] == "success"


def test_names_and_labels(engine):
    assert all("__name__" not in dict(k) for k in values(engine, "-up"))
    assert all("__name__" in dict(k) for k in values(engine, "up > 1"))
    assert all("__name__" in dict(k) for k in values(engine, "last_over_time(up[5m])"))
    assert values(engine, 'label_replace(up{env="staging"}, "x", "$1-${2}$$", "job", "(.)(.*)")') == {(("__name__", "up"), ("env", "staging"), ("job", "a"), ("x", "a-$")): 100.0}
    assert values(engine, 'label_replace(up{env="staging"}, "job", "", "job", ".*")') == {(("__name__", "up"), ("env", "staging")): 100.0}
    assert values(engine, 'label_join(up{env="staging"}, "j", "/", "job", "nope", "env")') == {(("__name__", "up"), ("env", "staging"), ("j", "a//staging"), ("job", "a")): 100.0}
    assert values(engine, 'absent(nope{job="x",env=~"p.*",a="1",a="2"})') == {(("job", "x"),): 1.0} and values(engine, "absent(up)") == {}
    assert values(engine, 'sum by (nope) (up{env="staging"})') == {(): 100.0}


def test_histograms(engine):
    assert one(engine, "histogram_quantile(0.5, lat)", 0) == pytest.approx(0.1 + 0.4 * 15 / 20)
    assert one(engine, "histogram_quantile(0.1, lat)", 0) == pytest.approx(0.05)
    assert one(engine, "histogram_quantile(0.95, lat)", 0) == 1.0
    assert one(engine, "histogram_quantile(1.1, lat)", 0) == math.inf and one(engine, "histogram_quantile(-1, lat)", 0) == -math.inf
    assert math.isnan(one(engine, 'histogram_quantile(0.5, lat{le!="+Inf"})', 0))
    assert one(engine, "histogram_fraction(0, 0.3, lat)", 0) == pytest.approx(20 / 50)
    assert {dict(k)["q"]: v for k, v in values(engine, 'histogram_quantiles(lat, "q", 0.5, 0.1)', 0).items()} == {"0.5": pytest.approx(0.4), "0.1": pytest.approx(0.05)}


def test_time_modifiers(engine):
    assert one(engine, 'up{env="prod",job="a"} offset 2m') == 480.0
    assert one(engine, 'up{env="prod",job="a"} @ 300') == 300.0
    assert one(engine, 'up{env="prod",job="a"} @ 300 offset 1m') == 240.0
    assert one(engine, 'sum_over_time(up{env="prod",job="a"}[3m])') == 600 + 540 + 480
    assert one(engine, 'sum_over_time(up{env="prod",job="a"}[3m:1m] offset 1m)') == 540 + 480 + 420
    assert one(engine, 'max_over_time(sum_over_time(up{env="prod",job="a"}[2m:1m])[2m:1m])') == 1140.0
    rows = engine.range_frame('up{env="prod",job="a"} - up{env="prod",job="a"} @ start()', 60_000, 180_000, 60_000).collect()
    assert sorted((r.ts, r.value) for r in rows) == [(60_000, 0.0), (120_000, 60.0), (180_000, 120.0)]
    assert values(engine, "end() - start()") == 0.0 and values(engine, "time()") == 600.0 and values(engine, "scalar(up)") != 0


def test_sort_order(engine):
    got = [r["metric"].get("job") for r in engine.query("sort(odd)", 0)["data"]["result"]]
    assert got == ["neg", "one", "inf", "nan"]
    assert [r["metric"]["job"] for r in engine.query("sort_desc(odd)", 0)["data"]["result"]] == ["inf", "one", "neg", "nan"]
    assert [r["metric"]["job"] for r in engine.query('sort_by_label_desc(odd, "job")', 0)["data"]["result"]] == ["one", "neg", "nan", "inf"]


def test_natural_order(spark):
    e = Engine(spark, Catalog([Source("x", frame(spark, [("m", f"h{i}", "", 0, 1.0) for i in (10, 2, 1)]))]))
    assert [r["metric"]["job"] for r in e.query('sort_by_label(m, "job")', 0)["data"]["result"]] == ["h1", "h2", "h10"]


def test_metadata(engine):
    assert engine.label_values("env", ["up"], 0, 600)["data"] == ["prod", "staging"]
    assert engine.label_values("env", ["reqs"], 0, 600)["data"] == ["prod"]
    assert engine.label_values("job", None, 0, 600, limit=2) == {"status": "success", "data": ["a", "b"], "warnings": ["results truncated due to limit"]}
    assert engine.label_names(['up{env="staging"}'], 0, 600)["data"] == ["__name__", "env", "job"]
    assert engine.series(['up{env="staging"}'], 0, 600)["data"] == [{"__name__": "up", "env": "staging", "job": "a"}]
    assert engine.series([], 0, 600)["code"] == 400 and engine.series(['{job=""}'], 0, 600)["code"] == 400
    assert engine.config() == {"endpoints": [{"url": "p", "labels": {"env": "prod", "region": "eu"}}, {"url": "s", "labels": {"env": "staging"}}]}
    assert engine.ready() and engine.plan("sum(up)")["expr"] == 'sum({__partition_idx__="0"})' and engine.plan_range("up", 0, 60, 15)["isRange"]


def test_limits(spark, engine):
    small = Engine(spark, engine.catalog, limits=Limits(samples=2))
    assert "exceeds the limit" in small.query("up", 0)["error"] and small.query("sum(up)", 0)["status"] == "success"
    full = Engine(spark, engine.catalog, limits=Limits(concurrent=1))
    with full._slots:
        assert full.query("up", 0)["code"] == 429
    assert full.query("up", 0)["status"] == "success"
    assert threading.active_count() < 50


def test_pruning_reaches_the_source(engine):
    plan = engine.instant_frame('up{env="staging"}', 600_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_catalog_rules(spark):
    df = frame(spark, [("m", "a", "", 0, 1.0)])
    with pytest.raises(ValueError, match="same virtual labels"):
        Catalog([Source("x", df, {"env": "a"}), Source("y", df, {"env": "a"})])
    with pytest.raises(ValueError, match="must not start with __"):
        Catalog([Source("x", df.withColumnRenamed("job", "__job"))]).label_names()
    config = '{"endpoints": [{"url": "u1", "labels": {"env": "a"}}, {"url": "u2", "labels": {"env": "b"}}]}'
    assert Catalog.from_config(config, lambda url: df).virtual_labels() == {"u1": {"env": "a"}, "u2": {"env": "b"}}
    with pytest.raises(ValueError, match="no endpoints"):
        Catalog.from_config("{}", lambda url: df)


def test_failing_source_is_a_warning(spark):
    def broken():
        raise OSError("no route to host")

    e = Engine(spark, Catalog([Source("ok", frame(spark, [("m", "a", "", 0, 1.0)]), {"env": "a"}), Source("bad", broken, {"env": "b"})]))
    out = e.query("m", 0)
    assert out["status"] == "success" and len(out["data"]["result"]) == 1 and "no route to host" in out["warnings"][0]
    e.catalog.strict = True
    assert e.query("m", 0)["status"] == "error"


def test_map_labels_and_timestamps(spark):
    df = spark.sql("SELECT map('__name__', 'm', 'pod', 'x') AS labels, timestamp '1970-01-01 00:01:00' AS ts, 3 AS value UNION ALL SELECT map('__name__', 'm'), timestamp '1970-01-01 00:01:00', 4")
    e = Engine(spark, Catalog([Source("x", df, time="ts", value="value", labels_column="labels")]))
    assert {tuple(sorted(r["metric"].items())): r["value"][1] for r in e.query("m", 60)["data"]["result"]} == {(("__name__", "m"), ("pod", "x")): "3", (("__name__", "m"),): "4"}


def test_a_table_per_metric(spark):
    opened = []

    def table(name, job, value):
        def make():
            opened.append(name)
            return spark.createDataFrame([(job, 0, value)], "job string, t long, v double")

        return make

    e = Engine(spark, Catalog([Source("x", {"up": table("up", "a", 1.0), "reqs": table("reqs", "b", 2.0)}, {"env": "p"}, label_names=["job", "le"])]))
    assert values(e, "up", 0) == {(("__name__", "up"), ("env", "p"), ("job", "a")): 1.0} and opened == ["up"]
    assert set(values(e, '{__name__=~"up|reqs",le=""}', 0).values()) == {1.0, 2.0} and opened == ["up", "reqs"]
    assert values(e, "nope", 0) == {} and e.label_values("__name__", None, 0, 1)["data"] == ["reqs", "up"]
    with pytest.raises(ValueError, match="label_names"):
        Source("y", {"up": table("up", "a", 1.0)})


def test_limit_on_samples_read(spark):
    rows = [("c", f"j{i % 4}", "", 1000 * i, float(i)) for i in range(200)]
    e = Engine(spark, Catalog([Source("x", frame(spark, rows), {"env": "a"})]), limits=Limits(read=5))
    assert "limit of 5 samples" in e.query("sum(count_over_time(c[5m]))", 200)["error"]
    assert "limit of 5 samples" in e.query_range("sum(c)", 0, 200, 50)["error"]
    assert e.query('sum(c{job="nope"})', 200)["status"] == "success"
    assert Engine(spark, e.catalog, limits=Limits(read=200)).query("sum(count_over_time(c[5m]))", 200)["data"]["result"][0]["value"][1] == "200"


def test_equal_label_sets_are_refused(spark):
    df = frame(spark, [("a", "x", "", 0, 1.0), ("b", "x", "", 0, 2.0), ("b", "y", "", 0, 3.0)])
    e = Engine(spark, Catalog([Source("s", df)]))
    for query in ('abs({__name__=~"a|b"})', '-{__name__=~"a|b"}', '{__name__=~"a|b"} * 2', 'count_over_time({__name__=~"a|b"}[5m])', 'label_replace(b, "job", "z", "", "")', 'label_join(b, "job", "-")'):
        assert "same labelset" in e.query(query, 0).get("error", ""), query
    for query in ("abs(b)", '{__name__=~"a|b"} > 0', '+{__name__=~"a|b"}', 'abs({__name__=~"a|b",job="y"})', 'label_replace(b, "job", "${1}z", "job", "(.*)")', 'last_over_time({__name__=~"a|b"}[5m])'):
        assert e.query(query, 0)["status"] == "success", query


def test_a_source_that_fails_while_read_is_a_warning(spark, tmp_path):
    good = frame(spark, [("m", "a", "", 0, 1.0)])
    path = str(tmp_path / "bad")
    good.write.parquet(path)
    bad = spark.read.parquet(path)
    for file in (tmp_path / "bad").glob("*.parquet"):
        file.write_bytes(b"no parquet at all")
    e = Engine(spark, Catalog([Source("ok", good, {"env": "a"}), Source("bad", bad, {"env": "b"})]))
    out = e.query("sum by (env) (m)", 0)
    assert out["status"] == "success" and [r["metric"] for r in out["data"]["result"]] == [{"env": "a"}] and out["warnings"][0].startswith("bad: ")
    found = e.label_values("env", ["m"], 0, 1)
    assert found["data"] == ["a"] and found["warnings"][0].startswith("bad: ")
    assert "warnings" not in e.query("vector(1)", 0) and e.catalog.warnings == []
    e.catalog.strict = True
    assert e.query("m", 0)["status"] == "error"


def test_patterns_mean_the_same_on_every_side(spark):
    df = frame(spark, [("m", "Ab", "", 0, 1.0), ("m", "ab", "", 0, 2.0)])
    e = Engine(spark, Catalog([Source("x", df, {"env": "Prod"}), Source("y", df, {"env": "test"})]))
    assert len(e.query(r'm{env=~"\\p{Lu}.*",job=~"\\p{Lu}.*"}', 0)["data"]["result"]) == 1
    assert len(e.query('m{env=~"(?P<a_b>P).*",job=~"(?P<a_b>A).*"}', 0)["data"]["result"]) == 1
    out = e.query('label_replace(m{env="test"}, "first", "${a_b}", "job", "(?P<a_b>.).*")', 0)["data"]["result"]
    assert sorted(r["metric"]["first"] for r in out) == ["A", "a"]


def test_selectors_of_a_metadata_request_share_a_scan(engine):
    plan = engine.series_frame(['up{job="a",env="prod"}', 'up{job="b",env="prod"}'], 0, 600_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.fixture(scope="module")
def tied(spark):
    """A counter that falls, with samples at one time right after: windows that begin there hold no fall."""
    rows = [("c", "a", "", 0, 100.0), *[("c", "a", "", 60_000, 5.0)] * 3, ("c", "a", "", 120_000, 7.0)]
    return Engine(spark, Catalog([Source("x", frame(spark, rows), {"env": "p"})]))


def by_both_ways(engine, query):
    """The value at 120 s of windows put together from panes and of a single window."""
    found = {r.ts: r.value for r in engine.range_frame(query, 60_000, 180_000, 60_000).collect()}
    assert math.isclose(found[120_000], one(engine, query, 120))
    return found[120_000]


@pytest.mark.parametrize("query, want", [("resets(c[2m])", 0), ("changes(c[2m])", 1), ("integral(c[2m])", 360)])
def test_windows_that_begin_with_samples_at_one_time(tied, query, want):
    assert by_both_ways(tied, query) == want


def test_rate_of_a_window_that_begins_with_samples_at_one_time(tied):
    # 2 more within 60 s, of which a mean interval of 20 s gives 10 s more at the start
    assert math.isclose(by_both_ways(tied, "rate(c[2m])"), 2 * 70 / 60 / 120)


def test_increase_of_a_window_that_begins_with_samples_at_one_time(tied):
    assert math.isclose(by_both_ways(tied, "increase(c[2m])"), 2 * 70 / 60)


def test_sum_of_rates_of_windows_that_begin_with_samples_at_one_time(tied):
    assert math.isclose(by_both_ways(tied, "sum by (env) (rate(c[2m]))"), 2 * 70 / 60 / 120)


def test_median_deviation_of_a_long_window(spark):
    """The median of a window is found once, not for each of its samples."""
    rows = [("m", "a", "", t, float(t * 7919 % 20_011)) for t in range(1, 20_001)]
    e = Engine(spark, Catalog([Source("x", frame(spark, rows), {"env": "p"})]), limits=Limits(seconds=60))
    middle = statistics.median(r[4] for r in rows)
    assert one(e, "mad_over_time(m[20s])", 20) == statistics.median(abs(r[4] - middle) for r in rows)


def test_increase_multiplies_before_it_divides(spark):
    """As its SQL does: 3 more within 100 s, extended by 10 s at either edge, without the rounding of 120 / 100."""
    rows = [("c", "a", "", t, v) for t, v in ((10_000, 100.0), (60_000, 101.0), (110_000, 103.0))]
    assert one(Engine(spark, Catalog([Source("x", frame(spark, rows), {"env": "p"})])), "increase(c[2m])", 120) == 3.6
