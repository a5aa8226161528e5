"""A query for every operator of the metric language over the fixtures, each with the SQL that says the same.

Results have one shape: ``labels`` (name=value pairs in order, empty ones left out), ``ts`` and ``value`` rounded to six
places.  The grid is four weeks by six hours; instant selectors look six hours back, windows are a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources import fixtures

HOUR, DAY = 3_600_000, 86_400_000
START, END, STEP, LOOKBACK = 1_704_153_600_000, 1_706_572_800_000, 6 * HOUR, 6 * HOUR


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, fixtures.catalog(spark, sf_dir), LOOKBACK)


def shaped(df: DataFrame) -> DataFrame:
    labels = sorted(c for c in df.columns if c not in ("ts", "value"))
    pairs = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in labels]
    text = F.concat_ws(",", *pairs) if pairs else F.lit("")
    return df.select(text.alias("labels"), "ts", (F.round("value", 6) + 0.0).alias("value"))


def _ranged(promql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shaped(engine(spark, sf_dir).range_frame(promql, START, END, STEP))


def _instant(promql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shaped(engine(spark, sf_dir).instant_frame(promql, END))


# -- the same data in SQL

_BASE = """(SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS shard, CASE WHEN event_type IN ('click', 'view') THEN 'prod' ELSE 'staging' END AS env,
  CASE event_type WHEN 'click' THEN 'eu' WHEN 'view' THEN 'us' WHEN 'purchase' THEN 'eu' ELSE '' END AS region, ts, epoch_us(ts) // 1000 AS t, value FROM events)"""
_SERIES = {
    "event_value": f"(SELECT event_type, shard, env, region, t, value AS v FROM {_BASE})",
    "event_unit": f"(SELECT event_type, shard, env, region, t, value % 2 - 1 AS v FROM {_BASE})",
    "event_info": f"(SELECT event_type, shard, env, region, t, 1.0::DOUBLE AS v FROM {_BASE})",
    "event_value_total": f"(SELECT event_type, shard, env, region, t, sum(value) OVER (PARTITION BY event_type, shard, date_trunc('day', ts) ORDER BY ts) AS v FROM {_BASE})",
}
_BUCKETS = f"""(SELECT event_type, env, region, le, (epoch_us(d) // 1000) + {DAY} AS t, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS DOUBLE) AS v
  FROM (SELECT *, date_trunc('day', ts) AS d, unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le FROM {_BASE}) GROUP BY event_type, env, region, le, d)"""
_GRID = f"(SELECT unnest(generate_series({START}, {END}, {STEP})) AS e)"
_KEY = "event_type, shard, env, region"


def text_sql(*names: str, metric: str | None = None) -> str:
    parts = [f"'__name__={metric}'"] if metric else []
    parts += [f"CASE WHEN {n} <> '' THEN '{n}=' || {n} END" for n in sorted(names)]
    return f"concat_ws(',', {', '.join(parts)})" if parts else "''"


_L = text_sql("env", "event_type", "region", "shard")


def named(metric: str) -> str:
    return text_sql("env", "event_type", "region", "shard", metric=metric)


def inst(metric: str, where: str = "true", offset: int = 0, at: int | None = None) -> str:
    """Newest sample within the lookback per series and grid time."""
    e = f"{at}" if at is not None else "e"
    return f"(SELECT {_KEY}, e, arg_max(v, t) AS v, max(t) AS t FROM {_SERIES[metric]} s JOIN {_GRID} g ON t + {offset} > {e} - {LOOKBACK} AND t + {offset} <= {e} WHERE {where} GROUP BY {_KEY}, e)"


def win(metric: str, where: str = "true", offset: int = 0, span: int = DAY, at: int | None = None) -> str:
    """Samples of each window, with the one before."""
    e = f"{at}" if at is not None else "e"
    order = f"PARTITION BY {_KEY}, e ORDER BY t"
    return f"(SELECT {_KEY}, e, t, v, lag(v) OVER ({order}) AS p, lag(t) OVER ({order}) AS pt FROM {_SERIES[metric]} s JOIN {_GRID} g ON t + {offset} > {e} - {span} AND t + {offset} <= {e} WHERE {where})"


def out(labels: str, value: str, source: str, rest: str = "", e: str = "e") -> str:
    return f"SELECT {labels} AS labels, CAST({e} AS BIGINT) AS ts, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM {source} {rest}"


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def add(name: str, promql: str, sql: str | None, instant: bool = False) -> None:
    _QUERIES[f"promql_{name}"] = (_instant if instant else _ranged)(promql)
    if sql:
        _SQL[f"promql_{name}"] = sql


# -- selectors

for _name, _matcher, _where in (
    ("selector_bare", "", "true"),
    ("selector_eq", '{env="prod"}', "env = 'prod'"),
    ("selector_neq", '{env!="prod"}', "env <> 'prod'"),
    ("selector_re", '{event_type=~"cl.*|error"}', "(event_type LIKE 'cl%' OR event_type = 'error')"),
    ("selector_nre", '{shard!~"[0-7]"}', "shard IN ('8', '9')"),
    ("selector_empty_virtual_eq", '{region=""}', "region = ''"),
    ("selector_empty_virtual_neq", '{region!=""}', "region <> ''"),
    ("selector_combined", '{shard="3",env="staging",region="eu"}', "shard = '3' AND env = 'staging' AND region = 'eu'"),
    ("selector_missing_label", '{le=""}', "true"),
):
    add(_name, f"event_value{_matcher}", out(named("event_value"), "v", inst("event_value", _where)))
add("selector_nameless", '{event_type="click",__name__=~"event_(unit|info)"}', " UNION ALL ".join(out(named(m), "v", inst(m, "event_type = 'click'")) for m in ("event_unit", "event_info")))
add("selector_offset", "event_value offset 1d", out(named("event_value"), "v", inst("event_value", offset=DAY)))
add("selector_offset_negative", "event_value offset -6h", out(named("event_value"), "v", inst("event_value", offset=-6 * HOUR)))
for _at, _ms in (("start()", START), ("end()", END), ("1705000000", 1_705_000_000_000)):
    add(f"selector_at_{_at.strip('()')}", f"event_value @ {_at}", out(named("event_value"), "v", inst("event_value", at=_ms)))
add("selector_at_offset", "event_value @ end() offset 1d", out(named("event_value"), "v", inst("event_value", at=END, offset=DAY)))
add("matrix_selector", "event_value[1d]", f"SELECT {named('event_value')} AS labels, t AS ts, round(v, 6) + 0.0 AS value FROM {win('event_value')} WHERE e = {END}", instant=True)
add("unary_minus", "-event_value", out(_L, "-v", inst("event_value")))
add("paren", "(event_value)", out(named("event_value"), "v", inst("event_value")))
add("number", "1 + 2 * 3 ^ 2", out("''", "19.0", _GRID))

# -- aggregations

_AGG = {"sum": "sum(v)", "avg": "avg(v)", "count": "count(*)", "min": "min(v)", "max": "max(v)", "group": "1.0", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}
for _op, _sql in _AGG.items():
    # sevenths have no last decimal, so that rounding to six places meets no ties
    _arg, _sql = ("event_value / 7", _sql.replace("(v)", "(v / 7)")) if _op in ("avg", "stddev", "stdvar") else ("event_value", _sql)
    add(f"agg_{_op}", f"{_op}({_arg})", out("''", _sql, inst("event_value"), "GROUP BY e"))
    add(f"agg_{_op}_by", f"{_op} by (env, shard) ({_arg})", out(text_sql("env", "shard"), _sql, inst("event_value"), "GROUP BY env, shard, e"))
add("agg_sum_without", "sum without (shard, env) (event_value)", out(text_sql("event_type", "region"), "sum(v)", inst("event_value"), "GROUP BY event_type, region, e"))
add("agg_sum_by_missing", "sum by (nope, env) (event_value)", out(text_sql("env"), "sum(v)", inst("event_value"), "GROUP BY env, e"))
add("agg_of_agg", "avg(sum by (env) (event_value))", out("''", "avg(v)", f"(SELECT env, e, sum(v) AS v FROM {inst('event_value')} GROUP BY env, e)", "GROUP BY e"))
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY {by}e ORDER BY {order}env, event_type, region, shard) AS rn FROM {s})"
for _op, _order in (("topk", "v DESC, "), ("bottomk", "v, "), ("limitk", "")):
    add(f"agg_{_op}", f"{_op}(3, event_value)", out(named("event_value"), "v", _RANKED.format(by="", order=_order, s=inst("event_value")), "WHERE rn <= 3"))
    add(f"agg_{_op}_by", f"{_op} by (env) (2, event_value)", out(named("event_value"), "v", _RANKED.format(by="env, ", order=_order, s=inst("event_value")), "WHERE rn <= 2"))
add(
    "agg_topk_varying", 'topk(scalar(count(event_value{env="prod"})), event_value{env="staging"})',
    out(named("event_value"), "r.v", _RANKED.format(by="", order="v DESC, ", s=inst("event_value", "env = 'staging'")) + f" r JOIN (SELECT e, count(*) AS k FROM {inst('event_value', "env = 'prod'")} GROUP BY e) c ON r.e = c.e", "WHERE rn <= k", e="r.e"),
)
add("agg_quantile", "quantile(0.9, event_value)", out("''", "quantile_cont(v, 0.9)", inst("event_value"), "GROUP BY e"))
add("agg_quantile_by", "quantile by (env, region) (0.5, event_value)", out(text_sql("env", "region"), "quantile_cont(v, 0.5)", inst("event_value"), "GROUP BY env, region, e"))
add("agg_quantile_outside", "quantile(1.5, event_value) > 0", out("''", "'Infinity'::DOUBLE", f"(SELECT DISTINCT e FROM {inst('event_value')})"))
add("agg_count_values", 'count_values by (env) ("v", round(event_value, 50))', out("'env=' || env || ',v=' || CAST(CAST(floor(v * (1.0 / 50) + 0.5) / (1.0 / 50) AS BIGINT) AS VARCHAR)", "count(*)", inst("event_value"), "GROUP BY env, floor(v * (1.0 / 50) + 0.5), e, CAST(CAST(floor(v * (1.0 / 50) + 0.5) / (1.0 / 50) AS BIGINT) AS VARCHAR)"))

# -- elementwise functions

_UNIT = {"acos": "acos(v)", "asin": "asin(v)", "atanh": "atanh(v)", "exp": "exp(v)", "cosh": "cosh(v)", "sinh": "sinh(v)", "tanh": "tanh(v)", "abs": "abs(v)", "sgn": "sign(v)", "tan": "tan(v)"}
_PLAIN = {"acosh": "acosh(v)", "asinh": "asinh(v)", "atan": "atan(v)", "ceil": "ceil(v)", "floor": "floor(v)", "cos": "cos(v)", "sin": "sin(v)", "deg": "degrees(v)", "rad": "radians(v)", "sqrt": "sqrt(v)", "log10": "log10(v)", "log2": "log2(v)", "ln": "ln(v)"}
for _op, _sql in _UNIT.items():
    add(f"fn_{_op}", f"{_op}(event_unit)", out(_L, _sql, inst("event_unit")))
for _op, _sql in _PLAIN.items():
    _inner = "clamp_min(event_value, 1)" if _op == "acosh" else "event_value"
    add(f"fn_{_op}", f"{_op}({_inner})", out(_L, _sql.replace("v", "greatest(v, 1.0)") if _op == "acosh" else _sql, inst("event_value")))
add("fn_clamp", "clamp(event_value, 20, 100)", out(_L, "least(greatest(v, 20), 100)", inst("event_value")))
add("fn_clamp_min", "clamp_min(event_value, 50)", out(_L, "greatest(v, 50)", inst("event_value")))
add("fn_clamp_max", "clamp_max(event_value, 50)", out(_L, "least(v, 50)", inst("event_value")))
add("fn_round", "round(event_value)", out(_L, "floor(v + 0.5)", inst("event_value")))
add("fn_round_to", "round(event_value, 4)", out(_L, "floor(v * 0.25 + 0.5) / 0.25", inst("event_value")))

# -- dates and times

_DATE = {"day_of_month": "day", "day_of_week": "dow", "day_of_year": "doy", "hour": "hour", "minute": "minute", "month": "month", "year": "year"}
for _op, _part in _DATE.items():
    add(f"fn_{_op}", f"{_op}(timestamp(event_value) * 13)", out(_L, f"date_part('{_part}', make_timestamp(CAST(floor(t / 1000.0 * 13) AS BIGINT) * 1000000))", inst("event_value")))
add("fn_days_in_month", "days_in_month(timestamp(event_value) * 13)", out(_L, "date_part('day', last_day(make_timestamp(CAST(floor(t / 1000.0 * 13) AS BIGINT) * 1000000)))", inst("event_value")))
add("fn_hour_now", "hour()", out("''", "date_part('hour', make_timestamp(e * 1000))", _GRID))
add("fn_time", "time()", out("''", "e / 1000.0", _GRID))
add("fn_timestamp", "timestamp(event_value)", out(_L, "t / 1000.0", inst("event_value")))
add("fn_timestamp_other", "timestamp(abs(event_value))", out(_L, "e / 1000.0", inst("event_value")))
for _op, _value in (("start", START / 1000), ("end", END / 1000), ("step", STEP / 1000), ("range", (END - START) / 1000), ("pi", 3.141592653589793)):
    add(f"fn_{_op}", f"event_value * 0 + {_op}()", out(_L, f"v * 0 + {_value!r}", inst("event_value")))
add("fn_vector", "vector(42)", out("''", "42.0", _GRID))
add("fn_scalar", 'scalar(sum(event_value{shard="1",event_type="view"}))', out("''", "coalesce(x.v, 'NaN'::DOUBLE)", f"{_GRID} g LEFT JOIN (SELECT e, sum(v) AS v FROM {inst('event_value', "shard = '1' AND event_type = 'view'")} GROUP BY e) x ON g.e = x.e", e="g.e"))

# -- windows

_OVER = {
    "avg_over_time": "avg(v)", "sum_over_time": "sum(v)", "count_over_time": "count(*)", "min_over_time": "min(v)", "max_over_time": "max(v)", "present_over_time": "1.0",
    "stddev_over_time": "stddev_pop(v)", "stdvar_over_time": "var_pop(v)", "mad_over_time": "mad(v)", "ts_of_first_over_time": "min(t) / 1000.0", "ts_of_last_over_time": "max(t) / 1000.0",
    "ts_of_max_over_time": "arg_max(t, {'v': v, 't': t}) / 1000.0", "ts_of_min_over_time": "arg_min(t, {'v': v, 't': -t}) / 1000.0", "changes": "sum(CASE WHEN p IS NOT NULL AND v <> p THEN 1 ELSE 0 END)",
}
_BY = f"GROUP BY {_KEY}, e"
for _op, _sql in _OVER.items():
    add(f"fn_{_op}", f"{_op}(event_value[1d])", out(_L, _sql, win("event_value"), _BY))
add("fn_first_over_time", "first_over_time(event_value[1d])", out(named("event_value"), "arg_min(v, t)", win("event_value"), _BY))
add("fn_last_over_time", "last_over_time(event_value[1d])", out(named("event_value"), "arg_max(v, t)", win("event_value"), _BY))
add("fn_quantile_over_time", "quantile_over_time(0.9, event_value[1d])", out(_L, "quantile_cont(v, 0.9)", win("event_value"), _BY))
_SORTED = "list_sort(list(v))"
add(
    "fn_quantile_over_time_varying", "quantile_over_time(scalar(count(event_info)) / 100, event_value[1d])",
    out(text_sql("env", "event_type", "region", "shard"), "s[1 + CAST(floor(least(k, 1.0) * (len(s) - 1)) AS BIGINT)] * (1 - (least(k, 1.0) * (len(s) - 1) - floor(least(k, 1.0) * (len(s) - 1)))) + s[least(len(s), 2 + CAST(floor(least(k, 1.0) * (len(s) - 1)) AS BIGINT))] * (least(k, 1.0) * (len(s) - 1) - floor(least(k, 1.0) * (len(s) - 1)))",
        f"(SELECT {_KEY}, e, {_SORTED} AS s FROM {win('event_value')} {_BY}) w JOIN (SELECT e, count(*) / 100.0 AS k FROM {inst('event_info')} GROUP BY e) c USING (e)"),
)
add("fn_resets", "resets(event_value_total[3d])", out(_L, "sum(CASE WHEN v < p THEN 1 ELSE 0 END)", win("event_value_total", span=3 * DAY), _BY))
add("fn_idelta", "idelta(event_value[1d])", out(_L, "arg_max(v - p, t)", win("event_value"), _BY + " HAVING count(*) > 1"))
add("fn_irate", "irate(event_value_total[1d])", out(_L, "arg_max(CASE WHEN v < p THEN v ELSE v - p END / ((t - pt) / 1000.0), t)", win("event_value_total"), _BY + " HAVING count(*) > 1"))
add("fn_deriv", "deriv(event_value[1d])", out(_L, "regr_slope(v, (t - e) / 1000.0)", win("event_value"), _BY + " HAVING count(*) > 1"))
add("fn_predict_linear", "predict_linear(event_value[1d], 3600)", out(_L, "regr_intercept(v, (t - e) / 1000.0) + regr_slope(v, (t - e) / 1000.0) * 3600", win("event_value"), _BY + " HAVING count(*) > 1"))
add("fn_integral", "integral(event_value[1d])", out(_L, "sum((v + p) / 2 * (t - pt) / 1000.0)", win("event_value"), _BY + " HAVING count(*) > 1"))
add(
    "fn_double_exponential_smoothing", "double_exponential_smoothing(event_value[1d], 0.37, 0.29)",
    out(_L, """list_reduce(list({'s0': 0.0::DOUBLE, 's1': v, 'b': 0.0::DOUBLE, 'i': 0, 'v': v} ORDER BY t), lambda a, x: {
      's0': a.s1, 's1': 0.37 * x.v + 0.63 * (a.s1 + CASE WHEN a.i = 0 THEN x.v - a.v ELSE 0.29 * (a.s1 - a.s0) + 0.71 * a.b END),
      'b': CASE WHEN a.i = 0 THEN x.v - a.v ELSE 0.29 * (a.s1 - a.s0) + 0.71 * a.b END, 'i': a.i + 1, 'v': x.v}).s1""", win("event_value"), _BY + " HAVING count(*) > 1"),
)


def extrapolated(metric: str, counter: bool, rate: bool, where: str = "true") -> str:
    """(series, e, v): the increase of a window, extrapolated to its edges."""
    start = "CASE WHEN ds0 >= av * 1.1 THEN av / 2 ELSE ds0 END"
    if counter:
        start = f"CASE WHEN d > 0 AND fv >= 0 AND si * fv / d < {start} THEN si * fv / d ELSE {start} END"
    return f"""(SELECT {_KEY}, e, d * (si + {start} + CASE WHEN de0 >= av * 1.1 THEN av / 2 ELSE de0 END) / si {'/ 86400.0' if rate else ''} AS v FROM (
      SELECT {_KEY}, e, arg_min(v, t) AS fv, arg_max(v, t) - arg_min(v, t) + {'sum(CASE WHEN v < p THEN p ELSE 0 END)' if counter else '0'} AS d, (max(t) - min(t)) / 1000.0 AS si,
        (max(t) - min(t)) / 1000.0 / (count(*) - 1) AS av, (min(t) - (e - {DAY})) / 1000.0 AS ds0, (e - max(t)) / 1000.0 AS de0
      FROM {win(metric, where)} {_BY} HAVING count(*) > 1))"""


add("fn_rate", "rate(event_value_total[1d]) * 86400", out(_L, "v * 86400", extrapolated("event_value_total", True, True)))
add("fn_increase", "increase(event_value_total[1d])", out(_L, "v", extrapolated("event_value_total", True, False)))
add("fn_delta", "delta(event_value[1d])", out(_L, "v", extrapolated("event_value", False, False)))
add("sum_rate", "sum by (env) (rate(event_value_total[1d]))", out("'env=' || env", "sum(v)", extrapolated("event_value_total", True, True), "GROUP BY env, e"))

# -- labels and sorts

add("fn_label_replace", 'label_replace(event_value, "svc", "$1-x", "event_type", "(c.*|v.*)")', out(f"{named('event_value')} || CASE WHEN event_type IN ('click', 'view') THEN ',svc=' || event_type || '-x' ELSE '' END", "v", inst("event_value")))
add("fn_label_join", 'label_join(event_value, "loc", "-", "env", "region")', out(f"concat_ws(',', '__name__=event_value', 'env=' || env, 'event_type=' || event_type, 'loc=' || env || '-' || region, CASE WHEN region <> '' THEN 'region=' || region END, 'shard=' || shard)", "v", inst("event_value")))
for _op, _args in (("sort", ""), ("sort_desc", ""), ("sort_by_label", ', "env", "shard"'), ("sort_by_label_desc", ', "shard"')):
    add(f"fn_{_op}", f"{_op}(event_value{_args})", out(named("event_value"), "v", inst("event_value"), f"WHERE e = {END}"), instant=True)

# -- absence

add("fn_absent", 'absent(event_value{event_type="view",shard="7"})', out("'event_type=view,shard=7'", "1.0", _GRID, f"WHERE e NOT IN (SELECT e FROM {inst('event_value', "event_type = 'view' AND shard = '7'")})"))
add("fn_absent_nonexistent", 'absent(nope{env="prod"})', out("'env=prod'", "1.0", _GRID))
add("fn_absent_over_time", 'absent_over_time(event_value{shard="7",env="prod"}[6h])', out("'env=prod,shard=7'", "1.0", _GRID, f"WHERE e NOT IN (SELECT e FROM {win('event_value', "env = 'prod' AND shard = '7'", span=6 * HOUR)})"))

# -- binary operators

_PAIR = f"{inst('event_value')} a JOIN {inst('event_unit')} b USING ({_KEY}, e)"
_OPS = {"+": ("add", "a.v + b.v"), "-": ("sub", "a.v - b.v"), "*": ("mul", "a.v * b.v"), "/": ("div", "a.v / CASE WHEN b.v = 0 THEN NULL ELSE b.v END"), "%": ("mod", "a.v % b.v"), "^": ("pow", "a.v ^ b.v"), "atan2": ("atan2", "atan2(a.v, b.v)")}
for _op, (_name, _sql) in _OPS.items():
    _guard = " != 0" if _op in ("/", "%") else ""
    add(f"bin_{_name}", f"event_value {_op} (event_unit{_guard})", out(_L, _sql, _PAIR, "WHERE b.v <> 0" if _guard else ""))
_COMPARE = {"==": ("eq", "="), "!=": ("ne", "<>"), "<": ("lt", "<"), "<=": ("le", "<="), ">": ("gt", ">"), ">=": ("ge", ">=")}
for _op, (_name, _sql) in _COMPARE.items():
    add(f"bin_{_name}", f"event_value {_op} (event_unit * 50)", out(named("event_value"), "a.v", _PAIR, f"WHERE a.v {_sql} b.v * 50"))
    add(f"bin_{_name}_bool", f"event_value {_op} bool (event_unit * 50)", out(_L, f"CASE WHEN a.v {_sql} b.v * 50 THEN 1 ELSE 0 END", _PAIR))
    add(f"bin_{_name}_scalar", f"event_value {_op} 50", out(named("event_value"), "v", inst("event_value"), f"WHERE v {_sql} 50"))
add("bin_eq_all", "event_info == (event_unit * 0 + 1)", out(named("event_info"), "v", inst("event_info")))
add("bin_eq_scalar_all", "event_info == 1", out(named("event_info"), "v", inst("event_info")))
add("bin_scalar_left", "50 < event_value", out(named("event_value"), "v", inst("event_value"), "WHERE 50 < v"))
add("bin_scalar_relation", "event_value / scalar(sum(event_info))", out(_L, "a.v / b.v", f"{inst('event_value')} a JOIN (SELECT e, sum(v) AS v FROM {inst('event_info')} GROUP BY e) b USING (e)"))
add("bin_division_by_zero", "event_value / 0", out(_L, "'Infinity'::DOUBLE", inst("event_value")))
_SUMS = f"(SELECT {{k}}, e, sum(v) AS v FROM {{s}} GROUP BY {{k}}, e)"
add("bin_on", 'event_value{event_type="click"} + on (shard) event_unit{event_type="view"}', out("'shard=' || shard", "a.v + b.v", f"{inst('event_value', "event_type = 'click'")} a JOIN {inst('event_unit', "event_type = 'view'")} b USING (shard, e)"))
add("bin_ignoring", 'sum by (env, shard) (event_value{env="prod"}) - ignoring (env) sum by (env, shard) (event_value{env="staging"})', out("'shard=' || shard", "a.v - b.v", f"{_SUMS.format(k='shard', s=inst('event_value', "env = 'prod'"))} a JOIN {_SUMS.format(k='shard', s=inst('event_value', "env = 'staging'"))} b USING (shard, e)"))
add("bin_group_left", "event_value / on (env, shard) group_left () sum by (env, shard) (event_value)", out(_L, "a.v / b.v", f"{inst('event_value')} a JOIN {_SUMS.format(k='env, shard', s=inst('event_value'))} b USING (env, shard, e)"))
add("bin_group_left_include", 'event_value{env="prod"} * on (shard) group_left (region) sum by (shard, region) (event_unit{event_type="purchase"})', out("concat_ws(',', 'env=' || a.env, 'event_type=' || a.event_type, 'region=eu', 'shard=' || shard)", "a.v * b.v", f"{inst('event_value', "env = 'prod'")} a JOIN {_SUMS.format(k='shard', s=inst('event_unit', "event_type = 'purchase'"))} b USING (shard, e)"))
add("bin_group_right", "sum by (env, shard) (event_unit) - on (env, shard) group_right () event_value", out(_L, "b.v - a.v", f"{inst('event_value')} a JOIN {_SUMS.format(k='env, shard', s=inst('event_unit'))} b USING (env, shard, e)"))
add("bin_group_left_vector", "event_value * on () group_left () vector(2)", out(_L, "v * 2", inst("event_value")))
add("bin_disjoint", 'event_value{env="prod"} + event_value{env="staging"}', out(_L, "v", inst("event_value"), "WHERE false"))

# -- set operators

_FULL, _HALF = inst("event_value"), inst("event_unit", "shard IN ('1', '2', '3')")
add("set_and", 'event_value and event_unit{shard=~"[1-3]"}', out(named("event_value"), "v", f"{_FULL} a", f"WHERE EXISTS (SELECT 1 FROM {_HALF} b WHERE (a.event_type, a.shard, a.env, a.region, a.e) = (b.event_type, b.shard, b.env, b.region, b.e))"))
add("set_unless", 'event_value unless event_unit{shard=~"[1-3]"}', out(named("event_value"), "v", f"{_FULL} a", f"WHERE NOT EXISTS (SELECT 1 FROM {_HALF} b WHERE (a.event_type, a.shard, a.env, a.region, a.e) = (b.event_type, b.shard, b.env, b.region, b.e))"))
_LEFT = inst("event_value", "env = 'prod'")
add("set_or", 'event_value{env="prod"} or ignoring (env, region, event_type) event_unit', out(named("event_value"), "v", _LEFT) + " UNION ALL " + out(named("event_unit"), "v", f"{inst('event_unit')} b", f"WHERE NOT EXISTS (SELECT 1 FROM {_LEFT} a WHERE a.shard = b.shard AND a.e = b.e)"))
add("set_and_on", 'event_value and on (shard) event_unit{event_type="error"}', out(named("event_value"), "v", f"{_FULL} a", f"WHERE EXISTS (SELECT 1 FROM {inst('event_unit', "event_type = 'error'")} b WHERE a.shard = b.shard AND a.e = b.e)"))

# -- subqueries

_SUB = 6 * HOUR
_INNER_GRID = f"(SELECT unnest(generate_series(({START} - {DAY}) // {_SUB} * {_SUB}, {END}, {_SUB})) AS k)"
_INNER = f"(SELECT env, k AS t, sum(v) AS v FROM (SELECT {_KEY}, k, arg_max(v, t) AS v FROM {_SERIES['event_value']} s JOIN {_INNER_GRID} g ON t > k - {LOOKBACK} AND t <= k GROUP BY {_KEY}, k) GROUP BY env, k)"
add("subquery", "avg_over_time(sum by (env) (event_value)[1d:6h])", out("'env=' || env", "avg(v)", f"{_INNER} s JOIN {_GRID} g ON t > e - {DAY} AND t <= e", "GROUP BY env, e"))
add("subquery_offset", "max_over_time(sum by (env) (event_value)[12h:6h] offset 12h)", out("'env=' || env", "max(v)", f"{_INNER} s JOIN {_GRID} g ON t > e - {DAY} AND t <= e - {12 * HOUR}", "GROUP BY env, e"))
_SECOND = f"(SELECT env, k AS t, min(v) AS v FROM {_INNER} s JOIN {_INNER_GRID} g ON t > k - {12 * HOUR} AND t <= k GROUP BY env, k)"
add("subquery_nested", "sum_over_time(min_over_time(sum by (env) (event_value)[12h:6h])[12h:6h])", out("'env=' || env", "sum(v)", f"{_SECOND} s JOIN {_GRID} g ON t > e - {12 * HOUR} AND t <= e", "GROUP BY env, e"))

# -- histograms

_HIST = f"(SELECT env, region, e, le, sum(v) AS v FROM (SELECT event_type, env, region, le, e, arg_max(v, t) AS v FROM {_BUCKETS} s JOIN {_GRID} g ON t > e - {LOOKBACK} AND t <= e GROUP BY event_type, env, region, le, e) GROUP BY env, region, e, le)"
_RISING = f"(SELECT *, max(v) OVER w AS n, sum(1) OVER w AS i, lag(v, 1, 0.0) OVER w AS pn, lag(le, 1, 0.0) OVER w AS ple, max(v) OVER (PARTITION BY env, region, e) AS total FROM {_HIST} WINDOW w AS (PARTITION BY env, region, e ORDER BY le))"


def quantile_sql(q: float) -> str:
    """The bucket that the rank falls in, linear between its bounds; the highest finite bound in the last."""
    return f"(SELECT env, region, e, arg_min(CASE WHEN le = 'Infinity' THEN ple ELSE ple + (le - ple) * ({q} * total - pn) / (n - pn) END, le) AS v FROM {_RISING} WHERE n >= {q} * total AND total > 0 GROUP BY env, region, e)"


_BUCKET_SUM = "sum by (env, region, le) (event_value_bucket)"
add("fn_histogram_quantile", f"histogram_quantile(0.9, {_BUCKET_SUM})", out(text_sql("env", "region"), "v", quantile_sql(0.9)))
add("fn_histogram_quantile_low", f"histogram_quantile(0.2, {_BUCKET_SUM})", out(text_sql("env", "region"), "v", quantile_sql(0.2)))
add("fn_histogram_quantiles", f'histogram_quantiles({_BUCKET_SUM}, "phi", 0.5, 0.9)', " UNION ALL ".join(out(f"concat_ws(',', 'env=' || env, 'phi={q}', CASE WHEN region <> '' THEN 'region=' || region END)", "v", quantile_sql(q)) for q in (0.5, 0.9)))
add("fn_histogram_fraction", f"histogram_fraction(0, 25, {_BUCKET_SUM})", out(text_sql("env", "region"), "max(CASE WHEN le = 25 THEN v END) / max(v)", _HIST, "GROUP BY env, region, e"))

# -- metadata


def _metadata(ask: Callable[[Engine], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ask(engine(spark, sf_dir))


_QUERIES["promql_series"] = _metadata(lambda e: e.series_frame(['event_value{env="prod"}', 'event_unit{region="eu"}'], START, END).select("__name__", "env", "event_type", "region", "shard"))
_SQL["promql_series"] = f"SELECT DISTINCT 'event_value' AS __name__, env, event_type, region, shard FROM {_SERIES['event_value']} WHERE env = 'prod' AND t BETWEEN {START} AND {END} UNION SELECT DISTINCT 'event_unit', env, event_type, region, shard FROM {_SERIES['event_unit']} WHERE region = 'eu' AND t BETWEEN {START} AND {END}"
_QUERIES["promql_label_names"] = _metadata(lambda e: e.label_names_frame(['event_value{env="staging",region=""}'], START, END))
_SQL["promql_label_names"] = f"SELECT unnest(['__name__', 'env', 'event_type', 'shard']) AS name WHERE EXISTS (SELECT 1 FROM {_SERIES['event_value']} WHERE region = '' AND t BETWEEN {START} AND {END})"
_QUERIES["promql_label_values"] = _metadata(lambda e: e.label_values_frame("shard", ["event_value"], START, END))
_SQL["promql_label_values"] = f"SELECT DISTINCT shard AS value FROM {_SERIES['event_value']} WHERE t BETWEEN {START} AND {END}"
_QUERIES["promql_label_values_virtual"] = _metadata(lambda e: e.label_values_frame("env", ['event_value{event_type="purchase"}'], START, END))
_SQL["promql_label_values_virtual"] = f"SELECT DISTINCT env AS value FROM {_SERIES['event_value']} WHERE event_type = 'purchase' AND t BETWEEN {START} AND {END}"

QUERIES, ORACLES = _QUERIES, _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["promql_sum_rate"](spark, sf_dir)
