"""Functions of a window's samples, as aggregates where the order doesn't matter and as folds where it does.

Every function is a pair: the aggregate over rows (labels, __e, __t, __v, and the previous sample __pv at __pt where it is
asked for) and the number of samples that it needs.  Partial aggregation works for all but the folds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import divide


def _v() -> Column:
    return F.col("__v")


def _t() -> Column:
    return F.col("__t")


def _real() -> Column:
    return ~F.isnan("__v")


def _order() -> Column:
    """Sample times, doubled; of samples at one time, that whose predecessor is earlier (or missing) comes before the others."""
    return _t() * 2 + F.when(F.col("__pt") == _t(), 1).otherwise(0)


def _inner_sum(part: Column) -> Column:
    """Sum over a window's neighbouring pairs: all samples' parts but the first's, whose predecessor is outside."""
    part = F.coalesce(part, F.lit(0.0))
    return F.sum(part) - F.min_by(part, _order())


@dataclass(frozen=True)
class Panes:
    """How a window is put together from panes, the stretches between grid times that overlapping windows share.

    ``states`` summarise a pane's samples; ``merged`` combines the states of a window's panes.
    """

    states: Callable[[dict], dict[str, Column]]
    merged: Callable[[dict], Column]


@dataclass(frozen=True)
class WindowFunction:
    value: Callable[[dict], Column]  # ctx: range_ms, args (columns, one value per evaluation time)
    least: int = 1
    previous: bool = False
    keeps_name: bool = False
    panes: Panes | None = None


def _paned(final: Callable[[], Column], **states: Callable[[], Column]) -> Panes:
    return Panes(lambda _: {k: f() for k, f in states.items()}, lambda _: final())


def _inner_panes(part: Callable[[], Column]) -> Panes:
    """``_inner_sum`` over panes: the parts of all samples but the window's first."""
    def filled() -> Column:
        return F.coalesce(part(), F.lit(0.0))

    return Panes(
        lambda _: {"__c": F.sum(filled()), "__fc": F.min_by(filled(), _order()), "__ft": F.min("__t")},
        lambda _: F.sum("__c") - F.min_by("__fc", "__ft"),
    )


def _max(_) -> Column:
    return F.coalesce(F.max(F.when(_real(), _v())), F.lit(float("nan")))


def _reset() -> Column:
    return F.when(_v() < F.col("__pv"), F.col("__pv"))


def _extended(counter: bool, rate: bool, r: float, n: Column, e: Column, first_t: Column, last_t: Column, first_v: Column, last_v: Column, resets: Column) -> Column:
    """The change between a window's first and last sample, extended to the window's edges."""
    d = last_v - first_v + resets
    span = (last_t - first_t) / 1000.0
    mean = span / (n - 1)
    to_start, to_end = (first_t - (e - F.lit(r))) / 1000.0, (e - last_t) / 1000.0
    to_start = F.when(to_start >= mean * 1.1, mean / 2).otherwise(to_start)
    if counter:
        zero = divide(span * first_v, d)
        to_start = F.when((d > 0) & (first_v >= 0) & (zero < to_start), zero).otherwise(to_start)
    to_end = F.when(to_end >= mean * 1.1, mean / 2).otherwise(to_end)
    out = divide(d * (span + to_start + to_end), span)
    return out / (r / 1000.0) if rate else out


def _extrapolated(counter: bool, rate: bool) -> Callable[[dict], Column]:
    def value(ctx: dict) -> Column:
        resets, order = (_inner_sum(_reset()), _order()) if counter else (F.lit(0.0), _t())
        return _extended(counter, rate, float(ctx["range"]), F.count("*"), F.first("__at"), F.min("__t"), F.max("__t"), F.min_by(_v(), order), F.max_by("__v", "__t"), resets)

    return value


def _extrapolated_panes(counter: bool, rate: bool) -> Panes:
    def states(_: dict) -> dict[str, Column]:
        part, order = (F.coalesce(_reset(), F.lit(0.0)), _order()) if counter else (F.lit(0.0), _t())
        return {"__ft": F.min("__t"), "__lt": F.max("__t"), "__fv": F.min_by(_v(), order), "__lv": F.max_by("__v", "__t"), "__c": F.sum(part), "__fc": F.min_by(part, order)}

    def merged(ctx: dict) -> Column:
        resets = F.sum("__c") - F.min_by("__fc", "__ft") if counter else F.lit(0.0)
        return _extended(counter, rate, float(ctx["range"]), F.sum("__n"), F.first("__at"), F.min("__ft"), F.max("__lt"), F.min_by("__fv", "__ft"), F.max_by("__lv", "__lt"), resets)

    return Panes(states, merged)


def _changed() -> Column:
    v, p = _v(), F.col("__pv")
    return F.when(p.isNotNull() & (F.isnan(v) != F.isnan(p)) | (~F.isnan(v) & ~F.isnan(p) & (v != p)), 1.0)


def _seconds() -> Column:
    """Sample time relative to the evaluation time."""
    return (_t() - F.col("__at")) / 1000.0


def sorted_samples() -> Column:
    return F.array_sort(F.collect_list(F.struct(_t().alias("t"), _v().alias("v"))))


def quantile_of(sorted_values: Column, q: Column) -> Column:
    """Linear interpolation in a sorted array; -Inf and +Inf outside [0, 1]."""
    n = F.size(sorted_values)
    rank = F.when(F.isnan(q) | (q < 0) | (q > 1), F.lit(0.0)).otherwise(q) * (n - 1)
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, n - 1)
    weight = rank - low
    a, b = F.get(sorted_values, low), F.get(sorted_values, high)
    inside = F.when(a == b, a).otherwise(a * (1 - weight) + b * weight)
    return F.when(F.isnan(q), F.lit(float("nan"))).when(q < 0, F.lit(float("-inf"))).when(q > 1, F.lit(float("inf"))).otherwise(inside)


def quantile_agg(value: Column, q: float | Column) -> Column:
    if isinstance(q, float):
        if q != q:
            return F.first(F.lit(float("nan")))
        if not 0 <= q <= 1:
            return F.first(F.lit(float("-inf") if q < 0 else float("inf")))
        return F.percentile(value, q).cast("double")
    return quantile_of(F.array_sort(F.collect_list(value)), F.first(q))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _median(values: Column) -> Column:
    return _let(F.sort_array(values), lambda s: quantile_of(s, F.lit(0.5)))


def _mad(_) -> Column:
    values = F.collect_list("__v")
    return _let(_median(values), lambda middle: _median(F.transform(values, lambda x: F.abs(x - middle))))


def _smoothed(ctx: dict) -> Column:
    sf, tf = (F.first(a) for a in ctx["args"])
    s = sorted_samples()
    first, second = F.get(s, F.lit(0))["v"], F.get(s, F.lit(1))["v"]
    start = F.struct(F.lit(0.0).alias("s0"), first.alias("s1"), (second - first).alias("b"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        trend = F.when(a["i"] == 0, a["b"]).otherwise(tf * (a["s1"] - a["s0"]) + (1 - tf) * a["b"])
        return F.struct(a["s1"].alias("s0"), (sf * x["v"] + (1 - sf) * (a["s1"] + trend)).alias("s1"), trend.alias("b"), (a["i"] + 1).alias("i"))

    return F.aggregate(F.slice(s, F.lit(2), F.size(s)), start, step, lambda a: a["s1"])


def _predicted(ctx: dict) -> Column:
    ahead = F.first(ctx["args"][0])
    return F.regr_intercept(_v(), _seconds()) + F.regr_slope(_v(), _seconds()) * ahead


def _fell() -> Column:
    return F.when(_v() < F.col("__pv"), 1.0)


def _trapezoid() -> Column:
    return (_v() + F.col("__pv")) / 2 * (_t() - F.col("__pt")) / 1000.0


def _integral(_) -> Column:
    """Trapezoids between neighbouring samples, in value seconds."""
    return _inner_sum(_trapezoid())


def _irate(_) -> Column:
    last, before = F.max_by("__v", "__t"), F.max_by("__pv", "__t")
    return F.when(last < before, last).otherwise(last - before) / ((F.max("__t") - F.max_by("__pt", "__t")) / 1000.0)


WINDOW: dict[str, WindowFunction] = {
    "avg_over_time": WindowFunction(lambda _: F.avg("__v"), panes=_paned(lambda: F.sum("__s") / F.sum("__n"), __s=lambda: F.sum("__v"))),
    "changes": WindowFunction(lambda _: _inner_sum(_changed()), previous=True, panes=_inner_panes(_changed)),
    "count_over_time": WindowFunction(lambda _: F.count("*").cast("double"), panes=_paned(lambda: F.sum("__n").cast("double"))),
    "delta": WindowFunction(_extrapolated(False, False), 2, panes=_extrapolated_panes(False, False)),
    "deriv": WindowFunction(lambda _: F.regr_slope(_v(), _seconds()), 2),
    "double_exponential_smoothing": WindowFunction(_smoothed, 2),
    "first_over_time": WindowFunction(lambda _: F.min_by("__v", "__t"), keeps_name=True, panes=_paned(lambda: F.min_by("__fv", "__ft"), __fv=lambda: F.min_by("__v", "__t"), __ft=lambda: F.min("__t"))),
    "idelta": WindowFunction(lambda _: F.max_by("__v", "__t") - F.max_by("__pv", "__t"), 2, True),
    "increase": WindowFunction(_extrapolated(True, False), 2, True, panes=_extrapolated_panes(True, False)),
    "integral": WindowFunction(_integral, 2, True, panes=_inner_panes(_trapezoid)),
    "irate": WindowFunction(_irate, 2, True),
    "last_over_time": WindowFunction(lambda _: F.max_by("__v", "__t"), keeps_name=True, panes=_paned(lambda: F.max_by("__lv", "__lt"), __lv=lambda: F.max_by("__v", "__t"), __lt=lambda: F.max("__t"))),
    "mad_over_time": WindowFunction(_mad),
    "max_over_time": WindowFunction(_max, panes=_paned(lambda: F.coalesce(F.max("__m"), F.lit(float("nan"))), __m=lambda: F.max(F.when(_real(), _v())))),
    "min_over_time": WindowFunction(lambda _: F.min("__v"), panes=_paned(lambda: F.min("__m"), __m=lambda: F.min("__v"))),
    "predict_linear": WindowFunction(_predicted, 2),
    "present_over_time": WindowFunction(lambda _: F.max(F.lit(1.0)), panes=_paned(lambda: F.max(F.lit(1.0)))),
    "quantile_over_time": WindowFunction(lambda ctx: quantile_agg(_v(), ctx["args"][0])),
    "rate": WindowFunction(_extrapolated(True, True), 2, True, panes=_extrapolated_panes(True, True)),
    "resets": WindowFunction(lambda _: _inner_sum(_fell()), previous=True, panes=_inner_panes(_fell)),
    "stddev_over_time": WindowFunction(lambda _: F.stddev_pop("__v")),
    "stdvar_over_time": WindowFunction(lambda _: F.var_pop("__v")),
    "sum_over_time": WindowFunction(lambda _: F.sum("__v"), panes=_paned(lambda: F.sum("__s"), __s=lambda: F.sum("__v"))),
    "ts_of_first_over_time": WindowFunction(lambda _: F.min("__t") / 1000.0, panes=_paned(lambda: F.min("__ft") / 1000.0, __ft=lambda: F.min("__t"))),
    "ts_of_last_over_time": WindowFunction(lambda _: F.max("__t") / 1000.0, panes=_paned(lambda: F.max("__lt") / 1000.0, __lt=lambda: F.max("__t"))),
    "ts_of_max_over_time": WindowFunction(lambda _: F.coalesce(F.max_by("__t", F.when(_real(), F.struct("__v", "__t"))), F.max("__t")) / 1000.0),
    "ts_of_min_over_time": WindowFunction(lambda _: F.coalesce(F.min_by("__t", F.when(_real(), F.struct(_v(), -_t()))), F.max("__t")) / 1000.0),
}
