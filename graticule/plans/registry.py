"""What the query language accepts: functions with their argument types, aggregations, operators."""

from __future__ import annotations

VECTOR, MATRIX, SCALAR, STRING = "instant vector", "range vector", "scalar", "string"
#: Names that type errors use for a whole query.
RESULT_NAMES = {VECTOR: "instant vector", MATRIX: "range vector", SCALAR: "scalar", STRING: "string"}


class Function:
    def __init__(self, args: str, result: str = VECTOR, optional: int = 0, repeat: bool = False):
        """``args``: one letter an argument (v, m, s, t for string); the last ``optional`` may be missing, the last may repeat."""
        kinds = {"v": VECTOR, "m": MATRIX, "s": SCALAR, "t": STRING}
        self.args, self.result, self.optional, self.repeat = [kinds[a] for a in args], result, optional, repeat


def _all(names: str, args: str, **more) -> dict[str, Function]:
    return {n: Function(args, **more) for n in names.split()}


ELEMENTWISE = "abs acos acosh asin asinh atan atanh ceil cos cosh deg exp floor ln log10 log2 rad sgn sin sinh sqrt tan tanh"
DATES = "day_of_month day_of_week day_of_year days_in_month hour minute month year"
OVER_TIME = (
    "avg_over_time changes count_over_time delta deriv first_over_time idelta increase integral irate last_over_time mad_over_time "
    "max_over_time min_over_time present_over_time rate resets stddev_over_time stdvar_over_time sum_over_time ts_of_first_over_time "
    "ts_of_last_over_time ts_of_max_over_time ts_of_min_over_time"
)
FUNCTIONS: dict[str, Function] = {
    **_all(ELEMENTWISE, "v"),
    **_all(DATES, "v", optional=1),
    **_all(OVER_TIME, "m"),
    **_all("sort sort_desc timestamp absent", "v"),
    **_all("absent_over_time", "m"),
    **_all("clamp_max clamp_min", "vs"),
    **_all("clamp", "vss"),
    **_all("round", "vs", optional=1),
    **_all("double_exponential_smoothing", "mss"),
    **_all("predict_linear", "ms"),
    **_all("quantile_over_time", "sm"),
    **_all("histogram_quantile", "sv"),
    **_all("histogram_fraction", "ssv"),
    **_all("histogram_quantiles", "vts", repeat=True),
    **_all("label_replace", "vtttt"),
    **_all("label_join", "vttt", optional=1, repeat=True),
    **_all("sort_by_label sort_by_label_desc", "vt", optional=1, repeat=True),
    **_all("start end step range pi time", "", result=SCALAR),
    **_all("scalar", "v", result=SCALAR),
    **_all("vector", "s"),
}
UNSUPPORTED_FUNCTIONS = frozenset("histogram_avg histogram_count histogram_stddev histogram_stdvar histogram_sum info max_of min_of start_timestamp".split())

#: Aggregation -> whether partial results of parts can be combined.
AGGREGATIONS = {"sum": True, "avg": True, "count": True, "min": True, "max": True, "group": True, "topk": True, "bottomk": True, "limitk": True, "stddev": False, "stdvar": False, "quantile": False, "count_values": False}
WITH_PARAMETER = {"topk": SCALAR, "bottomk": SCALAR, "limitk": SCALAR, "quantile": SCALAR, "count_values": STRING}
UNSUPPORTED_AGGREGATIONS = frozenset({"limit_ratio"})

ARITHMETIC = ("+", "-", "*", "/", "%", "^", "atan2")
COMPARISON = ("==", "!=", "<=", "<", ">=", ">")
SETS = ("and", "or", "unless")
TRIMS = ("</", ">/")
#: Functions whose results must be ordered as a whole.
ORDERING = frozenset({"sort", "sort_desc", "sort_by_label", "sort_by_label_desc"})
