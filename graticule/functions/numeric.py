"""IEEE arithmetic and elementwise functions as column expressions.

Spark's own operators differ where a metric query needs IEEE results: division by zero, logarithms of non-positives, rounding
to a bigint, NaN that equals itself and exceeds everything.  The expressions here hold under ANSI mode on or off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit(float("nan"))


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), _nan()).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor(x: Column) -> Column:
    r = F.rint(x)
    return F.when(r > x, r - 1).otherwise(r)


def ceil(x: Column) -> Column:
    r = F.rint(x)
    return F.when(r < x, r + 1).otherwise(r)


def _log(kind):
    return lambda x: F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, F.lit(float("-inf"))).otherwise(kind(x))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": F.pow, "atan2": F.atan2}


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: with a NaN only ``!=`` holds."""
    real = ~F.isnan(a) & ~F.isnan(b)
    test = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return ~real | test if op == "!=" else real & test


ELEMENTWISE = {
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "ceil": ceil, "cos": F.cos,
    "cosh": F.cosh, "deg": F.degrees, "exp": F.exp, "floor": floor, "ln": _log(F.log), "log10": _log(F.log10), "log2": _log(F.log2), "rad": F.radians,
    "sgn": F.signum, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}


def clamp(v: Column, low: Column | None, high: Column | None) -> Column:
    """NaN stays NaN, in the value or in a bound."""
    out = v
    if high is not None:
        out = F.when(F.isnan(high) | F.isnan(v), _nan()).otherwise(F.least(high, out))
    if low is not None:
        out = F.when(F.isnan(low) | F.isnan(out), _nan()).otherwise(F.greatest(low, out))
    return out


def round_to(v: Column, to: Column) -> Column:
    """Nearest multiple, ties up."""
    inverse = divide(F.lit(1.0), to)
    return divide(floor(v * inverse + 0.5), inverse)


def _date(part):
    """A part of the UTC date of ``v`` seconds after the epoch; NaN for what is no date."""

    def of(v: Column) -> Column:
        ok = ~F.isnan(v) & (F.abs(v) < 2.5e11)
        whole = F.timestamp_seconds(floor(F.when(ok, v).otherwise(F.lit(0.0))).cast("long"))
        return F.when(ok, part(whole).cast("double")).otherwise(_nan())

    return of


DATES = {
    "day_of_month": _date(F.dayofmonth), "day_of_week": _date(lambda t: F.dayofweek(t) - 1), "day_of_year": _date(F.dayofyear),
    "days_in_month": _date(lambda t: F.dayofmonth(F.last_day(t))), "hour": _date(F.hour), "minute": _date(F.minute), "month": _date(F.month), "year": _date(F.year),
}


def text_of(v: Column) -> Column:
    """Shortest decimal without exponent; +Inf, -Inf, NaN."""
    plain = F.abs(v)
    # a decimal holds every double that Spark prints with an exponent and up to 20 places; whole numbers lose ".0"
    exact = F.regexp_replace(F.regexp_replace(v.cast("string"), r"\.0$", ""), r"^-0$", "-0")
    mantissa = F.regexp_replace(F.regexp_extract(v.cast("string"), r"^-?([\d.]+)E", 1), r"\.0$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    power = F.regexp_extract(v.cast("string"), r"E(-?\d+)$", 1).try_cast("int")
    big = F.when(power + 1 >= F.length(digits), F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    long = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.when(power >= 0, big).otherwise(small))
    return (
        F.when(F.isnan(v), F.lit("NaN"))
        .when(plain == float("inf"), F.when(v > 0, F.lit("+Inf")).otherwise(F.lit("-Inf")))
        .when(F.contains(v.cast("string"), F.lit("E")), long)
        .otherwise(exact)
    )
