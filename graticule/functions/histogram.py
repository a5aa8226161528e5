"""Classic histograms: quantiles and fractions from cumulative ``le`` buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def buckets() -> Column:
    """Sorted (le, cumulative count) of a group, counts made monotone; null without a +Inf bucket or with one bucket only."""
    raw = F.array_sort(F.collect_list(F.struct(F.col("__le").alias("le"), F.col("__v").alias("n"))))
    # equal bounds (such as "1" and "1.0") add up
    merged = F.aggregate(
        raw, F.array().cast("array<struct<le:double,n:double>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["le"] == x["le"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(x["le"].alias("le"), (F.try_element_at(a, F.lit(-1))["n"] + x["n"]).alias("n"))))).otherwise(F.concat(a, F.array(x))),
    )
    rising = F.aggregate(
        merged, F.array().cast("array<struct<le:double,n:double>>"),
        lambda a, x: F.concat(a, F.array(F.struct(x["le"].alias("le"), F.when(F.size(a) > 0, F.greatest(F.try_element_at(a, F.lit(-1))["n"], x["n"])).otherwise(x["n"]).alias("n")))),
    )
    return rising


def _whole(b: Column) -> Column:
    return (F.size(b) >= 2) & (F.try_element_at(b, F.lit(-1))["le"] == float("inf"))


def quantile(b: Column, q: Column) -> Column:
    """Linear inside a bucket; the lowest starts at 0 if its bound is positive; in the +Inf bucket the highest finite bound."""
    total = F.try_element_at(b, F.lit(-1))["n"]
    rank = q * total
    at = F.coalesce(F.nullif(F.array_position(F.transform(b, lambda x: x["n"] >= rank), F.lit(True)), F.lit(0)), F.size(b)).cast("int")
    hit, before = F.try_element_at(b, at), F.try_element_at(b, at - F.when(at > 1, 1).otherwise(0))
    inside = F.when(
        at == F.size(b), F.try_element_at(b, F.lit(-2))["le"]
    ).when((at == 1) & (hit["le"] <= 0), hit["le"]).otherwise(
        F.when(at > 1, before["le"]).otherwise(F.lit(0.0))
        + (hit["le"] - F.when(at > 1, before["le"]).otherwise(F.lit(0.0))) * (rank - F.when(at > 1, before["n"]).otherwise(F.lit(0.0))) / F.nullif(hit["n"] - F.when(at > 1, before["n"]).otherwise(F.lit(0.0)), F.lit(0.0))
    )
    nan = F.lit(float("nan"))
    return (
        F.when(F.isnan(q), nan).when(~_whole(b), nan).when(total == 0, nan)
        .when(q < 0, F.lit(float("-inf"))).when(q > 1, F.lit(float("inf"))).otherwise(F.coalesce(inside, nan))
    )


def _rank_of(b: Column, x: Column) -> Column:
    """Observations at or below ``x``, linear inside a bucket."""
    at = F.coalesce(F.nullif(F.array_position(F.transform(b, lambda y: y["le"] >= x), F.lit(True)), F.lit(0)), F.size(b)).cast("int")
    hit, before = F.try_element_at(b, at), F.try_element_at(b, at - F.when(at > 1, 1).otherwise(0))
    low = F.when(at > 1, before["le"]).when(hit["le"] > 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
    low_n = F.when(at > 1, before["n"]).otherwise(F.lit(0.0))
    return (
        F.when(x == hit["le"], hit["n"]).when(x <= low, low_n)
        .when(hit["le"] == float("inf"), low_n).when(low == float("-inf"), low_n)
        .otherwise(low_n + (hit["n"] - low_n) * (x - low) / (hit["le"] - low))
    )


def fraction(b: Column, low: Column, high: Column) -> Column:
    """Share of the observations in (low, high]."""
    total = F.try_element_at(b, F.lit(-1))["n"]
    nan = F.lit(float("nan"))
    share = (_rank_of(b, high) - _rank_of(b, low)) / F.nullif(total, F.lit(0.0))
    return F.when(~_whole(b) | F.isnan(low) | F.isnan(high), nan).when(total == 0, nan).when(low >= high, F.lit(0.0)).otherwise(share)
