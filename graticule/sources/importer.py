"""Query answers of the HTTP API, kept as JSON files or strings, as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "status string, errorType string, error string, warnings array<string>, infos array<string>, "
    "data struct<resultType: string, result: array<struct<metric: map<string,string>, value: array<string>, values: array<array<string>>, histogram: string, histograms: string>>>"
)


def _millis(text: Column) -> Column:
    """Decimal seconds to ms, digits beyond the third cut; anything else is an error."""
    plain = text.rlike(r"\A-?\d+(\.\d*)?\z")
    bad = F.raise_error(F.concat(F.lit("invalid timestamp "), F.coalesce(text, F.lit("null")))).cast("decimal(38,3)")
    exact = F.regexp_replace(text, r"\A(-?\d+)\.?(\d{0,3})\d*\z", "$1.$2")
    return (F.when(plain, F.regexp_replace(exact, r"\.\z", "").cast("decimal(38,3)")).otherwise(bad) * 1000).cast("long")


def _value(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number.isNull(), F.raise_error(F.concat(F.lit("invalid value "), F.coalesce(text, F.lit("null")))).cast("double")).otherwise(number)


def samples(answers: DataFrame, column: str = "value") -> DataFrame:
    """``answers``: one JSON answer per row in ``column`` -> (labels map, t, v).

    An answer with an error status, a malformed one, a series with both or neither of value and values, or a histogram raises.
    """
    parsed = answers.select(F.from_json(column, SCHEMA).alias("a"), F.col(column).alias("raw"))
    status = F.when(F.col("a.status") == "error", F.raise_error(F.concat(F.coalesce("a.errorType", F.lit("unknown")), F.lit(": "), F.coalesce("a.error", F.lit("")))))
    status = status.when(F.coalesce(F.col("a.status"), F.lit("")) != "success", F.raise_error(F.concat(F.lit("malformed answer: "), F.substring("raw", 1, 100))))
    checked = parsed.withColumn("bad", status.otherwise(F.lit(None).cast("void")))
    series = checked.where(F.col("bad").isNull()).select(F.explode("a.data.result").alias("s"))
    one, many = F.col("s.value").isNotNull(), F.col("s.values").isNotNull()
    wrong = F.when(F.col("s.histogram").isNotNull() | F.col("s.histograms").isNotNull(), F.raise_error(F.lit("histogram result type is not supported")))
    wrong = wrong.when(one == many, F.raise_error(F.lit("a series needs either value or values")))
    series = series.withColumn("bad", wrong.otherwise(F.lit(None).cast("void"))).where(F.col("bad").isNull())
    points = series.select(F.coalesce("s.metric", F.create_map().cast("map<string,string>")).alias("labels"), F.explode(F.when(one, F.array("s.value")).otherwise(F.col("s.values"))).alias("p"))
    return points.select("labels", _millis(F.get("p", F.lit(0))).alias("t"), _value(F.get("p", F.lit(1))).alias("v"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a folder of JSON answers, one per file."""
    return samples(spark.read.text(path, wholetext=True))
