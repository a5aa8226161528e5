"""Metrics derived from the driver's tables, dealt to four sources with virtual labels; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import Catalog, Source

BOUNDS = (1, 5, 10, 25, 50, 100)
#: Multiples of this add up exactly in doubles, up to 2^33.
GRAIN = 2.0**-20


def _frames(events: DataFrame, kinds: tuple[str, ...]) -> dict:
    """The metrics of some event types, a frame each, made when a query asks for it."""
    own = events.where(F.col("event_type").isin(*kinds))
    day = F.date_trunc("day", F.col("ts"))

    def metric(df: DataFrame, value) -> DataFrame:
        return df.select("event_type", "shard", "ts", value.alias("v"))

    def total() -> DataFrame:
        running = Window.partitionBy("event_type", "shard", day).orderBy("ts")
        # a plain sum of doubles is off in the sixth decimal after some thousand events; the remainders are too small for that
        rest = F.nanvl(F.col("value") % GRAIN, F.lit(0.0))
        return metric(own.withColumn("c", F.sum(F.col("value") - rest).over(running) + F.sum(rest).over(running)), F.col("c"))

    def buckets() -> DataFrame:
        flags = F.array(*[F.struct(F.lit(str(b)).alias("le"), (F.col("value") <= b).cast("long").alias("n")) for b in BOUNDS], F.struct(F.lit("+Inf").alias("le"), F.lit(1).cast("long").alias("n")))
        daily = own.select("event_type", day.alias("d"), F.explode(flags).alias("b")).groupBy("event_type", "d", "b.le").agg(F.sum("b.n").cast("double").alias("v"))
        return daily.select("event_type", "le", (F.col("d") + F.expr("interval 1 day")).alias("ts"), "v")

    return {
        "event_value": lambda: metric(own, F.col("value")),
        "event_value_total": total,
        "event_unit": lambda: metric(own, F.col("value") % 2 - 1),
        "event_info": lambda: metric(own, F.lit(1.0)),
        "event_value_bucket": buckets,
    }


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value", (F.col("user_id") % 10).cast("string").alias("shard"))

    def source(name: str, kinds: tuple[str, ...], **labels: str) -> Source:
        return Source(name, _frames(events, kinds), labels, time="ts", label_names=["event_type", "shard", "le"])

    return Catalog(
        [
            source("prod-eu", ("click",), env="prod", region="eu"),
            source("prod-us", ("view",), env="prod", region="us"),
            source("staging-eu", ("purchase",), env="staging", region="eu"),
            source("staging-global", ("signup", "error"), env="staging"),
        ]
    )
