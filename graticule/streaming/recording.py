"""Recording rules over streams of samples: an aggregation by labels over windows of event time.

A rule is ``op by (labels) (function(metric[range]))`` evaluated every ``step``: samples are filtered and summarised in
event-time windows of ``range`` sliding by ``step``; a window is final once the watermark has passed it, and late samples
within ``delay`` still count.  Windows are (end - range, end], as those of range selectors: Spark's hold their start instead,
so event times are moved back by the microsecond that is their smallest unit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parser import parse_selector
from ..sources.catalog import condition

_PER_WINDOW = {"sum_over_time": F.sum, "avg_over_time": F.avg, "min_over_time": F.min, "max_over_time": F.max, "count_over_time": F.count, "last_over_time": lambda v: F.max_by(v, F.col("ts"))}


@dataclass(frozen=True)
class Rule:
    record: str  # the name of the recorded metric
    selector: str
    function: str
    range: str  # Spark intervals, such as "5 minutes"
    step: str
    by: tuple[str, ...] = ()
    delay: str = "5 minutes"

    def over(self, samples: DataFrame) -> DataFrame:
        """``samples(ts timestamp, v double, labels...)``, streaming or not -> (__name__, by..., ts, v) per window."""
        if self.function not in _PER_WINDOW:
            raise ValueError(f"no recording function {self.function!r}")
        df = samples
        for m in parse_selector(self.selector).matchers:
            df = df.where(condition(F.coalesce(F.col(m.name), F.lit("")), m)) if m.name in samples.columns else df.where(condition(F.lit(""), m))
        df = df.withColumn("ts", F.col("ts") - F.expr("INTERVAL '0.000001' SECOND"))
        if df.isStreaming:
            df = df.withWatermark("ts", self.delay)
        window = F.window("ts", self.range, self.step).alias("w")
        summed = df.groupBy(window, *self.by).agg(_PER_WINDOW[self.function](F.col("v")).cast("double").alias("v"))
        return summed.select(F.lit(self.record).alias("__name__"), *self.by, F.col("w.end").alias("ts"), "v")


def start(rule: Rule, samples: DataFrame, path: str, checkpoint: str):
    """Appends a rule's final windows to Parquet files, exactly once."""
    return rule.over(samples).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
