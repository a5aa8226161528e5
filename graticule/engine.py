"""The engine: instant and range queries, their plans, and metadata, over a catalog of sources."""

from __future__ import annotations

import logging
import re
import threading
import time as clock
import uuid
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.compile import Compiler, Grid, Scalar, Vector, Windowed
from .plans import registry as R
from .plans.ast import Call, Expr, Matcher, Paren, String
from .plans.parser import ParseError, matches_empty, parse, parse_selector, type_of
from .plans.planner import Planner, Span
from .plans.units import format_float, parse_step, parse_time
from .sources.catalog import E, T, V, Catalog

TRUNCATED = "results truncated due to limit"
log = logging.getLogger(__name__)


class QueryError(Exception):
    """``kind`` as in the API envelope: bad_data, execution, canceled, timeout, unavailable, internal."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Limits:
    samples: int = 50_000_000  # that an answer may hold; 0: no limit
    read: int = 50_000_000  # samples that a query may read from its sources; 0: no limit
    seconds: float = 300
    concurrent: int = 20


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, lookback_ms: int = 300_000, limits: Limits | None = None, default_step_ms: int = 60_000):
        self.spark, self.catalog, self.lookback, self.default_step = spark, catalog, lookback_ms, default_step_ms
        self.limits = limits or Limits()
        self._slots = threading.BoundedSemaphore(self.limits.concurrent)
        self._asked: ContextVar[Catalog | None] = ContextVar("catalog", default=None)  # what one API request works on
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    @property
    def current(self) -> Catalog:
        return self._asked.get() or self.catalog

    # -- as DataFrames

    def compiled(self, query: str | Expr, grid: Grid) -> tuple[Expr, object]:
        expr = parse(query) if isinstance(query, str) else query
        return expr, Compiler(self.spark, self.current, grid, self.lookback, self.default_step).run(expr)

    def instant_frame(self, query: str, time: int) -> DataFrame:
        """Labels, ts, value of one evaluation time (ms); sort functions at the root order it."""
        expr, result = self.compiled(query, Grid(time, time))
        return self._ordered(expr, self._frame(result, Grid(time, time)))

    def range_frame(self, query: str, start: int, end: int, step: int) -> DataFrame:
        """Labels, ts, value of every evaluation time from start to end (ms)."""
        expr = parse(query)
        if type_of(expr) not in (R.SCALAR, R.VECTOR):
            raise ParseError(f'invalid expression type "{type_of(expr)}" for range query, must be Scalar or instant Vector')
        grid = Grid(start, end, step)
        return self._frame(self.compiled(expr, grid)[1], grid)

    def _frame(self, result: object, grid: Grid) -> DataFrame:
        if isinstance(result, Vector):
            return result.frame.select(*result.labels, F.col(E).alias("ts"), F.col(V).alias("value"))
        if isinstance(result, Windowed):
            return result.frame.select(*result.labels, F.col(T).alias("ts"), F.col(V).alias("value"))
        if isinstance(result, Scalar):
            df = result.frame.select(E, F.col("__s").alias(V)) if result.frame is not None else grid.frame(self.spark).withColumn(V, result.column)
            return df.select(F.col(E).alias("ts"), F.col(V).cast("double").alias("value"))
        return grid.frame(self.spark).select(F.col(E).alias("ts"), F.lit(result.value).alias("value"))

    @staticmethod
    def _ordered(expr: Expr, df: DataFrame) -> DataFrame:
        while isinstance(expr, Paren):
            expr = expr.expr
        if not isinstance(expr, Call) or expr.name not in R.ORDERING:
            return df
        labels = [c for c in df.columns if c not in ("ts", "value")]
        if expr.name == "sort":
            return df.orderBy(F.isnan("value"), "value", *labels)
        if expr.name == "sort_desc":
            return df.orderBy(F.isnan("value"), F.desc("value"), *labels)
        names = [a.value for a in expr.args[1:] if a.value in labels] + labels
        down = expr.name == "sort_by_label_desc"
        keys = [natural_key(n) for n in dict.fromkeys(names)]
        return df.orderBy(*[k.desc() if down else k.asc() for k in keys])

    # -- as API answers

    def query(self, query: str, time: str | float | None = None, limit: int = 0) -> dict:
        """The envelope of an instant query; time in seconds or RFC 3339."""

        def run() -> tuple[dict, list[str]]:
            at = parse_time(time) if time is not None else int(clock.time() * 1000)
            expr, result = self.compiled(query, Grid(at, at))
            kind = {R.VECTOR: "vector", R.MATRIX: "matrix", R.SCALAR: "scalar", R.STRING: "string"}[type_of(expr)]
            if isinstance(result, String):
                return {"resultType": kind, "result": [at / 1000, result.value]}, []
            df = self._ordered(expr, self._frame(result, Grid(at, at)))
            if kind == "scalar":
                (r,) = self._collected(df)
                return {"resultType": kind, "result": [r.ts / 1000, format_float(r.value)]}, []
            if kind == "matrix":
                return self._series(df, kind, limit)
            labels = [c for c in df.columns if c not in ("ts", "value")]
            ordered = isinstance(expr, Call) and expr.name in R.ORDERING
            df = df if ordered else df.orderBy(*labels, "ts")
            rows = self._collected(df.limit(limit + 1) if limit else self._limited(df))
            cut = [TRUNCATED] if limit and len(rows) > limit else []
            found = [{"metric": self._metric(r, labels), "value": [r.ts / 1000, format_float(r.value)]} for r in (rows[:limit] if limit else rows)]
            return {"resultType": kind, "result": found}, cut

        return self._answer(run)

    def query_range(self, query: str, start: str | float, end: str | float, step: str | float, limit: int = 0) -> dict:
        """The envelope of a range query."""

        def run() -> tuple[dict, list[str]]:
            a, b, s = parse_time(start), parse_time(end), parse_step(step)
            if b < a:
                raise ValueError("end timestamp must not be before start time")
            return self._series(self.range_frame(query, a, b, s), "matrix", limit)

        return self._answer(run)

    def _series(self, df: DataFrame, kind: str, limit: int) -> tuple[dict, list[str]]:
        labels = [c for c in df.columns if c not in ("ts", "value")]
        grouped = df.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("points"))
        grouped = grouped.orderBy(*labels) if labels else grouped
        rows = self._collected(grouped.limit(limit + 1) if limit else self._limited(grouped), lambda r: len(r.points))
        cut = [TRUNCATED] if limit and len(rows) > limit else []
        found = [{"metric": self._metric(r, labels), "values": [[p.ts / 1000, format_float(p.value)] for p in r.points]} for r in (rows[:limit] if limit else rows)]
        return {"resultType": kind, "result": found}, cut

    @staticmethod
    def _metric(row, labels: list[str]) -> dict[str, str]:
        return {n: row[n] for n in labels if row[n]}

    def _limited(self, df: DataFrame) -> DataFrame:
        return df.limit(self.limits.samples + 1) if self.limits.samples else df

    def _collected(self, df: DataFrame, samples=lambda row: 1) -> list:
        """The rows of one run, which fails beyond the limits on samples in the answer or read for it."""
        rows = df.collect()
        read = samples_read(df) if self.limits.read else 0
        for most, n in ((self.limits.samples, sum(map(samples, rows))), (self.limits.read, read)):
            if most and n > most:
                raise QueryError("execution", f"query exceeds the limit of {most} samples")
        return rows

    def _whole(self, run, late=None) -> tuple[object, list[str]]:
        """What ``run`` gives, and the warnings of the sources; one whose data can't be read is left out with a warning."""
        view = self.catalog.view()
        token = self._asked.set(view)
        try:
            return run(), view.warnings
        except (ParseError, ValueError, QueryError):
            raise
        except Exception:
            if view.strict or (late and late.is_set()):
                raise
            broken = {s.name: m for s in view.sources.values() if (m := s.failure())}
            if not broken or len(broken) == len(view.sources):
                raise
            view = self.catalog.view(broken)
            self._asked.set(view)
            return run(), [*[f"{n}: {m}" for n, m in broken.items()], *view.warnings]
        finally:
            self._asked.reset(token)

    def _answer(self, run) -> dict:
        if not self._slots.acquire(blocking=False):
            return {"status": "error", "errorType": "unavailable", "error": "too many concurrent queries", "code": 429}
        tag = f"query-{uuid.uuid4()}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(self.limits.seconds, stop)
        try:
            self.spark.addTag(tag)
            timer.start()
            log.info("%s starts", tag)
            (data, warnings), missing = self._whole(run, late)
        except (ParseError, ValueError) as e:
            return {"status": "error", "errorType": "bad_data", "error": str(e), "code": 400}
        except QueryError as e:
            return {"status": "error", "errorType": e.kind, "error": str(e), "code": 422}
        except Exception as e:
            if late.is_set():
                return {"status": "error", "errorType": "timeout", "error": f"query took longer than {self.limits.seconds} s", "code": 422}
            found = re.search(r"(vector cannot contain metrics with the same labelset|many-to-many matching not allowed[^\n]*?side|multiple matches for labels[^\n]*?\(group_left/group_right\))", str(e))
            return {"status": "error", "errorType": "execution", "error": found[1] if found else str(e).splitlines()[0], "code": 422}
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
            self._slots.release()
            log.info("%s ends", tag)
        out = {"status": "success", "data": data}
        warnings = [*dict.fromkeys(missing), *warnings]
        return out | ({"warnings": warnings} if warnings else {})

    # -- plans

    def plan(self, query: str, time: str | float = 0) -> dict:
        at = parse_time(time)
        return Planner(self.catalog.virtual_labels()).plan(parse(query), Span(at, at)).describe()

    def plan_range(self, query: str, start: str | float, end: str | float, step: str | float) -> dict:
        return Planner(self.catalog.virtual_labels()).plan(parse(query), Span(parse_time(start), parse_time(end), parse_step(step))).describe()

    # -- metadata

    def _matching(self, match: list[str] | None, start: int, end: int) -> tuple[DataFrame | None, list[str]]:
        sets: list[tuple[Matcher, ...]] = []
        for text in match or []:
            selector = parse_selector(text)
            if all(matches_empty(m) for m in selector.matchers):
                raise ParseError("match[] must contain at least one non-empty matcher")
            sets.append(selector.matchers)
        return self.current.samples_of_any(sets or [()], start - 1, end)

    def series_frame(self, match: list[str], start: int, end: int) -> DataFrame:
        """Distinct label sets with a sample in [start, end] (ms), one column per label."""
        if not match:
            raise ParseError("no match[] parameter provided")
        df, labels = self._matching(match, start, end)
        if df is None:
            return self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in labels))
        return df.select(*labels).distinct()

    def label_names_frame(self, match: list[str] | None, start: int, end: int) -> DataFrame:
        """One column ``name``: labels that a matching series has; one pass, one row of flags."""
        df, labels = self._matching(match, start, end)
        if df is None or not labels:
            return self.spark.createDataFrame([], "name string")
        flags = df.agg(*[F.max(F.col(n) != "").alias(n) for n in labels])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("has")) for n in labels])
        return flags.select(F.explode(pairs).alias("p")).where("p.has").select("p.name")

    def label_values_frame(self, name: str, match: list[str] | None, start: int, end: int) -> DataFrame:
        """One column ``value``: the label's values; a virtual one only where its source has a matching series."""
        df, labels = self._matching(match, start, end)
        if df is None or name not in labels:
            return self.spark.createDataFrame([], "value string")
        return df.select(F.col(name).alias("value")).where("value <> ''").distinct()

    def _metadata(self, frame, limit: int, shape) -> dict:
        def run() -> list:
            df = frame()
            return (df.orderBy(*df.columns).limit(limit + 1) if limit else df.orderBy(*df.columns)).collect()

        try:
            rows, warnings = self._whole(run)
        except (ParseError, ValueError) as e:
            return {"status": "error", "errorType": "bad_data", "error": str(e), "code": 400}
        except Exception as e:
            return {"status": "error", "errorType": "internal", "error": str(e).splitlines()[0], "code": 500}
        out = {"status": "success", "data": [shape(r) for r in (rows[:limit] if limit else rows)]}
        warnings = [*dict.fromkeys(warnings), *([TRUNCATED] if limit and len(rows) > limit else [])]
        return out | ({"warnings": warnings} if warnings else {})

    def series(self, match: list[str], start: str | float, end: str | float, limit: int = 0) -> dict:
        return self._metadata(lambda: self.series_frame(match, parse_time(start), parse_time(end)), limit, lambda r: {k: v for k, v in r.asDict().items() if v})

    def label_names(self, match: list[str] | None, start: str | float, end: str | float, limit: int = 0) -> dict:
        return self._metadata(lambda: self.label_names_frame(match, parse_time(start), parse_time(end)), limit, lambda r: r.name)

    def label_values(self, name: str, match: list[str] | None, start: str | float, end: str | float, limit: int = 0) -> dict:
        return self._metadata(lambda: self.label_values_frame(name, match, parse_time(start), parse_time(end)), limit, lambda r: r.value)

    def config(self) -> dict:
        """Sources by name with their virtual labels."""
        return {"endpoints": [{"url": s.name, "labels": dict(sorted(s.labels.items()))} for _, s in sorted(self.catalog.sources.items())]}

    def ready(self) -> bool:
        return not self.spark.sparkContext._jsc.sc().isStopped()


def samples_read(df: DataFrame) -> int:
    """Samples that a finished run of ``df`` took from its sources: rows of each scan, after the filter right above it."""

    def rows(plan) -> int:
        metric = plan.metrics().get("numOutputRows")
        return metric.get().value() if metric.isDefined() else 0

    def count(plan, above: int | None) -> int:
        name = plan.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return 0
        if name == "AdaptiveSparkPlanExec":
            return count(plan.executedPlan(), above)
        if name.endswith("QueryStageExec"):
            return count(plan.plan(), above)
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if not children:
            return 0 if name == "RangeExec" else rows(plan) if above is None else above
        if name == "FilterExec":
            above = rows(plan)
        elif len(children) > 1 or name not in ("ProjectExec", "WholeStageCodegenExec", "InputAdapter", "ColumnarToRowExec", "DeserializeToObjectExec", "SerializeFromObjectExec"):
            above = None
        return sum(count(c, above) for c in children)

    return count(df._jdf.queryExecution().executedPlan(), None)


def natural_key(name: str) -> Column:
    """Orders ``host2`` before ``host10``: digit runs are padded."""
    column = F.col(name)
    digits = F.regexp_replace(column, r"(\d+)", "\u0000$1\u0000")
    parts = F.split(digits, "\u0000")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A\d+\z"), F.lpad(p, 24, "0")).otherwise(p)), "")


__all__ = ["Engine", "Limits", "QueryError", "natural_key"]
