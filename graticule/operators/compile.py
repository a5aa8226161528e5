"""Query trees to DataFrames over a grid of evaluation times.

A vector is a relation with a column per label (empty where a series lacks it), the evaluation time ``__e`` and the value
``__v``; one row per series and time.  A window is the same with one row per sample in the window, its time in ``__t`` and the
time that the window ends at in ``__at`` (``__e`` moved by ``@`` and ``offset``).  A scalar is a column over ``__e``, or a
relation (__e, __s).  Which labels a node has is known from the query and the sources alone, so grouping and matching are
column lists and joins are plain equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import histogram, numeric
from ..functions.over_time import WINDOW, quantile_agg
from ..plans import registry as R
from ..plans.ast import Aggregate, Binary, Call, Expr, Matrix, Number, Paren, Selector, String, Subquery, Unary
from ..plans.parser import ParseError, java_group, java_pattern, matches, type_of
from ..sources.catalog import AT, E, T, V, Catalog

#: Windows that overlap more than this are answered by each sample's successor instead of by repeating samples.
OVERLAP = 4
NAME = "__name__"


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end; one time if the step is 0."""

    start: int
    end: int
    step: int = 0

    @property
    def size(self) -> int:
        return (self.end - self.start) // self.step + 1 if self.step and self.end >= self.start else 1 if self.end >= self.start else 0

    @property
    def last(self) -> int:
        return self.start + (self.size - 1) * self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.size).select((F.lit(self.start) + F.col("id") * self.step).cast("long").alias(E))


@dataclass(frozen=True)
class Vector:
    frame: DataFrame
    labels: tuple[str, ...]

    def with_value(self, value: Column) -> Vector:
        return Vector(self.frame.select(*self.labels, E, value.alias(V)), self.labels)

    def nameless(self) -> Vector:
        kept = tuple(x for x in self.labels if x != NAME)
        return self if kept == self.labels else Vector(self.frame.drop(NAME), kept)


@dataclass(frozen=True)
class Windowed:
    frame: DataFrame  # labels, __e, __at, __t, __v, and __pt, __pv if asked for
    labels: tuple[str, ...]
    range: int


@dataclass(frozen=True)
class Scalar:
    column: Column | None = None
    frame: DataFrame | None = None  # (__e, __s)
    constant: float | None = None


def _ceil_div(a: Column, b: int) -> Column:
    """Integer ceiling, without doubles."""
    up = a + (b - 1)
    return ((up - F.pmod(up, F.lit(b))) / b).cast("long")


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, grid: Grid, lookback: int = 300_000, default_step: int = 60_000):
        self.spark, self.catalog, self.query, self.lookback, self.default_step = spark, catalog, grid, lookback, default_step

    # -- entry

    def run(self, e: Expr) -> Vector | Windowed | Scalar | String:
        return self.any(e, self.query)

    def any(self, e: Expr, g: Grid):
        kind = type_of(e)
        if kind == R.SCALAR:
            return self.scalar(e, g)
        if kind == R.MATRIX:
            return self.window(e, g, False)
        if kind == R.STRING:
            return _bare(e)
        return self.vector(e, g)

    # -- samples on a grid

    def _pinned(self, at: int | str | None) -> int | None:
        return {"start": self.query.start, "end": self.query.end}.get(at, at) if at is not None else None

    def _spread(self, df: DataFrame, g: Grid) -> DataFrame:
        """The answer for one pinned time at every time of the grid."""
        times = F.sequence(F.lit(g.start), F.lit(g.last), F.lit(g.step)) if g.size > 1 else F.array(F.lit(g.start))
        return df.drop(E).withColumn(E, F.explode(times.cast("array<long>")))

    def _on_grid(self, df: DataFrame, g: Grid, span: int, offset: int) -> DataFrame:
        """Samples repeated for each grid time e with e - span < t + offset <= e; ``__at`` is e - offset."""
        t = F.col(T) + offset
        if g.size <= 1:
            return df.where((t > g.start - span) & (t <= g.start)).withColumn(E, F.lit(g.start).cast("long")).withColumn(AT, F.lit(g.start - offset).cast("long"))
        low = F.greatest(F.lit(0).cast("long"), _ceil_div(t - g.start, g.step))
        high = F.least(F.lit(g.size - 1).cast("long"), _ceil_div(t + span - g.start, g.step) - 1)
        i = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))
        return df.withColumn("__i", i).withColumn(E, (F.lit(g.start) + F.col("__i") * g.step).cast("long")).withColumn(AT, F.col(E) - offset).drop("__i")

    def instant(self, e: Selector, g: Grid) -> Vector:
        """The newest sample of each series within the lookback, with its time in ``__t``."""
        pin = self._pinned(e.at)
        on = Grid(pin, pin) if pin is not None else g
        df, labels = self.catalog.samples(e.matchers, on.start - e.offset - self.lookback, on.last - e.offset)
        if df is None or not g.size:
            return self.nothing(tuple(labels))
        if on.step and self.lookback > OVERLAP * on.step:
            # a sample serves the times from its own up to its successor's
            order = Window.partitionBy(*labels).orderBy(T)
            until = F.least(F.coalesce(F.lead(T).over(order), F.lit(2**62)), F.col(T) + self.lookback)
            df = df.withColumn("__u", until)
            t, u = F.col(T) + e.offset, F.col("__u") + e.offset
            low = F.greatest(F.lit(0).cast("long"), _ceil_div(t - on.start, on.step))
            high = F.least(F.lit(on.size - 1).cast("long"), _ceil_div(u - on.start, on.step) - 1)
            i = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))
            out = df.withColumn("__i", i).select(*labels, (F.lit(on.start) + F.col("__i") * on.step).cast("long").alias(E), T, V)
        else:
            placed = self._on_grid(df, on, self.lookback, e.offset)
            newest = placed.groupBy(*labels, E).agg(F.max_by(F.struct(T, V), T).alias("s"))
            out = newest.select(*labels, E, F.col("s")[T].alias(T), F.col("s")[V].alias(V))
        return Vector(self._spread(out, g) if pin is not None else out, tuple(labels))

    def window(self, e: Expr, g: Grid, previous: bool) -> Windowed:
        return self._placed(*self._window_samples(e, g), g, previous)

    def _window_samples(self, e: Expr, g: Grid) -> tuple[DataFrame, list[str], Grid, int, int, bool]:
        """Samples that a window may hold: (frame, labels, grid, range, offset, whether ``@`` pins the grid to one time)."""
        e = _bare(e)
        if isinstance(e, Subquery):
            return self._subquery(e, g)
        s: Selector = e.selector
        pin = self._pinned(s.at)
        on = Grid(pin, pin) if pin is not None else g
        df, labels = self.catalog.samples(s.matchers, on.start - s.offset - e.range, on.last - s.offset)
        if df is None:
            df = self.nothing(tuple(labels)).frame.select(*labels, F.col(E).alias(T), V)
        return df, labels, on, e.range, s.offset, pin is not None

    def _subquery(self, e: Subquery, g: Grid) -> tuple[DataFrame, list[str], Grid, int, int, bool]:
        """The inner expression at multiples of the step, its values standing in for samples."""
        step = e.step or self.default_step
        pin = self._pinned(e.at)
        on = Grid(pin, pin) if pin is not None else g
        low, high = on.start - e.offset - e.range, on.last - e.offset
        inner = Grid((low // step + 1) * step, high // step * step, step)
        if type_of(e.expr) == R.SCALAR:
            made = self.vector(Call("vector", (e.expr,)), inner) if inner.size else self.nothing(())
        else:
            made = self.vector(e.expr, inner) if inner.size else self.nothing(())
        df = made.frame.select(*made.labels, F.col(E).alias(T), V)
        return df, list(made.labels), on, e.range, e.offset, pin is not None

    @staticmethod
    def _with_previous(df: DataFrame, labels: list[str]) -> DataFrame:
        """Each series' samples with the one before; done before samples are repeated, so aggregations over windows find the
        rows partitioned by series already.  Samples at one time are taken in order of their values."""
        order = (Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0))).orderBy(T, V)
        return df.withColumn("__pt", F.lag(T).over(order)).withColumn("__pv", F.lag(V).over(order))

    def _placed(self, df: DataFrame, labels: list[str], on: Grid, span: int, offset: int, pinned: bool, g: Grid, previous: bool) -> Windowed:
        df = self._with_previous(df, labels) if previous else df
        placed = self._on_grid(df, on, span, offset)
        return Windowed(self._spread(placed, g) if pinned else placed, tuple(labels), span)

    def nothing(self, labels: tuple[str, ...]) -> Vector:
        schema = ", ".join([*(f"`{x}` string" for x in labels), f"{E} long", f"{T} long", f"{V} double"])
        return Vector(self.spark.createDataFrame([], schema), labels)

    # -- scalars

    def scalar(self, e: Expr, g: Grid) -> Scalar:
        e = _bare(e)
        q = self.query
        if isinstance(e, Number):
            return Scalar(F.lit(e.value), constant=e.value)
        if isinstance(e, Unary):
            return self._scalar_map(self.scalar(e.expr, g), (lambda x: -x) if e.op == "-" else (lambda x: x))
        if isinstance(e, Binary):
            return self._scalar_pair(e, self.scalar(e.left, g), self.scalar(e.right, g))
        if isinstance(e, Call):
            if e.name == "time":
                return Scalar(F.col(E) / 1000.0)
            if e.name == "scalar":
                v = self.vector(e.args[0], g)
                one = v.frame.groupBy(E).agg(F.when(F.count("*") == 1, F.first(V)).alias("__s"))
                return Scalar(frame=g.frame(self.spark).join(one, E, "left").select(E, F.coalesce("__s", F.lit(float("nan"))).alias("__s")))
            value = {"pi": 3.141592653589793, "start": q.start / 1000, "end": q.end / 1000, "step": q.step / 1000, "range": (q.end - q.start) / 1000}[e.name]
            return Scalar(F.lit(value), constant=value)
        raise ParseError(f"not a scalar: {e}")

    @staticmethod
    def _scalar_map(s: Scalar, f: Callable[[Column], Column]) -> Scalar:
        if s.frame is not None:
            return Scalar(frame=s.frame.withColumn("__s", f(F.col("__s"))))
        return Scalar(f(s.column), constant=None)

    def _scalar_pair(self, e: Binary, a: Scalar, b: Scalar) -> Scalar:
        def both(x: Column, y: Column) -> Column:
            if e.op in R.COMPARISON:
                return F.when(numeric.compare(e.op, x, y), 1.0).otherwise(0.0)
            if e.op in R.TRIMS:
                return F.lit(float("nan"))
            return numeric.ARITHMETIC[e.op](x, y)

        if a.frame is None and b.frame is None:
            return Scalar(both(a.column, b.column))
        if a.frame is not None and b.frame is not None:
            return Scalar(frame=a.frame.join(b.frame.withColumnRenamed("__s", "__r"), E).select(E, both(F.col("__s"), F.col("__r")).alias("__s")))
        if a.frame is not None:
            return Scalar(frame=a.frame.select(E, both(F.col("__s"), b.column).alias("__s")))
        return Scalar(frame=b.frame.select(E, both(a.column, F.col("__s")).alias("__s")))

    def _attached(self, df: DataFrame, scalars: list[Scalar]) -> tuple[DataFrame, list[Column]]:
        """``df`` with every scalar as a column expression; relations join on the evaluation time."""
        out = []
        for i, s in enumerate(scalars):
            if s.frame is None:
                out.append(s.column)
                continue
            name = f"__s{i}"
            df = df.join(s.frame.withColumnRenamed("__s", name), E)  # one row per evaluation time: broadcast by size
            out.append(F.col(name))
        return df, out

    # -- vectors

    def vector(self, e: Expr, g: Grid) -> Vector:
        e = _bare(e)
        v = self._vector(e, g)
        return _distinct(v) if _may_repeat(e, v) else v

    def _vector(self, e: Expr, g: Grid) -> Vector:
        if isinstance(e, Selector):
            v = self.instant(e, g)
            return v.with_value(F.col(V))
        if isinstance(e, Unary):
            v = self.vector(e.expr, g)
            return v.nameless().with_value(-F.col(V)) if e.op == "-" else v
        if isinstance(e, Aggregate):
            return self.aggregate(e, g)
        if isinstance(e, Binary):
            return self.binary(e, g)
        if isinstance(e, Call):
            return self.call(e, g)
        raise ParseError(f"not an instant vector: {e}")

    def call(self, e: Call, g: Grid) -> Vector:
        name = e.name
        if name in WINDOW:
            return self._over_time(e, g)
        if name == "vector":
            s = self.scalar(e.args[0], g)
            df, (value,) = self._attached(g.frame(self.spark), [s])
            return Vector(df.select(E, value.cast("double").alias(V)), ())
        if name in numeric.ELEMENTWISE:
            return self.vector(e.args[0], g).nameless().with_value(numeric.ELEMENTWISE[name](F.col(V)))
        if name in numeric.DATES:
            v = self.vector(e.args[0], g) if e.args else self.vector(Call("vector", (Call("time"),)), g)
            return v.nameless().with_value(numeric.DATES[name](F.col(V)))
        if name in ("clamp", "clamp_min", "clamp_max", "round"):
            v = self.vector(e.args[0], g).nameless()
            df, bounds = self._attached(v.frame, [self.scalar(a, g) for a in e.args[1:]])
            if name == "round":
                return Vector(df, v.labels).with_value(numeric.round_to(F.col(V), bounds[0] if bounds else F.lit(1.0)))
            low = bounds[0] if name != "clamp_max" else None
            high = bounds[-1] if name != "clamp_min" else None
            if name == "clamp":
                df = df.where(~(low > high) | F.isnan(low) | F.isnan(high))
            return Vector(df, v.labels).with_value(numeric.clamp(F.col(V), low, high))
        if name == "timestamp":
            inner = _bare(e.args[0])
            if isinstance(inner, Selector):
                v = self.instant(inner, g)
                return Vector(v.frame.select(*v.labels, E, (F.col(T) / 1000.0).alias(V)), v.labels).nameless()
            return self.vector(inner, g).nameless().with_value(F.col(E) / 1000.0)
        if name in R.ORDERING:
            return self.vector(e.args[0], g)  # the engine orders the final result
        if name in ("absent", "absent_over_time"):
            return self._absent(e, g)
        if name == "label_replace":
            return self._label_replace(e, g)
        if name == "label_join":
            v = self.vector(e.args[0], g)
            dst, sep = e.args[1].value, e.args[2].value
            parts = [F.col(a.value) if a.value in v.labels else F.lit("") for a in e.args[3:]]
            return _relabelled(v, dst, F.concat_ws(sep, *parts) if parts else F.lit(""))
        return self._histogram(e, g)

    def _over_time(self, e: Call, g: Grid) -> Vector:
        f = WINDOW[e.name]
        at = next(i for i, a in enumerate(e.args) if type_of(a) == R.MATRIX)
        df, labels, on, span, offset, pinned = self._window_samples(e.args[at], g)
        if f.panes and on.size > 1 and span % on.step == 0 and span > on.step:
            v = self._by_panes(f, df, labels, on, span, offset)
            return v if f.keeps_name else v.nameless()
        w = self._placed(df, labels, on, span, offset, pinned, g, f.previous)
        scalars = [self.scalar(a, g) for i, a in enumerate(e.args) if i != at]
        df, args = self._attached(w.frame, scalars)
        fixed = [s.constant if s.constant is not None else a for s, a in zip(scalars, args, strict=True)]
        context = {"range": w.range, "args": fixed if e.name == "quantile_over_time" else [F.lit(a) if isinstance(a, float) else a for a in fixed]}
        grouped = df.groupBy(*w.labels, E).agg(f.value(context).cast("double").alias(V), F.count("*").alias("__n"))
        v = Vector(grouped.where(F.col("__n") >= f.least).select(*w.labels, E, V), w.labels)
        return v if f.keeps_name else v.nameless()

    def _by_panes(self, f, df: DataFrame, labels: list[str], on: Grid, span: int, offset: int) -> Vector:
        """Overlapping windows of whole steps: each sample is summarised once, in its pane, and panes are repeated instead."""
        context, per = {"range": span, "args": []}, span // on.step
        df = self._with_previous(df, labels) if f.previous else df
        pane = _ceil_div(F.col(T) + offset - on.start, on.step)
        states = f.panes.states(context)
        panes = df.withColumn("__p", pane).groupBy(*labels, "__p").agg(F.count("*").alias("__n"), *[c.alias(k) for k, c in states.items()])
        low, high = F.greatest(F.lit(0).cast("long"), F.col("__p")), F.least(F.lit(on.size - 1).cast("long"), F.col("__p") + (per - 1))
        i = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))
        placed = panes.withColumn("__i", i).withColumn(E, (F.lit(on.start) + F.col("__i") * on.step).cast("long")).withColumn(AT, F.col(E) - offset)
        grouped = placed.groupBy(*labels, E).agg(f.panes.merged(context).cast("double").alias(V), F.sum("__n").alias("__k"))
        return Vector(grouped.where(F.col("__k") >= f.least).select(*labels, E, V), tuple(labels))

    def _absent(self, e: Call, g: Grid) -> Vector:
        arg = _bare(e.args[0])
        present = self.window(arg, g, False).frame if type_of(arg) == R.MATRIX else self.vector(arg, g).frame
        gone = g.frame(self.spark).join(present.select(E).distinct(), E, "left_anti")
        selector = arg.selector if isinstance(arg, Matrix) else arg
        fixed: dict[str, str] = {}
        if isinstance(selector, Selector):
            for m in selector.matchers:
                if m.name != NAME and m.op == "=" and sum(x.name == m.name for x in selector.matchers) == 1 and m.value:
                    fixed[m.name] = m.value
        names = tuple(sorted(fixed))
        return Vector(gone.select(*[F.lit(fixed[n]).alias(n) for n in names], E, F.lit(1.0).alias(V)), names)

    def _label_replace(self, e: Call, g: Grid) -> Vector:
        v = self.vector(e.args[0], g)
        dst, replacement, src, pattern = (a.value for a in e.args[1:])
        source = F.col(src) if src in v.labels else F.lit("")
        anchored = rf"\A(?s:{java_pattern(pattern)})\z"
        target = F.col(dst) if dst in v.labels else F.lit("")
        # $1, ${1} and ${name} are the same in both dialects but for $$ and a bare $1x, which names group "1x": empty
        java = _java_replacement(replacement)
        return _relabelled(v, dst, F.when(source.rlike(anchored), F.regexp_replace(source, F.lit(anchored), F.lit(java))).otherwise(target))

    def _histogram(self, e: Call, g: Grid) -> Vector:
        at = next(i for i, a in enumerate(e.args) if type_of(a) == R.VECTOR)
        v = self.vector(e.args[at], g).nameless()
        labels = tuple(x for x in v.labels if x != "le")
        le = F.col("le").try_cast("double") if "le" in v.labels else F.lit(None).cast("double")
        df = v.frame.withColumn("__le", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(le) if "le" in v.labels else le).where("__le is not null")
        grouped = df.groupBy(*labels, E).agg(histogram.buckets().alias("__b"))
        b = F.col("__b")
        if e.name == "histogram_quantiles":
            label = e.args[1].value
            df, values = self._attached(grouped, [self.scalar(q, g) for q in e.args[2:]])
            each = F.explode(F.array(*[F.struct(x.cast("double").alias("q"), numeric.text_of(x).alias("shown")) for x in values])).alias("__q")
            df = df.select(*labels, E, "__b", each)
            return _with_label(Vector(df.select(*labels, E, histogram.quantile(b, F.col("__q")["q"]).alias(V), F.col("__q")["shown"].alias("__s")), labels), label, F.col("__s"))
        df, args = self._attached(grouped, [self.scalar(a, g) for i, a in enumerate(e.args) if i != at])
        value = histogram.quantile(b, args[0]) if e.name == "histogram_quantile" else histogram.fraction(b, args[0], args[1])
        return Vector(df.select(*labels, E, value.alias(V)), labels)

    # -- aggregations

    def aggregate(self, e: Aggregate, g: Grid) -> Vector:
        v = self.vector(e.expr, g)
        if e.without:
            by = tuple(x for x in v.labels if x not in e.grouping and x != NAME)
        else:
            by = tuple(x for x in dict.fromkeys(e.grouping) if x in v.labels)
        missing = () if e.without else tuple(x for x in dict.fromkeys(e.grouping) if x not in v.labels)
        value = F.col(V)
        if e.op in ("topk", "bottomk", "limitk"):
            df, (k,) = self._attached(v.frame, [self.scalar(e.param, g)])
            size = F.when(F.isnan(k) | (k < 1), 0).otherwise(F.least(k, F.lit(2147483647.0)).cast("int"))
            order = {"topk": [F.isnan(V), F.desc(V)], "bottomk": [F.isnan(V), F.asc(V)], "limitk": []}[e.op]
            rank = F.row_number().over(Window.partitionBy(*by, E).orderBy(*order, *v.labels, E))
            constant = self.scalar(e.param, g).constant
            ranked = df.withColumn("__rn", rank)
            # a literal bound lets Spark keep only that many rows per group before the shuffle
            kept = ranked.where(F.col("__rn") <= int(max(0, min(constant, 2**31 - 1)))) if constant is not None and constant == constant else ranked.where(F.col("__rn") <= size)
            return Vector(kept, v.labels).with_value(value)
        if e.op == "count_values":
            label = e.param.value
            by = tuple(x for x in by if x != label)
            out = v.frame.withColumn("__q", numeric.text_of(value)).groupBy(*by, "__q", E).agg(F.count("*").cast("double").alias(V))
            return _with_label(Vector(out, by), label, F.col("__q"))
        df, q = v.frame, None
        if e.op == "quantile":
            s = self.scalar(e.param, g)
            df, (column,) = self._attached(df, [s])
            q = s.constant if s.constant is not None else column
        real = ~F.isnan(V)
        agg = {
            "sum": lambda: F.sum(V), "avg": lambda: F.avg(V), "count": lambda: F.count("*").cast("double"), "min": lambda: F.min(V), "group": lambda: F.max(F.lit(1.0)),
            "max": lambda: F.coalesce(F.max(F.when(real, value)), F.lit(float("nan"))), "stddev": lambda: F.stddev_pop(V), "stdvar": lambda: F.var_pop(V), "quantile": lambda: quantile_agg(value, q),
        }[e.op]()
        out = df.groupBy(*by, E).agg(agg.alias(V))
        return Vector(out.select(*by, *[F.lit("").alias(m) for m in missing], E, V), by + missing)

    # -- binary operators

    def binary(self, e: Binary, g: Grid) -> Vector:
        left_scalar, right_scalar = type_of(e.left) == R.SCALAR, type_of(e.right) == R.SCALAR
        if left_scalar or right_scalar:
            v = self.vector(e.right if left_scalar else e.left, g)
            df, (s,) = self._attached(v.frame, [self.scalar(e.left if left_scalar else e.right, g)])
            a, b = (s, F.col(V)) if left_scalar else (F.col(V), s)
            return self._result(e, Vector(df, v.labels), a, b, F.col(V))
        if self._never_meet(e):
            return self.nothing(()).with_value(F.col(V))
        left, right = self.vector(e.left, g), self.vector(e.right, g)
        m = e.matching
        if e.op in R.SETS:
            return self._set(e, left, right)
        if m.group == "right":  # the many side goes left
            left, right = right, left
        shared = (set(left.labels) | set(right.labels)) - {NAME}
        keys = sorted(set(m.labels) & shared if m.on else shared - set(m.labels))
        left, right = _having(left, keys), _having(right, keys)
        include = [x for x in m.include if x not in keys]
        # one row per key on the "one" side; a second is an error once the key has met a partner
        one = right.frame.groupBy(*keys, E).agg(F.count("*").alias("__c"), F.first(V).alias("__w"), *[F.first(x if x in right.labels else F.lit("")).alias(f"__i_{x}") for x in include])
        df = left.frame.join(one, [*keys, E])
        twice = F.raise_error(F.lit("many-to-many matching not allowed: matching labels must be unique on one side")).cast("double")
        df = df.withColumn("__w", F.when(F.col("__c") > 1, twice).otherwise(F.col("__w")))
        if not m.group:
            count = F.count("*").over(Window.partitionBy(*keys, E)) if set(left.labels) - {NAME} != set(keys) or (NAME in left.labels) else F.lit(1)
            df = df.withColumn("__w", F.when(count > 1, F.raise_error(F.lit("multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")).cast("double")).otherwise(F.col("__w")))
        a, b = (F.col("__w"), F.col(V)) if m.group == "right" else (F.col(V), F.col("__w"))
        kept = Vector(df, left.labels)
        if not m.group:
            labels = tuple(keys) if m.on else tuple(x for x in left.labels if x not in m.labels)
            kept = Vector(df, labels)
        for x in include:
            kept = _with_label(Vector(kept.frame, kept.labels), x, F.col(f"__i_{x}"), V, "__w", *[f"__i_{y}" for y in include])
        # a filter keeps the value of the query's left side, whichever side has the many rows
        return self._result(e, kept, a, b, a)

    def _result(self, e: Binary, v: Vector, a: Column, b: Column, kept: Column) -> Vector:
        if e.op in R.TRIMS:
            return Vector(v.frame.where(F.lit(False)), v.labels).with_value(F.col(V))
        if e.op in R.COMPARISON:
            test = numeric.compare(e.op, a, b)
            if e.bool_:
                return v.with_value(F.when(test, 1.0).otherwise(0.0)).nameless()
            return Vector(v.frame.where(test), v.labels).with_value(kept)
        return v.with_value(numeric.ARITHMETIC[e.op](a, b)).nameless()

    def _set(self, e: Binary, left: Vector, right: Vector) -> Vector:
        m = e.matching
        every = tuple(dict.fromkeys(left.labels + right.labels))
        keys = sorted(set(m.labels) if m.on else set(every) - {NAME} - set(m.labels))
        a, b = _having(left, keys), _having(right, keys)
        if e.op in ("and", "unless"):
            how = "left_semi" if e.op == "and" else "left_anti"
            return Vector(a.frame.join(b.frame.select(*keys, E), [*keys, E], how), a.labels).with_value(F.col(V))
        rest = b.frame.join(a.frame.select(*keys, E), [*keys, E], "left_anti")
        a, rest = _having(a, every), _having(Vector(rest, b.labels), every)
        names = tuple(dict.fromkeys(a.labels + rest.labels))
        return Vector(a.frame.select(*names, E, V).unionAll(rest.frame.select(*names, E, V)), names)

    def _never_meet(self, e: Binary) -> bool:
        """Both sides' sources are known from their matchers; without a common one, operators that join on all virtual labels
        have an empty answer, which is then found without reading anything."""
        m, ours = e.matching, set(self.catalog.virtual)
        if e.op in ("or", "unless") or not ours or (not ours <= set(m.labels) if m.on else bool(ours & set(m.labels))):
            return False
        sides = [self._sources(x) for x in (e.left, e.right)]
        return None not in sides and not sides[0] & sides[1]

    def _sources(self, e: Expr) -> set[str] | None:
        """Sources that the rows of a plain selector or window function come from; None where that is not evident."""
        e = _bare(e)
        if isinstance(e, Call) and (e.name in WINDOW or e.name in numeric.ELEMENTWISE):
            return self._sources(next(a for a in e.args if type_of(a) in (R.VECTOR, R.MATRIX)))
        if isinstance(e, Matrix):
            return self._sources(e.selector)
        if isinstance(e, Selector):
            sets = self.catalog.virtual_labels()
            return {s for s, labels in sets.items() if all(matches(m, labels[m.name]) for m in e.matchers if m.name in labels)}
        return None


def _bare(e: Expr) -> Expr:
    while isinstance(e, Paren):
        e = e.expr
    return e


def _having(v: Vector, names) -> Vector:
    """With every one of the labels, empty where it was missing."""
    new = [x for x in names if x not in v.labels]
    if not new:
        return v
    return Vector(v.frame.select("*", *[F.lit("").alias(x) for x in new]), v.labels + tuple(new))


def _with_label(v: Vector, name: str, value: Column, *carry: str) -> Vector:
    rest = [x for x in v.labels if x != name]
    names = tuple([*rest, name])
    return Vector(v.frame.select(*rest, value.alias(name), E, *(carry or (V,))), names)


def _relabelled(v: Vector, name: str, value: Column) -> Vector:
    """A label set anew; only one that was there before can have told two series apart."""
    out = _with_label(v, name, value)
    return _distinct(out) if name in v.labels else out


def _several_names(e: Expr) -> bool:
    """Whether the series of a vector or window may differ in name alone."""
    e = _bare(e)
    if isinstance(e, Matrix):
        return _several_names(e.selector)
    if isinstance(e, Subquery):
        return _several_names(e.expr)
    if isinstance(e, Selector):
        return not any(m.name == NAME and m.op == "=" and m.value for m in e.matchers)
    if isinstance(e, Binary):
        return any(_several_names(x) for x in (e.left, e.right) if type_of(x) == R.VECTOR) if e.op in R.SETS or (e.op in R.COMPARISON and not e.bool_) else False
    if isinstance(e, Unary):
        return e.op == "+" and _several_names(e.expr)
    if isinstance(e, Call):
        keeps = e.name in R.ORDERING or e.name in ("label_replace", "label_join") or (e.name in WINDOW and WINDOW[e.name].keeps_name)
        return keeps and any(_several_names(a) for a in e.args if type_of(a) in (R.VECTOR, R.MATRIX))
    if isinstance(e, Aggregate):
        return e.op in ("topk", "bottomk", "limitk") and _several_names(e.expr)
    return False


def _may_repeat(e: Expr, v: Vector) -> bool:
    """Whether the operator may give two series the same labels: it drops the names of series that differ in name alone."""
    if isinstance(e, Unary) and e.op == "-":
        return _several_names(e.expr)
    if isinstance(e, Binary) and R.SCALAR in (type_of(e.left), type_of(e.right)) and (e.op not in R.COMPARISON or e.bool_):
        return any(_several_names(x) for x in (e.left, e.right) if type_of(x) == R.VECTOR)
    if isinstance(e, Call) and NAME not in v.labels and e.name not in ("absent", "absent_over_time", "label_replace", "label_join", "histogram_quantile", "histogram_quantiles", "histogram_fraction"):
        return any(_several_names(a) for a in e.args if type_of(a) in (R.VECTOR, R.MATRIX))
    return False


def _distinct(v: Vector) -> Vector:
    """``v``, failing where two series have the same labels at one time."""
    n = F.count("*").over(Window.partitionBy(*v.labels, E))
    same = F.raise_error(F.lit("vector cannot contain metrics with the same labelset")).cast("double")
    return Vector(v.frame.withColumn("__n", n), v.labels).with_value(F.when(F.col("__n") > 1, same).otherwise(F.col(V)))


def _java_replacement(text: str) -> str:
    """A replacement template with $1, ${1} or ${name} in Java's dialect."""
    import re

    out, at = "", 0
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", text):
        out += re.sub(r"([\\$])", r"\\\1", text[at : m.start()])
        group = m[1] or m[2]
        if m[0] == "$$":
            out += r"\$"
        elif group.isdigit():
            out += f"${group}" if len(group) == 1 else ""
        elif m[1]:
            out += "${" + java_group(group) + "}"
        at = m.end()
    return out + re.sub(r"([\\$])", r"\\\1", text[at:])


__all__ = ["Compiler", "Grid", "Scalar", "Vector", "Windowed"]
