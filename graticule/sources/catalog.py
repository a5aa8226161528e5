"""Sources of samples with their virtual labels, seen as one relation.

A source is a DataFrame with a time column, a value column and label columns.  Its virtual labels are constants of its branch
of the union: a matcher on them prunes the branch before anything is read, and the others reach the source's own scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from copy import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Matcher
from ..plans.parser import java_pattern, matches

E, T, V, AT = "__e", "__t", "__v", "__at"


Frame = DataFrame | Callable[[], DataFrame]


@dataclass
class Source:
    """``frame`` (or a callable giving it) with columns ``time`` (long ms, timestamp or timestamp_ntz) and ``value``.

    Other string columns are labels; ``labels_column`` may hold more in a map, whose keys are ``label_names`` (found by one
    pass over the data if not given).  A source with a table per metric gives a dict of frames by metric name and the
    ``label_names`` that they may have; a query then opens the tables that its name matchers leave, and no others.
    """

    name: str
    frame: Frame | dict[str, Frame]
    labels: dict[str, str] = field(default_factory=dict)
    time: str = "t"
    value: str = "v"
    labels_column: str | None = None
    label_names: list[str] | None = None
    _open: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if isinstance(self.frame, dict) and self.label_names is None:
            raise ValueError(f"source {self.name}: frames by metric need label_names")

    def failure(self) -> str | None:
        """What goes wrong when the source's data are read whole; None if nothing does."""
        try:
            for df in [self._opened(k, f)[0] for k, f in self.frame.items()] if isinstance(self.frame, dict) else [self._opened(None, self.frame)[0]]:
                df.agg(F.count(self.time), F.count(self.value)).collect()
        except Exception as e:
            return str(e).splitlines()[0]
        return None

    def own_labels(self) -> list[str]:
        """The source's own label columns."""
        if isinstance(self.frame, dict):
            return ["__name__", *self._allowed(self.label_names)]
        return self._opened(None, self.frame)[1]

    def parts(self, matchers: tuple[Matcher, ...]) -> list[tuple[DataFrame, list[str], dict[str, str]]]:
        """(frame, label columns, constant labels) that may hold samples of the matchers' names."""
        if not isinstance(self.frame, dict):
            return [(*self._opened(None, self.frame), {})]
        names = [m for m in matchers if m.name == "__name__"]
        found = [(metric, *self._opened(metric, frame)) for metric, frame in self.frame.items() if all(matches(m, metric) for m in names)]
        return [(df, own, {"__name__": metric}) for metric, df, own in found]

    def _opened(self, key: str | None, frame: Frame) -> tuple[DataFrame, list[str]]:
        if key not in self._open:
            df = frame if isinstance(frame, DataFrame) else frame()
            if self.labels_column:
                names = self.label_names
                if names is None:
                    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(self.labels_column))).distinct().collect())
                df = df.select("*", *[F.coalesce(F.col(self.labels_column).getItem(n), F.lit("")).alias(n) for n in names])
            own = [c for c, kind in df.dtypes if kind == "string" and c not in (self.time, self.value, self.labels_column)]
            if isinstance(self.frame, dict):
                own = [c for c in own if c in self.label_names]
            self._open[key] = (df, self._allowed(own))
        return self._open[key]

    def _allowed(self, names: list[str]) -> list[str]:
        bad = [c for c in names if c.startswith("__") and c != "__name__"]
        if bad:
            raise ValueError(f"source {self.name}: label names must not start with __: {bad}")
        return names

    def millis(self, df: DataFrame) -> Column:
        kind = df.schema[self.time].dataType.simpleString()
        if kind in ("timestamp", "timestamp_ntz"):
            return F.unix_millis(F.col(self.time).cast("timestamp"))
        return F.col(self.time).cast("long")

    def bounds(self, df: DataFrame, low: int, high: int) -> Column:
        """low < time <= high on the physical column, so that the scan can skip; loose by a millisecond where it has micros."""
        kind, column = df.schema[self.time].dataType.simpleString(), F.col(self.time)
        if kind in ("timestamp", "timestamp_ntz"):
            return (column > F.timestamp_millis(F.lit(low)).cast(kind)) & (column < F.timestamp_millis(F.lit(high + 1)).cast(kind))
        return (column > low) & (column <= high)


class Catalog:
    """A set of sources whose virtual label sets differ."""

    def __init__(self, sources: list[Source]):
        self.sources = {s.name: s for s in sources}
        if len(self.sources) != len(sources):
            raise ValueError("source names must be unique")
        self.virtual = sorted({n for s in sources for n in s.labels})
        seen: dict[tuple, str] = {}
        for s in sources:
            key = tuple(s.labels.get(n, "") for n in self.virtual)
            if key in seen and len(sources) > 1:
                raise ValueError(f"sources {seen[key]} and {s.name} have the same virtual labels")
            seen[key] = s.name
        #: (source, message) of sources that could not be opened, where the engine goes on without them
        self.warnings: list[str] = []
        self.strict = False

    @classmethod
    def from_config(cls, text: str, opener: Callable[[str], DataFrame], **columns) -> Catalog:
        """``{"endpoints": [{"url": ..., "labels": {...}}]}`` as JSON, or as YAML where a YAML reader is installed."""
        try:
            config = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError:
                raise ValueError("the configuration is no JSON and no YAML reader is installed") from None
            config = yaml.safe_load(text)
        endpoints = (config or {}).get("endpoints") or []
        if not endpoints:
            raise ValueError("no endpoints configured")
        return cls([Source(e["url"], lambda u=e["url"]: opener(u), {k: str(v) for k, v in (e.get("labels") or {}).items()}, **columns) for e in endpoints])

    def view(self, without: Iterable[str] = ()) -> Catalog:
        """The same sources but some, with warnings of its own: what one request works on.  All virtual labels stay known."""
        out = copy(self)
        out.sources = {n: s for n, s in self.sources.items() if n not in set(without)}
        out.warnings = []
        return out

    def virtual_labels(self) -> dict[str, dict[str, str]]:
        return {s.name: {n: s.labels.get(n, "") for n in self.virtual} for s in self.sources.values()}

    def _each(self, ask: Callable[[Source], object]) -> list[tuple[Source, object]]:
        """Every source with what ``ask`` gives; one that can't be opened is a warning, in strict mode an error."""
        out = []
        for s in self.sources.values():
            try:
                out.append((s, ask(s)))
            except Exception as e:
                if self.strict or isinstance(e, ValueError):
                    raise
                self.warnings.append(f"{s.name}: {str(e).splitlines()[0]}")
        return out

    def label_names(self) -> list[str]:
        """Label columns of every selector, in order."""
        return sorted({n for _, own in self._each(Source.own_labels) for n in own} | set(self.virtual))

    def samples(self, matchers: tuple[Matcher, ...], low: int, high: int) -> tuple[DataFrame | None, list[str]]:
        """Samples with low < time <= high: label columns (empty where a series lacks one), __t, __v.  None if no source fits."""
        return self.samples_of_any([matchers], low, high)

    def samples_of_any(self, sets: list[tuple[Matcher, ...]], low: int, high: int) -> tuple[DataFrame | None, list[str]]:
        """Samples that any of the sets of matchers fits, each source read once."""
        names = self.label_names()
        out = None
        for s, parts in self._each(lambda s: list({c.get("__name__"): (df, own, c) for m in sets for df, own, c in s.parts(m)}.values())):
            for df, own, constant in parts:
                fixed = constant | {n: s.labels.get(n, "") for n in self.virtual if s.labels.get(n, "") or n not in own}
                fits = None
                for matchers in sets:
                    static = fixed | {n: "" for n in names if n not in own and n not in fixed} | {m.name: "" for m in matchers if m.name not in names}
                    if not all(matches(m, static[m.name]) for m in matchers if m.name in static):
                        continue
                    this = F.lit(True)
                    for m in matchers:
                        if m.name not in static:
                            plain = m.op in ("=", "=~") and not matches(m, "")  # a null can't match: no coalesce between it and the scan
                            this &= condition(F.col(m.name) if plain else F.coalesce(m.name, F.lit("")), m)
                    fits = this if fits is None else fits | this
                if fits is None:
                    continue
                t, v = s.millis(df), F.col(s.value).cast("double")
                keep = s.bounds(df, low, high) & t.between(low + 1, high) & v.isNotNull() & fits
                static = fixed | {n: "" for n in names if n not in own and n not in fixed}
                columns = [F.lit(static[n]).alias(n) if n in static else F.coalesce(n, F.lit("")).alias(n) for n in names]
                part = df.where(keep).select(*columns, t.alias(T), v.alias(V))
                out = part if out is None else out.unionAll(part)
        return out, names


def condition(column: Column, m: Matcher) -> Column:
    """A matcher as a predicate; regular expressions are anchored on both sides."""
    if m.op == "=":
        return column == m.value
    if m.op == "!=":
        return column != m.value
    test = column.rlike(rf"\A(?s:{java_pattern(m.value)})\z")
    return test if m.op == "=~" else ~test
