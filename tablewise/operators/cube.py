"""The data of many charts from a fixed number of scans.

Charts that count or total rows are group-bys over one to three axes.  ``chart_cells`` gives every row one
short key per chart (chart number, a cell per axis), all in one scan, and combines them map side, so a cell
that holds a third of all rows costs one row per task.  The cells are stored once and every chart reads its
own.  ``axis_ranges``, ``trend_lines`` and ``boxes`` do the same for what the axes, the fitted lines and the
box plots need: one aggregate, one aggregate, and the quantile passes of one grouped call.

An axis is a whole number (a bin, a month, a day, a time) or a text (any other value), so the keys of all
charts share their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators import stats as S
from tablewise.operators.clean import _c, _types
from tablewise.session import materialize

_AS_TEXT = (T.StringType, T.BooleanType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType, T.FloatType, T.DoubleType)


class Axis(NamedTuple):
    """The cell of a value as a number or as a text (the other is None), and the label of a cell."""

    index: Column | None
    text: Column | None
    label: Callable[[Column, Column], Column]

    def cell(self) -> Column:
        return self.text if self.index is None else self.index


class Cells(NamedTuple):
    """One chart: rows where ``keep`` holds, grouped by the axes; ``finish`` makes the chart's frame of
    (a0, a1, ..., count, total), where total is the sum of ``value``."""

    axes: Sequence[Axis]
    keep: Column
    finish: Callable[[DataFrame], DataFrame]
    value: Column | None = None


def axis_ranges(df: DataFrame, numbers: Sequence[str], dates: Sequence[str] = ()) -> dict[str, tuple | int]:
    """One aggregate: (min, max, non-null count) of each numeric column, and the days between the first and
    the last date of each date column (0 if there is none)."""
    aggs = []
    for k, c in enumerate(numbers):
        x = S._num(df, c)
        aggs += [F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}"), F.count(x).alias(f"n{k}")]
    for k, c in enumerate(dates):
        day = _c(c).cast("date")
        aggs.append(F.datediff(F.max(day), F.min(day)).alias(f"d{k}"))
    if not aggs:
        return {}
    r = df.agg(*aggs).first()
    return {c: (r[f"lo{k}"], r[f"hi{k}"], r[f"n{k}"]) for k, c in enumerate(numbers)} | {c: r[f"d{k}"] or 0 for k, c in enumerate(dates)}


def number_axis(df: DataFrame, col: str, stats: tuple, bins: int) -> Axis:
    """``bins`` bins of equal width, labelled by their lower edge."""
    lo, hi, n = stats
    if not n:
        return Axis(F.lit(None).cast("long"), None, lambda _i, _t: F.lit(None).cast("double"))
    lo, width = float(lo), (float(hi) - float(lo)) / bins or 1.0
    x = S._num(df, col)
    k = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)))
    return Axis(k, None, lambda i, _t: F.lit(lo) + i * F.lit(width))


def month_axis(col: str) -> Axis:
    month = F.year(_c(col)) * 12 + F.month(_c(col)) - 1
    return Axis(month, None, lambda i, _t: F.when(i.isNotNull(), F.format_string("%04d-%02d", F.floor(i / 12), F.pmod(i, F.lit(12)) + 1)))


def day_axis(col: str) -> Axis:
    return Axis(F.unix_date(_c(col).cast("date")), None, lambda i, _t: F.date_format(F.date_from_unix_date(i.cast("int")), "yyyy-MM-dd"))


def text_axis(col: str) -> Axis:
    """Whole values as text."""
    return Axis(None, _c(col).cast("string"), lambda _i, t: t)


def value_axis(df: DataFrame, col: str, value: Column | None = None) -> Axis | None:
    """Whole values, labelled in the column's own type; None for arrays, maps and structs."""
    dt = _types(df)[col]
    c = _c(col) if value is None else value
    if isinstance(dt, T.TimestampType):
        return Axis(F.unix_micros(c), None, lambda i, _t: F.timestamp_micros(i))
    if isinstance(dt, T.BinaryType):
        return Axis(None, F.hex(c), lambda _i, t: F.unhex(t))
    if not isinstance(dt, _AS_TEXT):
        return None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # both zeros are one value
    return Axis(None, c.cast("string"), lambda _i, t: t.cast(dt))


def _parts(axes: Sequence[Axis], width: int, fill: bool = False) -> list[Column]:
    """The key columns i0, t0, i1, t1, ... of a cell; ``fill`` puts 0 and '' for what an axis does not use."""
    out = []
    for n in range(width):
        axis = axes[n] if n < len(axes) else None
        for name, c, typ, empty in (("i", axis and axis.index, "long", 0), ("t", axis and axis.text, "string", "")):
            c = (F.lit(empty) if fill else F.lit(None)) if c is None else c
            out.append(c.cast(typ).alias(f"{name}{n}"))
    return out


def _labels(axes: Sequence[Axis], at: Callable[[str], Column]) -> list[Column]:
    return [axis.label(at(f"i{n}"), at(f"t{n}")) for n, axis in enumerate(axes)]


def _exploded(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """One row per row and chart, without those that are NULL."""
    return df.select(F.explode(F.array(*rows)).alias("__c")).filter(F.col("__c").isNotNull()).select("__c.*")


def chart_cells(df: DataFrame, charts: Sequence[Cells]) -> list[DataFrame]:
    """The frames of all charts, in order, from one scan of the table."""
    if not charts:
        return []
    width = max(len(c.axes) for c in charts)
    number = lambda c: (F.lit(None) if c.value is None else c.value).cast("double").alias("v")
    rows = _exploded(df, [F.when(c.keep, F.struct(F.lit(k).alias("chart"), *_parts(c.axes, width), number(c))) for k, c in enumerate(charts)])
    keys = [c for c in rows.columns if c != "v"]
    cube = materialize(rows.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("v").alias("total")))
    out = []
    for k, c in enumerate(charts):
        labels = [x.alias(f"a{n}") for n, x in enumerate(_labels(c.axes, F.col))]
        out.append(c.finish(cube.filter(F.col("chart") == k).select(*labels, "count", "total")))
    return out


def trend_lines(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[DataFrame]:
    """A15 for many (x, y) pairs from one scan: (slope, intercept, r2, n), one row each."""
    if not pairs:
        return []
    rows = _exploded(df, [F.struct(F.lit(k).alias("chart"), S._num(df, x).alias("x"), S._num(df, y).alias("y")) for k, (x, y) in enumerate(pairs)])
    fits = rows.na.drop("any").groupBy("chart").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))
    every = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("chart"))
    lines = materialize(every.join(F.broadcast(fits), "chart", "left"))  # one row per pair
    return [lines.filter(F.col("chart") == k).select("slope", "intercept", "r2", F.coalesce("n", F.lit(0)).cast("long").alias("n")) for k in range(len(pairs))]


def boxes(df: DataFrame, items: Sequence[tuple[str, Sequence[str]]], approx: bool = False) -> list[DataFrame]:
    """A14 for many (value column, group columns): (groups..., q1, median, q3, lower_whisker, upper_whisker,
    mean, sd, n).  All boxes share the quantile passes of one grouped call."""
    if not items:
        return []
    groups = [[value_axis(df, g) for g in by] for _value, by in items]
    width = max(1, *[len(a) for a in groups])
    rows = []
    for k, ((value, _by), axes) in enumerate(zip(items, groups)):
        v = S._num(df, value)
        keep = v.isNotNull()
        for a in axes:
            keep = keep & a.cell().isNotNull()
        rows.append(F.when(keep, F.struct(F.struct(F.lit(k).alias("chart"), *_parts(axes, width, fill=True)).alias("box"), v.alias("v"))))
    found = materialize(S.box_stats(_exploded(df, rows), "v", by="box", approx=approx))
    out = []
    for k, ((_value, by), axes) in enumerate(zip(items, groups)):
        labels = [x.alias(g) for g, x in zip(by, _labels(axes, lambda n: F.col(f"box.{n}")))]
        out.append(found.filter(F.col("box.chart") == k).select(*labels, "q1", "median", "q3", "lower_whisker", "upper_whisker", "mean", "sd", "n"))
    return out
