"""Statistics operators A4-A18 and sort/top-k helpers T1-T5.

All results are small aggregated DataFrames; nothing proportional to the
input reaches the driver.  Where a statistic needs a first pass (bounds,
quartiles, min/max) the pass returns one small row per column and the second
pass uses those values as literals, so no join against the big table is
needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.exprs import (
    MONTH_ABBR,
    is_numeric_type,
    nan_to_null,
    strength_label,
)
from tablewise.operators.clean import _c, _types
from tablewise.operators.quantiles import broadcastable, quantiles, quantiles_wide
from tablewise.session import ship_package

# Correlation report thresholds and caps.
MIN_ABS_R = 0.3
MAX_PAIRS = 15
IQR_FACTOR = 1.5
PIE_MAX_CATEGORIES = 8
HIST_MIN_BINS = 10
HIST_MAX_BINS = 50
DENSITY_BINS = 60


def _num(df: DataFrame, c: str) -> Column:
    return nan_to_null(_c(c).cast("double"), _types(df)[c])


def _numeric_cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    types = _types(df)
    return [n for n in (cols or types) if is_numeric_type(types[n])]


# ---------------------------------------------------------------------------
# A4 quartiles
# ---------------------------------------------------------------------------


def quartiles(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A4: (column, q1, q3) with linear interpolation (pandas / quantile_cont)."""
    return quantiles_wide(df, _numeric_cols(df, cols), [0.25, 0.75], ["q1", "q3"], approx=approx)


# ---------------------------------------------------------------------------
# A5 / A6 / V7 correlation
# ---------------------------------------------------------------------------


#: Matrices that one task merges at a level of the tree.
MERGE_FAN_IN = 64


class _Moments:
    """For every pair (x, y) of k columns, over the rows where both are present: the row count ``n``, the mean of
    x as an offset from x's base value, and the central sums of x*x and x*y (those of y are the transposes)."""

    def __init__(self, base: np.ndarray, n: np.ndarray, mean: np.ndarray, cxx: np.ndarray, cxy: np.ndarray):
        self.base, self.n, self.mean, self.cxx, self.cxy = base, n, mean, cxx, cxy

    @classmethod
    def of_batch(cls, x: np.ndarray) -> _Moments:
        """Moments of a batch, around a value of each column: no cancellation for large near numbers."""
        there = ~np.isnan(x)
        base = np.array([x[np.argmax(t), j] if t.any() else 0.0 for j, t in enumerate(there.T)])
        m, d = there.astype(np.float64), np.where(there, x - base, 0.0)
        n, total = m.T @ m, d.T @ m
        some = np.maximum(n, 1.0)
        mean = total / some
        return cls(base, n, mean, (d * d).T @ m - total * mean, d.T @ d - total * total.T / some)

    def merge(self, other: _Moments) -> _Moments:
        """The parallel variance formula; a column that was absent takes the other's base."""
        mine, theirs = self.n.diagonal() > 0, other.n.diagonal() > 0
        base = np.where(mine, self.base, other.base)
        shift = np.where(mine & theirs, other.base - base, 0.0)[:, None]
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        d = np.where((self.n > 0) & (other.n > 0), other.mean + shift - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean + d * other.n / some, other.mean + shift)
        w = self.n * other.n / some
        return _Moments(base, n, mean, self.cxx + other.cxx + d * d * w, self.cxy + other.cxy + d * d.T * w)

    def pack(self) -> bytes:
        return np.concatenate([self.base, *(a.ravel() for a in (self.n, self.mean, self.cxx, self.cxy))]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, k: int) -> _Moments:
        x = np.frombuffer(raw)
        return cls(x[:k], *x[k:].reshape(4, k, k))

    def pairs(self) -> pd.DataFrame:
        """One row per pair i <= j with rows: n, the absolute means and the central sums."""
        i, j = np.triu_indices(len(self.base))
        some = self.n[i, j] > 0
        i, j = i[some], j[some]
        level = np.abs(self.base[:, None] + self.mean)
        return pd.DataFrame({"i": i, "j": j, "n": self.n[i, j], "ax": level[i, j], "ay": level[j, i], "cxx": self.cxx[i, j], "cyy": self.cxx[j, i], "cxy": self.cxy[i, j]})


def _comoments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: its number and the moments of all its rows."""
    from pyspark import TaskContext

    total = None
    for pdf in batches:
        if len(pdf):
            part = _Moments.of_batch(pdf.to_numpy(dtype=np.float64, na_value=np.nan))
            total = part if total is None else total.merge(part)
    if total is not None:
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "moments": [total.pack()]})


def _merge_moments(k: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in pdf.sort_values("task")["moments"]:
            part = _Moments.unpack(raw, k)
            total = part if total is None else total.merge(part)
        return total.pairs() if last else pd.DataFrame({"task": [key[0]], "moments": [total.pack()]})

    return run


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, full: bool = False) -> DataFrame:
    """A5: pairwise-complete Pearson r for all column pairs.

    Returns (col1, col2, i, j, r); ``full=True`` gives the full square incl.
    the diagonal (V7).  NULL r = undefined (constant column, < 2 pairs).  ONE scan
    for any number of columns: each task multiplies its Arrow batches into
    k x k moment matrices around a value of the column, one binary row per task, and these are
    merged by the parallel variance formula in a tree of ``MERGE_FAN_IN`` rows a task.
    """
    num = _numeric_cols(df, cols)
    spark = df.sparkSession
    if len(num) < 2:
        return spark.createDataFrame([], "col1 string, col2 string, i int, j int, r double")
    ship_package(spark)
    wide = df.select(*[_num(df, n).alias(f"c{k}") for k, n in enumerate(num)])
    k = len(num)
    level = wide.mapInPandas(_comoments, "task long, moments binary")
    up = F.floor(F.col("task") / MERGE_FAN_IN).cast("long")
    for _ in range(2):  # with so few rows a level costs next to nothing; 3 levels join 64 ** 3 tasks
        level = level.groupBy(up.alias("task")).applyInPandas(_merge_moments(k, False), "task long, moments binary")
    c = level.groupBy(F.lit(0).alias("task")).applyInPandas(_merge_moments(k, True), "i int, j int, n double, ax double, ay double, cxx double, cyy double, cxy double")
    # spread below the rounding of the mean itself: a constant column
    spread = lambda v, a: F.col(v) > F.col("n") * F.pow(F.lit(4e-16) * F.col(a), F.lit(2.0))
    r = F.when((F.col("n") >= 2) & spread("cxx", "ax") & spread("cyy", "ay"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy"))))
    r = F.when(F.col("i") == F.col("j"), F.when(r.isNotNull(), F.lit(1.0))).otherwise(r)
    every = [(i, j, num[i], num[j]) for i in range(len(num)) for j in range(i + (not full), len(num))]  # pairs of columns
    frame = spark.createDataFrame(every, "i int, j int, col1 string, col2 string")
    out = frame.join(c.select("i", "j", r.alias("r")), ["i", "j"], "left").select("col1", "col2", "i", "j", "r")
    if not full:
        return out
    mirror = out.filter(F.col("i") < F.col("j")).select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), F.col("j").alias("i"), F.col("i").alias("j"), "r")
    return out.unionByName(mirror)


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None, min_abs: float = MIN_ABS_R, cap: int | None = None) -> DataFrame:
    """R rounded to 4, |r| >= 0.3, labelled, by |r| desc.

    Undefined pairs are dropped.  Ties in |r| are ordered by column position.
    ``cap`` keeps only so many pairs; reports that show a list pass
    ``MAX_PAIRS``, counts are taken over all pairs.
    """
    p = correlation_pairs(df, cols).filter(F.col("r").isNotNull())
    p = p.withColumn("correlation", F.round("r", 4)).filter(F.abs("correlation") >= min_abs)
    out = p.select("col1", "col2", "correlation", strength_label(F.col("correlation")).alias("strength"), "i", "j").orderBy(F.desc(F.abs("correlation")), "i", "j")
    return out if cap is None else out.limit(cap)


# ---------------------------------------------------------------------------
# A7 / A8 time buckets
# ---------------------------------------------------------------------------


def monthly_totals(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Sum of ``value_col`` per calendar month (Jan-Dec over all years)."""
    names = F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.col("month"))
    return (
        df.select(F.month(_c(date_col)).alias("month"), _num(df, value_col).alias("__v"))
        .filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.sum("__v").alias("total"))
        .select("month", names.alias("month_name"), "total")
    )


def counts_by_period(df: DataFrame, date_col: str) -> DataFrame:
    """Row count per year-month 'yyyy-MM', in period order."""
    return (
        df.select(F.date_format(_c(date_col), "yyyy-MM").alias("period"))
        .filter(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count("*").alias("count"))
        .orderBy("period")
    )


# ---------------------------------------------------------------------------
# A9 / A10 / E6 / R5 outliers
# ---------------------------------------------------------------------------


def iqr_bounds(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, summary: DataFrame | None = None) -> list[dict]:
    """Per numeric column with >= 4 values and IQR > 0: q1, q3, lower, upper, n.
    ``summary`` (``numeric_summary`` with quartiles) saves the quantile passes."""
    num = _numeric_cols(df, cols)
    if not num:
        return []
    if summary is not None:
        rows = summary.filter(F.col("column").isin(num) & (F.col("count") > 0)).select("column", F.col("q25").alias("q1"), F.col("q75").alias("q3"), F.col("count").alias("n")).collect()
    else:
        q = quantiles(df, num, [0.25, 0.75], approx=approx)
        rows = (
            q.groupBy("column")
            .agg(
                F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
                F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
                F.max("n").alias("n"),
            )
            .collect()
        )
    out = []
    for r in rows:
        if r["n"] < 4 or r["q3"] - r["q1"] == 0:
            continue
        iqr = r["q3"] - r["q1"]
        out.append(
            {"column": r["column"], "q1": r["q1"], "q3": r["q3"], "lower": r["q1"] - IQR_FACTOR * iqr, "upper": r["q3"] + IQR_FACTOR * iqr, "n": r["n"]}
        )
    order = {n: i for i, n in enumerate(num)}
    return sorted(out, key=lambda b: order[b["column"]])


def outlier_report(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, summary: DataFrame | None = None) -> DataFrame:
    """(column, outlier_count, outlier_pct, lower_bound, upper_bound), only
    columns with outliers, by pct desc.  Pass 1 quartiles, pass 2 one
    ``count_if`` per column with literal bounds."""
    spark = df.sparkSession
    schema = "column string, outlier_count long, outlier_pct double, lower_bound double, upper_bound double, ord int"
    bounds = iqr_bounds(df, cols, approx=approx, summary=summary)
    if not bounds:
        return spark.createDataFrame([], schema)
    num = _numeric_cols(df, cols)
    aggs = [
        F.count_if((_num(df, b["column"]) < F.lit(b["lower"])) | (_num(df, b["column"]) > F.lit(b["upper"]))).alias(f"o{k}")
        for k, b in enumerate(bounds)
    ]
    agg = df.agg(*aggs)
    long = agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(b["column"]).alias("column"),
                        F.col(f"o{k}").alias("outlier_count"),
                        F.round(F.col(f"o{k}") / F.lit(b["n"]) * 100, 2).alias("outlier_pct"),
                        F.round(F.lit(b["lower"]), 4).alias("lower_bound"),
                        F.round(F.lit(b["upper"]), 4).alias("upper_bound"),
                        F.lit(num.index(b["column"])).alias("ord"),
                    )
                    for k, b in enumerate(bounds)
                ]
            )
        ).alias("__o")
    ).select("__o.*")
    return long.filter(F.col("outlier_count") > 0).orderBy(F.desc("outlier_pct"), "ord")


def total_outliers(report: DataFrame) -> DataFrame:
    """A10: one row (outliers_detected) = sum of outlier counts."""
    return report.agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("long").alias("outliers_detected"))


def outlier_rows(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Rows whose ``col`` is outside the IQR fences (strict)."""
    b = iqr_bounds(df, [col], approx=approx)
    if not b:
        return df.limit(0)
    x = _num(df, col)
    return df.filter((x < F.lit(b[0]["lower"])) | (x > F.lit(b[0]["upper"])))


# ---------------------------------------------------------------------------
# A11 contingency
# ---------------------------------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """A11 (long form): (a, b, count) for rows where both are non-null."""
    return (
        df.select(_c(a).alias("__a"), _c(b).alias("__b"))
        .na.drop("any")
        .groupBy("__a", "__b")
        .agg(F.count("*").alias("count"))
        .select(F.col("__a").alias(a), F.col("__b").alias(b), "count")
    )


def contingency_wide(df: DataFrame, a: str, b: str, max_levels: int | None = None) -> DataFrame:
    """A11 (crosstab form): one row per value of ``a``, one column per value of ``b``.

    The pivot values are fetched first (they become columns, so their number is
    the result's width), then a single pivot aggregate runs.  A caller may set
    ``max_levels`` to reject wider results; ``contingency`` has no width.
    """
    pair = df.select(_c(a).alias("__a"), _c(b).alias("__b")).na.drop("any")
    if max_levels is not None and pair.select("__b").distinct().limit(max_levels + 1).count() > max_levels:
        raise ValueError(f"{b} has more than {max_levels} distinct values; use contingency()")
    levels = [r[0] for r in pair.select("__b").distinct().orderBy("__b").collect()]
    piv = pair.groupBy("__a").pivot("__b", levels).count().na.fill(0)
    return piv.withColumnRenamed("__a", a)


# ---------------------------------------------------------------------------
# A12 / A13 histograms
# ---------------------------------------------------------------------------


def _bins_for(n: int) -> int:
    return min(HIST_MAX_BINS, max(HIST_MIN_BINS, int(math.sqrt(n))))


def range_stats(df: DataFrame, col: str) -> tuple:
    """(min, max, non-null count) of one column in one aggregate."""
    x = _num(df, col)
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    return st["lo"], st["hi"], st["n"]


def histogram(df: DataFrame, col: str, bins: int | None = None, density: bool = False, stats: tuple | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed; a constant
    column widens to [v-0.5, v+0.5]); empty bins are present as zeros.

    Returns (bin, lo, hi, mid, count[, density]).  ``bins=None`` uses
    min(50, max(10, floor(sqrt(n)))).
    """
    stats = stats if stats is not None else range_stats(df, col)
    bin_of, filled = histogram_layout(df, col, stats, bins, density)
    counts = df.select(bin_of.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"))
    return filled(counts)


def histogram_layout(df: DataFrame, col: str, stats: tuple, bins: int | None = None, density: bool = False) -> tuple[Column, Callable[[DataFrame], DataFrame]]:
    """The bin of a value (NULL for no value) and a function that makes a histogram of counts per bin
    (bin, count), for the ``range_stats`` of a column."""
    x = _num(df, col)
    spark = df.sparkSession
    lo, hi, n = stats
    if not n:
        schema = "bin int, lo double, hi double, mid double, count long, density double"
        return F.lit(None).cast("int"), lambda _counts: spark.createDataFrame([], schema)
    nb = bins or _bins_for(n)
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / nb
    # NULL stays NULL (``least`` alone would skip it and put it in the last bin)
    bin_of = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(nb)).cast("int"), F.lit(nb - 1)))

    def filled(counts: DataFrame) -> DataFrame:
        # every bin index (nb rows, a fixed bound) so empty bins appear as zeros
        all_bins = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
        out = all_bins.join(F.broadcast(counts), "bin", "left").select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
            F.when(F.col("bin") == nb - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        )
        out = out.withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
        if density:
            out = out.withColumn("density", F.col("count") / F.lit(n * width))
        return out.orderBy("bin")

    return bin_of, filled


# ---------------------------------------------------------------------------
# A14 box statistics
# ---------------------------------------------------------------------------


def box_stats(df: DataFrame, value: str, by: str | None = None, approx: bool = False) -> DataFrame:
    """Per group q1, median, q3, whiskers (most extreme values within
    1.5*IQR of the box), mean, sd.  Group NULLs and value NULLs are dropped.

    Pass 1: distributed quartiles per group; pass 2: one grouped aggregate
    with the fences joined in (broadcast when the group count is bounded).
    """
    keys = ["__grp"] if by else []
    d = df.select(*([_c(by).alias("__grp")] if by else []), _num(df, value).alias("__val")).na.drop("any")
    q = quantiles_wide(d, ["__val"], [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=keys, approx=approx).drop("column")
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*keys, "q1", "median", "q3", (F.col("q1") - IQR_FACTOR * iqr).alias("__lf"), (F.col("q3") + IQR_FACTOR * iqr).alias("__uf"))
    v = F.col("__val")
    if not keys:
        # one group: the fences are one row, applied as literals
        f = fences.first()
        if f is None:
            return d.limit(0).select(*[F.lit(None).cast("double").alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker", "mean", "sd")], F.lit(0).cast("long").alias("n"))
        inside = (v >= F.lit(f["__lf"])) & (v <= F.lit(f["__uf"]))
        return d.agg(
            F.lit(f["q1"]).alias("q1"), F.lit(f["median"]).alias("median"), F.lit(f["q3"]).alias("q3"),
            F.min(F.when(inside, v)).alias("lower_whisker"),
            F.max(F.when(inside, v)).alias("upper_whisker"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            F.count(v).alias("n"),
        )
    j = d.join(F.broadcast(fences) if broadcastable(fences, keys) else fences, keys)
    inside = (v >= F.col("__lf")) & (v <= F.col("__uf"))
    agg = j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("lower_whisker"),
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.count(v).alias("n"),
    )
    return agg.withColumnRenamed("__grp", by)


# ---------------------------------------------------------------------------
# A15 trend line, A16 CV, A17 shares, A18 bar totals
# ---------------------------------------------------------------------------


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS y = slope*x + intercept over null-free pairs, with r2 and n."""
    xx, yy = _num(df, x), _num(df, y)
    return df.select(xx.alias("x"), yy.alias("y")).na.drop("any").agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.count("*").alias("n"),
    )


def variability(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, cv, high_variability) with cv = std / |mean|; flag cv > 1."""
    num = _numeric_cols(df, cols)
    agg = df.agg(*[F.stddev_samp(_num(df, n)).alias(f"s{k}") for k, n in enumerate(num)], *[F.avg(_num(df, n)).alias(f"m{k}") for k, n in enumerate(num)])
    long = agg.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("ord"), F.col(f"s{k}").alias("std"), F.col(f"m{k}").alias("mean")) for k, n in enumerate(num)])
        ).alias("__v")
    ).select("__v.*")
    cv = F.try_divide(F.col("std"), F.abs("mean"))
    return long.select("column", "ord", cv.alias("cv"), F.coalesce(cv > 1, F.lit(False)).alias("high_variability"))


def category_shares(df: DataFrame, col: str, max_categories: int = PIE_MAX_CATEGORIES) -> DataFrame:
    """(value, count, share) when the column has at most ``max_categories``
    distinct values, else an empty frame (the pie is not drawn)."""
    vc = (
        df.select(_c(col).alias("value")).filter(F.col("value").isNotNull())
        .groupBy("value").agg(F.count("*").alias("count"))
    )
    empty = vc.limit(0).withColumn("share", F.lit(None).cast("double"))
    # HyperLogLog pre-check: a column with clearly more categories needs no
    # exact value counts (for small counts the sketch is near exact; the
    # exact check below decides the borderline cases)
    if df.agg(F.approx_count_distinct(_c(col)).alias("d")).first()["d"] > 2 * max_categories:
        return empty
    n_levels = vc.limit(max_categories + 1).count()
    if n_levels > max_categories:
        return empty
    total = df.agg(F.count(_c(col)).alias("n")).first()["n"]
    return vc.withColumn("share", F.col("count") / F.lit(total))


def bar_totals(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Sum of y per x (and color): what a stacked bar chart shows."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*[_c(k).alias(k) for k in keys]).agg(F.sum(_num(df, y)).alias("total"))


# ---------------------------------------------------------------------------
# T1 sorted line data
# ---------------------------------------------------------------------------


def sorted_by(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """Rows ordered by ``col`` (nulls last), a distributed range sort.

    A hash of the whole row is the last sort key: the range partitioner
    cannot split one key value, so a value held by a third of the rows would
    otherwise fill one partition; with the tie-breaker equal keys spread over
    as many ranges as they need (their relative order is not meaningful).
    """
    c = _c(col)
    tie = F.xxhash64(*[_c(n) for n in df.columns])
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), tie)
