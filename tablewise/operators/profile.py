"""Profiling operators P1-P15 and basic aggregates A1-A3.

Two shared building blocks keep the job count flat in the number of columns:

* ``numeric_summary`` - ONE long-form aggregate over all numeric columns (count,
  nulls, mean, std, min, max, corrected skew/kurtosis; one scan however many
  columns), joined to distributed quantiles.
* ``top_rows`` (in ``clean``) - ONE Expand + hash aggregate over short keys (long
  texts by hash), ranked by a window with ``rank() <= k``, which Spark plans with a
  partial ``WindowGroupLimit`` before the shuffle (distributed top-k); modes, top-k
  and categorical profiles come from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import (
    corrected_kurtosis,
    corrected_skewness,
    is_numeric_type,
    is_scalar_type,
    nan_to_null,
)
from tablewise.operators.clean import _c, _types, date_text_plan, nan_to_null_all, top_rows, zero_unsigned
from tablewise.operators.quantiles import quantiles_wide
from tablewise.session import cache_tracked

SEMANTIC_TYPES = ["numerical", "categorical", "datetime", "boolean", "high_cardinality"]


def _explode_rows(row_structs: list[Column]) -> Column:
    return F.explode(F.array(*row_structs)).alias("__r")


# ---------------------------------------------------------------------------
# P1 / P2 / P3 / P4
# ---------------------------------------------------------------------------


def shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"))


def _null_expr(name: str, dt: T.DataType) -> Column:
    return nan_to_null(_c(name), dt).isNull()


def missing_per_column(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, missing) - one aggregate, exploded in-plan; only >0 by default."""
    types = _types(df)
    agg = df.agg(*[F.count_if(_null_expr(n, t)).alias(f"m{i}") for i, (n, t) in enumerate(types.items())])
    long = agg.select(
        _explode_rows(
            [F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing"), F.lit(i).alias("ord")) for i, n in enumerate(types)]
        )
    ).select("__r.*")
    if only_missing:
        long = long.filter(F.col("missing") > 0)
    return long


def missing_total(df: DataFrame) -> DataFrame:
    """One row (missing) = total null/NaN cells."""
    types = _types(df)
    total = sum((F.count_if(_null_expr(n, t)) for n, t in types.items()), F.lit(0).cast("long"))
    return df.agg(total.cast("long").alias("missing"))


def table_stats_row(df: DataFrame) -> dict:
    """rows, columns, missing, duplicates as a dict: two one-row aggregates."""
    from tablewise.operators.clean import duplicate_stats

    types = _types(df)
    total = sum((F.count_if(_null_expr(n, t)) for n, t in types.items()), F.lit(0).cast("long"))
    base = df.agg(F.count("*").alias("rows"), total.cast("long").alias("missing")).first()
    dup = duplicate_stats(df).first()
    return {"rows": base["rows"], "columns": len(types), "missing": base["missing"], "duplicates": dup["duplicates"]}


_STATS_SCHEMA = "rows long, columns long, missing long, duplicates long"


def table_stats(df: DataFrame) -> DataFrame:
    """rows, columns, missing, duplicates (used by P4, P14, I4, I8) as one row."""
    r = table_stats_row(df)
    return df.sparkSession.createDataFrame([(r["rows"], r["columns"], r["missing"], r["duplicates"])], _STATS_SCHEMA)


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (metric, before, after, ord) for rows, columns, missing, duplicates."""
    b, a = table_stats_row(before), table_stats_row(after)
    rows = [(m, b[m], a[m], i) for i, m in enumerate(("rows", "columns", "missing", "duplicates"))]
    return before.sparkSession.createDataFrame(rows, "metric string, before long, after long, ord int")


# ---------------------------------------------------------------------------
# Numeric summary: A1, P7, P8, P9
# ---------------------------------------------------------------------------


def numeric_summary(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    with_quartiles: bool = True,
    approx: bool = False,
) -> DataFrame:
    """Per numeric column: count, nulls, mean, std, min, q25, q50, q75, max,
    sum, skewness (G1), kurtosis (G2), plus ``ord`` (schema position).

    One aggregate for the moments + one distributed quantile job.
    """
    types = _types(df)
    num = [n for n in (cols or types) if is_numeric_type(types[n])]
    if not num:
        raise ValueError("no numeric columns")
    # long form: one scan and one set of moment buffers, however many columns
    cell = [F.struct(F.lit(i).alias("ord"), nan_to_null(_c(n).cast("double"), types[n]).alias("v")) for i, n in enumerate(num)]
    v = F.col("v")
    long = (
        df.select(F.explode(F.array(*cell)).alias("__r")).select("__r.*").groupBy("ord").agg(
            F.count(v).alias("count"),
            F.count_if(v.isNull()).alias("nulls"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.sum(v).alias("sum"),
            corrected_skewness(v).alias("skewness"),
            corrected_kurtosis(v).alias("kurtosis"),
        )
    )
    names = df.sparkSession.createDataFrame(list(enumerate(num)), "ord int, column string")  # one row per column
    long = names.join(long, "ord", "left").select(
        "column", "ord", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("count", "nulls")], "mean", "std", "min", "max", "sum", "skewness", "kurtosis"
    )
    if not with_quartiles:
        return long
    q = quantiles_wide(df, num, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], approx=approx)
    return long.join(q, "column", "left")


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, 25%, 50%, 75%, max per numeric column, rounded 4."""
    return _described(numeric_summary(df, cols, approx=approx))


def _described(s: DataFrame) -> DataFrame:
    r = lambda c: F.round(F.col(c), 4).alias(c)
    return s.select(
        "column", "ord", F.col("count").cast("double").alias("count"),
        r("mean"), r("std"), r("min"), r("q25"), r("q50"), r("q75"), r("max"),
    )


def skew_kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, rounded 4."""
    s = numeric_summary(df, cols, with_quartiles=False)
    return s.select("column", "ord", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


def scalar_aggregates(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A1: count, sum, mean, median, min, max per numeric column."""
    s = numeric_summary(df, cols, approx=approx)
    return s.select("column", "ord", "count", "sum", "mean", F.col("q50").alias("median"), "min", "max")


# ---------------------------------------------------------------------------
# Value-count family: A2, A3, P10, P11
# ---------------------------------------------------------------------------


def _scalar_cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    types = _types(df)
    return [n for n in (cols or types) if is_scalar_type(types[n])]


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A2: (column, ord, unique) - distinct non-null values per column.

    One scan for any number of columns (two if fixed-width and wide types mix): every cell becomes a hash,
    distinct map side before the shuffle, so long texts never travel.  XXH64 is one to one on values of
    up to 8 bytes, so their single hash is exact; texts, binaries and wide decimals go by two.
    ``approx=True`` uses HyperLogLog sketches in a single aggregate instead (no
    shuffle of values).
    """
    types = _types(df)
    cols = _scalar_cols(df, cols)
    df = nan_to_null_all(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, ord int, unique long")
    if approx:
        agg = df.agg(*[F.approx_count_distinct(_c(n)).alias(f"u{i}") for i, n in enumerate(cols)])
        return agg.select(
            _explode_rows(
                [F.struct(F.lit(n).alias("column"), F.lit(i).alias("ord"), F.col(f"u{i}").cast("long").alias("unique")) for i, n in enumerate(cols)]
            )
        ).select("__r.*")
    cell = {n: zero_unsigned(_c(n), types[n]) for n in cols}
    hashed = {n: F.when(cell[n].isNotNull(), F.xxhash64(cell[n])) for n in cols}
    narrow = [n for n in cols if _fixed_width(types[n])]
    wide = [n for n in cols if n not in narrow]
    found = []
    if narrow:
        ords = F.array(*[F.lit(cols.index(n)) for n in narrow])
        long = df.select(F.posexplode(F.array(*[hashed[n] for n in narrow])).alias("at", "h")).where("h is not null").distinct()
        found.append(long.groupBy("at").agg(F.count("*").alias("unique")).select(F.get(ords, F.col("at")).alias("ord"), "unique"))
    if wide:
        cells = [F.when(cell[n].isNotNull(), F.struct(F.lit(cols.index(n)).alias("ord"), hashed[n].alias("h1"), F.xxhash64(F.lit(1), cell[n]).alias("h2"))) for n in wide]
        long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("__r")).select("__r.*").distinct()
        found.append(long.groupBy("ord").agg(F.count("*").alias("unique")))
    counts = found[0] if len(found) == 1 else found[0].union(found[1])
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "ord int, column string")  # one row per column
    return names.join(counts, "ord", "left").select("column", "ord", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"))


def _fixed_width(t: T.DataType) -> bool:
    return not isinstance(t, (T.StringType, T.BinaryType)) and not (isinstance(t, T.DecimalType) and t.precision > 18)


#: Theta sketches keep the 2**12 smallest hashes of a column: fewer distinct values than that are counted exactly.
SKETCH_BITS = 12
EXACT_BELOW = 1 << SKETCH_BITS


#: Columns counted by a branch of their own: each reads only its column, together not more than one scan does.
BRANCHES = 8


def _sketched_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Estimated distinct values per column by bottom-k (theta) sketches: one bounded, mergeable row per
    task; the exact number wherever it is below ``EXACT_BELOW``."""
    types = _types(df)
    if not cols:
        return {}
    cells = {n: zero_unsigned(_c(n), types[n]) for n in cols}
    # hashed in a projection of their own: the aggregate that holds sketches is not compiled
    hashed = df.select(*[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"h{i}") for i, c in enumerate(cells.values())])
    row = hashed.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(f"h{i}", F.lit(SKETCH_BITS))).alias(f"u{i}") for i in range(len(cols))]).first()
    return {n: row[f"u{i}"] for i, n in enumerate(cols)}


def _exact_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Distinct values of columns that have many."""
    if not cols:
        return {}
    if approx or len(cols) > BRANCHES:
        return {r["column"]: r["unique"] for r in distinct_counts(df, cols, approx=approx).collect()}
    types = _types(df)
    found = None
    for n in cols:
        c = zero_unsigned(_c(n), types[n])
        keys = [F.xxhash64(c).alias("h1")] + ([] if _fixed_width(types[n]) else [F.xxhash64(F.lit(1), c).alias("h2")])
        one = df.where(c.isNotNull()).select(*keys).distinct().agg(F.lit(n).alias("column"), F.count("*").alias("unique"))
        found = one if found is None else found.union(one)
    return {r["column"]: r["unique"] for r in found.collect()}


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3: (value, count) of one column, non-null, ordered count desc then value."""
    c = nan_to_null(_c(col), _types(df)[col])
    return (
        df.select(c.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
    )


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 20, width: int | None = None) -> DataFrame:
    """Per column the k most frequent values (ties: smallest value).

    Returns (column, rank, value, count).  ``width`` cuts the value text.
    """
    top, _unique = top_rows(nan_to_null_all(df), _scalar_cols(df, cols), k)
    value = F.col("value") if width is None else F.substring("value", 1, width)
    return top.select("column", "rank", value.alias("value"), "count")


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P10: non-numeric columns -> (column, unique, top_value, top_count)."""
    types = _types(df)
    cols = [n for n in _scalar_cols(df, cols) if not is_numeric_type(types[n])]
    return _profiled(df, cols, *top_rows(df, cols, 1))


def _profiled(df: DataFrame, cols: Sequence[str], top: DataFrame, unique: dict[str, int]) -> DataFrame:
    """Rows of P10 from ranked values and the numbers of distinct values."""
    names = df.sparkSession.createDataFrame([(n, i, unique.get(n, 0)) for i, n in enumerate(cols)], "column string, ord int, unique long")  # one row per column
    return names.join(top.where("rank = 1"), "column", "left").select(
        "column", "ord", "unique", F.col("value").alias("top_value"), F.coalesce("count", F.lit(0)).cast("long").alias("top_count")
    )


# ---------------------------------------------------------------------------
# P5 semantic typing, P6 catalogue, P15 type counts
# ---------------------------------------------------------------------------


def column_types(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, counts: bool = True) -> DataFrame:
    """P5: (column, ord, type, non_null, unique) with the reference's precedence.

    timestamp/date type -> text parsing under one date format -> exactly 2
    distinct -> numeric (bool counts as numeric here) -> text split into
    high_cardinality (unique/rows > 0.5 or unique > 50) / categorical.
    An all-null text column is categorical.  Complex columns are skipped.

    One aggregate computes the row count, non-null counts and date-shape screens, a second one a
    distinct-value sketch for every column; only text columns whose shape fits a date format
    get another (parse) pass.  The sketch is exact below ``EXACT_BELOW`` values, which settles every
    type: a text with more is above 50.  ``counts`` says whether ``unique`` must be exact: if so, columns
    with more values are counted by hashes (``approx=True``: HyperLogLog), otherwise their ``unique`` is the sketch's estimate.
    """
    from tablewise.functions.exprs import DATE_FORMATS, DATE_SHAPES

    types = _types(df)
    cols = _scalar_cols(df, cols)
    df = nan_to_null_all(df)
    text = [n for n in cols if isinstance(types[n], T.StringType)]
    aggs = [F.count("*").alias("__rows")]
    aggs += [F.count(_c(n)).alias(f"nn{i}") for i, n in enumerate(cols)]
    aggs += [
        F.count_if(_c(n).isNotNull() & ~_c(n).rlike(shape)).alias(f"sh{i}_{j}")
        for i, n in enumerate(cols)
        if n in text
        for j, shape in enumerate(DATE_SHAPES)
    ]
    row = df.agg(*aggs).first()
    uniq_row = _sketched_counts(df, cols)
    if counts:
        uniq_row |= _exact_counts(df, [n for n in cols if uniq_row[n] >= EXACT_BELOW], approx)
    shaped = [n for i, n in enumerate(cols) if n in text and row[f"nn{i}"] > 0 and any(row[f"sh{i}_{j}"] == 0 for j in range(len(DATE_FORMATS)))]
    date_plan = date_text_plan(df, shaped) if shaped else {}
    n_rows = row["__rows"]
    out = []
    for i, n in enumerate(cols):
        dt = types[n]
        uniq, nn = uniq_row[n], row[f"nn{i}"]
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) or n in date_plan:
            typ = "datetime"
        elif uniq == 2:
            typ = "boolean"
        elif is_numeric_type(dt) or isinstance(dt, T.BooleanType):
            typ = "numerical"
        elif uniq / max(n_rows, 1) > 0.5 or uniq > 50:
            typ = "high_cardinality"
        else:
            typ = "categorical"
        out.append((n, i, typ, nn, uniq))
    # one row per column: column-sized metadata, not data
    return df.sparkSession.createDataFrame(out, "column string, ord int, type string, non_null long, unique long")


def type_counts(types_df: DataFrame) -> DataFrame:
    """(type, columns) counts over a ``column_types`` result."""
    return types_df.groupBy("type").agg(F.count("*").alias("columns"))


def column_catalog(df: DataFrame) -> DataFrame:
    """(column, ord, dtype, non_null, nulls, unique)."""
    types = _types(df)
    cols = _scalar_cols(df, None)
    d = nan_to_null_all(df)
    row = d.agg(F.count("*").alias("rows"), *[F.count(_c(n)).alias(f"nn{i}") for i, n in enumerate(cols)]).first()
    uniq = _sketched_counts(d, cols)
    uniq |= _exact_counts(d, [n for n in cols if uniq[n] >= EXACT_BELOW])
    out = [(n, i, types[n].simpleString(), row[f"nn{i}"], row["rows"] - row[f"nn{i}"], uniq[n]) for i, n in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "column string, ord int, dtype string, non_null long, nulls long, unique long")  # one row per column


def sample_values(df: DataFrame, cols: Sequence[str], k: int = 2, width: int = 20) -> DataFrame:
    """Per column the k smallest distinct values, cut to ``width`` chars
    after they were chosen (so two long values with one prefix are both shown).

    (The reference shows the first two rows; Spark has no row order, so the
    smallest two distinct values are used - a deterministic choice.)
    k global aggregates - the smallest value, then the smallest above it -
    replace a distinct over all values: no shuffle of values, and only k
    values per column reach the driver.
    """
    text = {n: _c(n).cast("string") for n in cols}
    prev: dict[str, str | None] = {n: None for n in cols}
    rows = []
    for rank in range(1, k + 1):
        live = [n for n in cols if rank == 1 or prev[n] is not None]
        if not live:
            break
        aggs = [
            F.min(text[n] if rank == 1 else F.when(text[n] > F.lit(prev[n]), text[n])).alias(f"m{i}")
            for i, n in enumerate(live)
        ]
        got = df.agg(*aggs).first()
        for i, n in enumerate(live):
            v = got[f"m{i}"]
            prev[n] = v
            if v is not None:
                rows.append((n, rank, v[:width]))
    return df.sparkSession.createDataFrame(rows, "column string, rank int, value string")


def planning_metadata(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per non-high-cardinality column: type, non-null, unique; min/max/mean
    for numericals; two sample values (cut to 20) for categoricals."""
    types_df = column_types(df, approx=approx)
    num_cols = [r["column"] for r in types_df.filter(F.col("type") == "numerical").select("column").collect()]
    cat_cols = [r["column"] for r in types_df.filter(F.col("type") == "categorical").select("column").collect()]
    out = types_df.filter(F.col("type") != "high_cardinality")
    if num_cols:
        ns = numeric_summary(df, num_cols, with_quartiles=False).select("column", "min", "max", "mean")
        out = out.join(F.broadcast(ns), "column", "left")  # one row per column
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean")])
    if cat_cols:
        sv = sample_values(df, cat_cols).groupBy("column").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
        )
        out = out.join(F.broadcast(sv), "column", "left")  # one row per column
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return out.select("column", "ord", "type", "non_null", "unique", "min", "max", "mean", "sample_values")


def statistical_summary(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """Numeric describe + skew/kurtosis, categorical profiles with top-20
    counts, missing per column, shape (a dict of small DataFrames)."""
    types = _types(df)
    has_num = any(is_numeric_type(t) for t in types.values())
    out: dict[str, DataFrame] = {}
    if has_num:
        s = numeric_summary(df, approx=approx)
        out["numerical"] = s.select(
            "column", "ord", F.col("count").cast("double").alias("count"),
            *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")],
        )
    cat = [n for n, t in types.items() if not is_numeric_type(t) and is_scalar_type(t)]
    if cat:
        top, unique = top_rows(nan_to_null_all(df), cat, 20)  # both come from one ranking
        out["categorical"] = _profiled(df, cat, top, unique)
        out["value_counts"] = top.select("column", "rank", "value", "count")
    out["missing_values"] = missing_per_column(df)
    out["shape"] = shape(df)
    return out


def compact_summary(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """Shape, total missing, duplicates, describe, skew, kurtosis, categorical profile."""
    types = _types(df)
    out = {"table": table_stats(df)}
    if any(is_numeric_type(t) for t in types.values()):
        s = cache_tracked(numeric_summary(df, approx=approx))  # one row per column, used twice
        out["numerical"] = _described(s)
        out["moments"] = s.select("column", "ord", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))
    if any(not is_numeric_type(t) and is_scalar_type(t) for t in types.values()):
        out["categorical"] = categorical_profile(df)
    return out
