"""Cleaning operators C1-C13: NaN handling, imputation, de-duplication,
whole-column retyping, min-max scaling, date conversion and the cleaning chain.

Every operator is ``DataFrame -> DataFrame``.  Statistics are computed in one
aggregate per phase (never one job per column) and come back to the driver
only as one small row per column, which is then applied as literals, so the
final plan is a narrow projection over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import (
    DATE_FORMATS,
    DATE_SHAPES,
    INTEGER_REGEX,
    STRICT_NUMBER_REGEX,
    is_numeric_type,
    is_scalar_type,
    nan_to_null,
    strict_number,
)
from tablewise.operators.quantiles import quantiles
from tablewise.session import materialize

STRATEGIES = ("mean", "median", "mode", "drop")
UNKNOWN = "Unknown"


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def long_form(
    df: DataFrame,
    named: Sequence[tuple[str, Column]],
    ids: Sequence[Column] = (),
    var: str = "column",
    val: str = "__cell",
    translate: bool = True,
) -> DataFrame:
    """Unpivot ``named`` (original name, value expression) to rows of
    (ids..., var, val).  Values travel under internal aliases, so names with
    dots or spaces are never parsed as paths.  With ``translate=False`` the
    ``var`` column holds the internal alias; aggregate first, then map the
    (few) result rows back with ``name_of(named)``."""
    safe = [(f"__u{i}", expr) for i, (_name, expr) in enumerate(named)]
    wide = df.select(*ids, *[expr.alias(alias) for alias, expr in safe])
    aliases = {a for a, _e in safe}
    id_names = [c for c in wide.columns if c not in aliases]
    long = wide.unpivot(id_names, [a for a, _e in safe], var, val)
    if translate:
        long = long.withColumn(var, name_of(named)(F.col(var)))
    return long


def name_of(named: Sequence[tuple[str, object]]):
    """Map an internal ``__u{i}`` alias column back to the original name."""
    lookup = F.create_map(*[x for i, (n, _e) in enumerate(named) for x in (F.lit(f"__u{i}"), F.lit(n))])
    return lambda c: lookup[c]


# ---------------------------------------------------------------------------
# C1  NaN -> NULL
# ---------------------------------------------------------------------------


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """NaN in float/double columns becomes NULL (pandas' single 'missing')."""
    types = _types(df)
    if not any(isinstance(t, (T.DoubleType, T.FloatType)) for t in types.values()):
        return df
    return df.select(*[nan_to_null(_c(n), t).alias(n) for n, t in types.items()])


# ---------------------------------------------------------------------------
# Mode of many columns in one shuffle
# ---------------------------------------------------------------------------


def _order_key(c: Column, dt: T.DataType) -> Column:
    """Numeric sort key so ties resolve to the smallest value in natural order."""
    if is_numeric_type(dt):
        return c.cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        # its text form 'yyyy-MM-dd HH:mm:ss[.f]' already sorts in time order,
        # and a cast to an instant would depend on the session time zone
        return F.lit(None).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    return F.lit(None).cast("double")


def zero_unsigned(c: Column, dt: T.DataType) -> Column:
    """-0.0 and 0.0 are one value (pandas and SQL agree; their texts differ)."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
    return c


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value string, okey double, count)`` for every non-null value.

    One Expand + one hash aggregate (partial counts map-side, so a value that
    holds a third of all rows is pre-combined before the shuffle).  The order
    key is part of the group: two instants that read alike in the session zone
    (the hour a clock is set back) stay two values.
    """
    types = _types(df)
    structs = []
    for c in cols:
        x = zero_unsigned(_c(c), types[c])
        structs.append(F.struct(x.cast("string").alias("s"), _order_key(x, types[c]).alias("k")).alias(c))
    named = list(zip(cols, structs))
    long = long_form(df, named, translate=False).filter(F.col("__cell.s").isNotNull())
    vc = long.groupBy("column", F.col("__cell.s").alias("value"), F.col("__cell.k").alias("okey")).agg(F.count("*").alias("count"))
    return vc.select(name_of(named)(F.col("column")).alias("column"), "value", "okey", "count")


#: Texts of up to so many bytes are counted as they are, longer ones by 128-bit hash and their first characters.
SHORT_BYTES, HEAD_CHARS = 64, 32
#: Rows of a top-k that the driver may hold; with more (very many long texts that begin alike and
#: occur equally often) whole values are ranked on the executors.
MAX_TOP_ROWS = 20_000


def _keyed_counts(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """Counts as ``value_counts_long`` (internal column aliases), but no long text is shuffled: it goes by
    two hashes and its first characters.  Also alias -> column, and the cells the counts are made of."""
    types = _types(df)
    structs = []
    for c in cols:
        x = zero_unsigned(_c(c), types[c])
        structs.append((c, F.struct(x.cast("string").alias("s"), _order_key(x, types[c]).alias("k"))))
    cells = long_form(df, structs, translate=False).select("column", F.col("__cell.s").alias("s"), F.col("__cell.k").alias("okey")).where("s is not null")
    long = F.octet_length("s") > SHORT_BYTES
    cells = cells.select(
        "column", "okey", "s", F.when(long, F.substring("s", 1, HEAD_CHARS)).otherwise(F.col("s")).alias("value"),
        F.when(long, F.xxhash64("s")).alias("h1"), F.when(long, F.xxhash64(F.lit(1), "s")).alias("h2"),
    )
    keyed = cells.groupBy("column", "value", "okey", "h1", "h2").agg(F.count("*").alias("count"))
    return keyed, {f"__u{i}": c for i, c in enumerate(cols)}, cells


def top_rows(df: DataFrame, cols: Sequence[str], k: int) -> tuple[DataFrame, dict[str, int]]:
    """(column, rank, value, okey, count) of the ``k`` most frequent values per column (ties: smallest), and
    the number of distinct values of each column.

    Exact for any texts: the hashed counts decide which values can be among the first k (ties are told
    apart by their first characters as far as that goes), and only these winners' whole texts are fetched,
    in one more pass with a broadcast of at most ``MAX_TOP_ROWS`` keys."""
    spark = df.sparkSession
    schema = "column string, rank int, value string, okey double, count long"
    if not cols:
        return spark.createDataFrame([], schema), {}
    keyed, names, cells = _keyed_counts(df, cols)
    best = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("okey"), F.asc("value"))
    top = keyed.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= k).limit(MAX_TOP_ROWS + 1)
    sizes = keyed.groupBy("column").agg(F.count("*").alias("count"))
    none = lambda t: F.lit(None).cast(t)
    sizes = sizes.select("column", none("string").alias("value"), none("double").alias("okey"), none("long").alias("h1"), none("long").alias("h2"), "count", F.lit(0).alias("rank"))
    got = top.select(*sizes.columns).union(sizes).collect()
    rows, unique = [r for r in got if r["rank"]], {names[r["column"]]: r["count"] for r in got if not r["rank"]}
    if len(rows) > MAX_TOP_ROWS:
        whole = value_counts_long(df, cols)
        return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("column", "rank", "value", "okey", "count"), unique
    rows.sort(key=lambda r: (r["column"], r["rank"]))
    if all(r["h1"] is None for r in rows):  # short values are whole: no two of a column tie
        return spark.createDataFrame([(names[r["column"]], r["rank"], r["value"], r["okey"], r["count"]) for r in rows], schema), unique
    key = ["column", "h1", "h2"]
    first = spark.createDataFrame([tuple(r) for r in rows], "column string, value string, okey double, h1 long, h2 long, count long, rank int").drop("rank")
    longer = first.where("h1 is not null").select(*key)
    whole = cells.where("h1 is not null").join(F.broadcast(longer), key).groupBy(*key).agg(F.min("s").alias("s"))
    full = first.join(whole, key, "left").select(name_of([(c, None) for c in cols])(F.col("column")).alias("column"), F.coalesce("s", "value").alias("value"), "okey", "count")
    return full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("column", "rank", "value", "okey", "count"), unique


def _modes(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """column -> (text, order key) of its most frequent value (smallest on ties)."""
    return {r["column"]: (r["value"], r["okey"]) for r in top_rows(df, list(cols), 1)[0].collect()}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column (smallest on ties), as text; None if all-null."""
    got = _modes(df, list(cols))
    return {c: got[c][0] if c in got else None for c in cols}


def mode_literals(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Most frequent value per column as a typed literal; all-null columns are left out.
    Instants come from their microseconds, not from a text in the session zone."""
    types = _types(df)
    out = {}
    for c, (text, okey) in _modes(df, list(cols)).items():
        out[c] = F.timestamp_micros(F.lit(int(okey))) if isinstance(types[c], T.TimestampType) else F.lit(text).cast(types[c])
    return out


# ---------------------------------------------------------------------------
# C2-C6  missing values
# ---------------------------------------------------------------------------


def impute(df: DataFrame, strategy: str = "mean", approx: bool = False) -> DataFrame:
    """Fill missing values.

    * numeric columns: ``mean`` / ``median`` (exact, or approximate) / ``mode``;
    * every other column: mode under all three strategies; an all-null text
      column becomes ``"Unknown"``;
    * ``drop``: rows with any null are removed, nothing is filled.

    Integral columns filled with a mean or median become double (as a pandas
    column holding NaN is float).  NaN counts as missing.
    """
    return _impute(df, strategy, approx)[0]


def _impute(df: DataFrame, strategy: str, approx: bool, extra_aggs: Sequence[Column] = ()) -> tuple[DataFrame, object]:
    """``impute`` plus optional extra aggregates evaluated in its first pass
    over the (NaN-normalised) input; returns (filled frame, that row)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    df = nan_to_null_all(df)
    if strategy == "drop":
        return df.na.drop("any"), None
    types = _types(df)
    scalar = [n for n, t in types.items() if is_scalar_type(t)]
    numeric = [n for n in scalar if is_numeric_type(types[n])]
    aggs = [F.count_if(_c(n).isNull()).alias(f"nulls_{i}") for i, n in enumerate(scalar)]
    aggs += [F.count(_c(n)).alias(f"nn_{i}") for i, n in enumerate(scalar)]
    if strategy == "mean":
        aggs += [F.avg(_c(n)).alias(f"mean_{i}") for i, n in enumerate(numeric)]
    row = df.agg(*aggs, *extra_aggs).first()
    nulls = {n: row[f"nulls_{i}"] for i, n in enumerate(scalar)}
    nonnull = {n: row[f"nn_{i}"] for i, n in enumerate(scalar)}
    need = [n for n in scalar if nulls[n] > 0]
    if not need:
        return df, row

    fills: dict[str, Column] = {}
    num_need = [n for n in need if n in numeric and nonnull[n] > 0]
    if strategy == "mean":
        for i, n in enumerate(numeric):
            if n in num_need:
                fills[n] = F.lit(row[f"mean_{i}"]).cast("double")
    elif strategy == "median" and num_need:
        q = quantiles(df, num_need, [0.5], approx=approx)
        for r in q.select("column", "value").collect():
            fills[r["column"]] = F.lit(r["value"]).cast("double")
    mode_cols = [n for n in need if nonnull[n] > 0 and (n not in numeric or strategy == "mode")]
    fills |= mode_literals(df, mode_cols)
    for n in need:
        if nonnull[n] == 0 and isinstance(types[n], T.StringType):
            fills[n] = F.lit(UNKNOWN)

    out = []
    for n, t in types.items():
        if n not in fills:
            out.append(_c(n))
            continue
        base = _c(n)
        if isinstance(t, T.IntegralType) and strategy in ("mean", "median"):
            base = base.cast("double")
        out.append(F.coalesce(base, fills[n]).alias(n))
    return df.select(*out), row


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (NaN counts) in any / the given columns."""
    df = nan_to_null_all(df)
    if not subset:
        return df.na.drop("any")
    keep = F.lit(True)
    for c in subset:
        keep = keep & _c(c).isNotNull()
    return df.filter(keep)


# ---------------------------------------------------------------------------
# C8 / C9  duplicates
# ---------------------------------------------------------------------------


def dedupe(df: DataFrame) -> DataFrame:
    """Remove exact duplicate rows (NULLs compare equal).

    Spark plans this as a hash aggregate on all columns with map-side partial
    aggregation, so a heavily repeated row is collapsed before the shuffle.
    Map columns compare by their sorted entries.
    """
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keys = [_map_key(f).alias(f"__k{i}") for i, f in enumerate(df.schema.fields)]
    firsts = [F.first(_c(f.name)).alias(f"__v{i}") for i, f in enumerate(df.schema.fields)]
    grouped = df.groupBy(*keys).agg(*firsts)
    return grouped.select(*[F.col(f"__v{i}").alias(f.name) for i, f in enumerate(df.schema.fields)])


def _map_key(f: T.StructField) -> Column:
    """What a column is grouped by: a map as its sorted entries, anything else as it is."""
    if isinstance(f.dataType, T.MapType):
        return F.sort_array(F.map_entries(_c(f.name)))
    return _c(f.name)


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row ``rows, distinct_rows, duplicates`` (duplicates = rows - distinct).

    Rows of more than two columns are counted by a digest: two XXH64 hashes of all flat columns that tell
    null from any value, so whole rows are never shuffled.  Nested columns are keys of their own beside it.
    """
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    keys = [_map_key(f) for f in df.schema.fields if f not in flat]
    if len(flat) > 2:
        nulls = F.concat(*[F.when(_c(f.name).isNull(), "0").otherwise("1") for f in flat])
        cells = [zero_unsigned(_c(f.name), f.dataType) for f in flat]
        keys += [F.xxhash64(nulls, *cells), F.xxhash64(F.lit(1), nulls, *cells)]
    else:
        keys += [_c(f.name) for f in flat]
    grouped = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias("__n"))
    return grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("distinct_rows"),
    ).select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))


# ---------------------------------------------------------------------------
# C10  whole-column numeric retyping
# ---------------------------------------------------------------------------


def numeric_text_plan(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """For text columns, decide 'bigint' / 'double' / keep, from ONE aggregate.

    A column converts only if every non-blank, non-null value is a strict
    number (one bad value keeps the whole column text).  It is integral if
    every value is an integer literal within range and none is blank/null.
    """
    types = _types(df)
    text = [n for n in (cols or types) if isinstance(types[n], T.StringType)]
    if not text:
        return {}
    aggs = []
    for i, n in enumerate(text):
        c = _c(n)
        blank = c.isNull() | (F.trim(c) == "")
        aggs.append(F.count(c).alias(f"nn_{i}"))
        aggs.append(F.count_if(~blank & ~c.rlike(STRICT_NUMBER_REGEX)).alias(f"bad_{i}"))
        aggs.append(
            F.count_if(blank | ~c.rlike(INTEGER_REGEX) | F.trim(c).try_cast("bigint").isNull()).alias(
                f"nonint_{i}"
            )
        )
    row = df.agg(*aggs).first()
    plan = {}
    for i, n in enumerate(text):
        if row[f"nn_{i}"] > 0 and row[f"bad_{i}"] == 0:
            plan[n] = "bigint" if row[f"nonint_{i}"] == 0 else "double"
    return plan


def _prefill_retype_aggs(df: DataFrame, text: Sequence[str]) -> list[Column]:
    """Retype checks on the raw non-null values (see ``clean``)."""
    aggs = []
    for i, n in enumerate(text):
        c = _c(n)
        blank = F.trim(c) == ""
        aggs.append(F.count(c).alias(f"rt_nn_{i}"))
        aggs.append(F.count_if(c.isNotNull() & ~blank & ~c.rlike(STRICT_NUMBER_REGEX)).alias(f"rt_bad_{i}"))
        aggs.append(
            F.count_if(c.isNotNull() & (blank | ~c.rlike(INTEGER_REGEX) | F.trim(c).try_cast("bigint").isNull())).alias(f"rt_nonint_{i}")
        )
    return aggs


def _prefill_retype_plan(row, text: Sequence[str]) -> dict[str, str]:
    plan = {}
    for i, n in enumerate(text):
        if row[f"rt_nn_{i}"] > 0 and row[f"rt_bad_{i}"] == 0:
            plan[n] = "bigint" if row[f"rt_nonint_{i}"] == 0 else "double"
    return plan


def apply_numeric_plan(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    if not plan:
        return df
    out = []
    for f in df.schema.fields:
        n = f.name
        if n in plan:
            if plan[n] == "bigint":
                out.append(F.trim(_c(n)).cast("bigint").alias(n))
            else:
                out.append(strict_number(_c(n)).alias(n))
        else:
            out.append(_c(n))
    return df.select(*out)


def retype_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number-like text columns become bigint/double, whole column or not at all."""
    return apply_numeric_plan(df, numeric_text_plan(df, cols))


# ---------------------------------------------------------------------------
# C11  min-max scaling
# ---------------------------------------------------------------------------


def _minmax_stats(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple]:
    types = _types(df)
    num = [n for n in (cols or types) if is_numeric_type(types[n])]
    if not num:
        return {}
    x = {n: nan_to_null(_c(n).cast("double"), types[n]) for n in num}
    row = df.agg(
        *[F.min(x[n]).alias(f"mn_{i}") for i, n in enumerate(num)],
        *[F.max(x[n]).alias(f"mx_{i}") for i, n in enumerate(num)],
    ).first()
    return {n: (row[f"mn_{i}"], row[f"mx_{i}"]) for i, n in enumerate(num)}


def _scale_with(df: DataFrame, stats: dict[str, tuple]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        n = f.name
        if n in stats:
            lo, hi = stats[n]
            x = nan_to_null(_c(n).cast("double"), f.dataType)
            lo_c, hi_c = F.lit(lo).cast("double"), F.lit(hi).cast("double")
            out.append(F.try_divide(x - lo_c, hi_c - lo_c).alias(n))
        else:
            out.append(_c(n))
    return df.select(*out)


def minmax_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C11: (x - min) / (max - min) for numeric columns; constant column -> NULL.

    One aggregate for every column's min and max, applied as literals."""
    return _scale_with(df, _minmax_stats(df, cols))


# ---------------------------------------------------------------------------
# C13  text dates
# ---------------------------------------------------------------------------


def date_text_plan(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """For text columns: the first format of ``DATE_FORMATS`` under which every
    non-null value parses.

    Phase 1 is one aggregate of cheap shape regexes (a failed date parse costs
    an exception per value, so parsing every column under every format is
    ~30x slower); phase 2 parses only (column, format) pairs whose shape fits
    every value, in one more aggregate, and is skipped when none fits.
    """
    types = _types(df)
    text = [n for n in (cols or types) if isinstance(types[n], T.StringType)]
    if not text:
        return {}
    aggs = [F.count(_c(n)).alias(f"nn_{i}") for i, n in enumerate(text)]
    for i, n in enumerate(text):
        for j, shape in enumerate(DATE_SHAPES):
            aggs.append(F.count_if(_c(n).isNotNull() & ~_c(n).rlike(shape)).alias(f"shape_{i}_{j}"))
    row = df.agg(*aggs).first()
    cands = [
        (i, j)
        for i in range(len(text))
        if row[f"nn_{i}"] > 0
        for j in range(len(DATE_FORMATS))
        if row[f"shape_{i}_{j}"] == 0
    ]
    if not cands:
        return {}
    checks = [
        F.count_if(_c(text[i]).isNotNull() & F.try_to_timestamp(_c(text[i]), F.lit(DATE_FORMATS[j])).isNull()).alias(f"bad_{i}_{j}")
        for i, j in cands
    ]
    row2 = df.agg(*checks).first()
    plan: dict[str, str] = {}
    for i, j in cands:
        if text[i] not in plan and row2[f"bad_{i}_{j}"] == 0:
            plan[text[i]] = DATE_FORMATS[j]
    return plan


def parse_dates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Convert text columns that fully parse under one date format to timestamps."""
    plan = date_text_plan(df, cols)
    if not plan:
        return df
    return df.select(
        *[
            F.try_to_timestamp(_c(f.name), F.lit(plan[f.name])).alias(f.name) if f.name in plan else _c(f.name)
            for f in df.schema.fields
        ]
    )


# ---------------------------------------------------------------------------
# C12  the cleaning chain
# ---------------------------------------------------------------------------


def clean(
    df: DataFrame,
    strategy: str = "mean",
    normalize: bool = False,
    approx: bool = False,
    checkpoint: bool = False,
) -> DataFrame:
    """Missing values -> de-duplicate -> retype -> optional min-max scale.

    The order matters and is kept in the plan: a number-like text column is
    mode-filled before it is retyped, and rows that became equal through
    imputation are de-duplicated (on the text values, before any cast).

    The retype decision and the min/max for scaling depend only on the SET of
    values in each column, which de-duplication does not change, so both are
    computed on the filled table before the de-duplication shuffle.  The
    result is therefore one lazy plan - fill projection, one full-row
    shuffle, cast/scale projection - and no intermediate copy of the table
    is written.  ``checkpoint=True`` additionally writes the result to the
    shared checkpoint folder (for callers that read it many times).
    """
    if strategy == "drop":
        filled = impute(df, strategy, approx=approx)
        plan = numeric_text_plan(filled)
    else:
        # Filling adds only the column's own mode (or "Unknown" to an all-null
        # text column), so "every value is a number / an integer" reads the
        # same on the raw non-null values: the retype checks ride along in
        # the imputation's first aggregate instead of costing another pass.
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        filled, row = _impute(df, strategy, approx, _prefill_retype_aggs(df, text))
        plan = _prefill_retype_plan(row, text)
    scale_src = apply_numeric_plan(filled, plan)
    out = apply_numeric_plan(dedupe(filled), plan)
    if normalize:
        out = _scale_with(out, _minmax_stats(scale_src))
    if checkpoint:
        out = materialize(out)
    return out
