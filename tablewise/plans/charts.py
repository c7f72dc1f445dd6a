"""Chart-ready datasets V1-V12 (drawing itself is not built).

Each chart is a small aggregated DataFrame; the chart *plan* is a DataFrame
(ord, kind, chart_type, x, y, color, title, description) derived from the
semantic column types, whose size is bounded by the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import nan_to_null, numeric_columns
from tablewise.operators import cube as Q
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.operators.clean import _c, _types, parse_dates

# Plan caps and chart titles of the rule-based plan.
MAX_PAIR_NUMERICS = 6
MAX_BOX_CATEGORICALS = 3
MAX_BOX_NUMERICS = 3
MAX_TIME_DATETIMES = 2
MAX_TIME_NUMERICS = 2
TITLE_DISTRIBUTION = "Distribution of '{x}'"
TITLE_VALUE_COUNTS = "Value Counts – '{x}'"
TITLE_TIME_SERIES = "Time Series – '{x}'"
TITLE_SCATTER = "'{x}' vs '{y}'"
TITLE_BOX = "'{y}' by '{x}'"
TITLE_OVER_TIME = "'{y}' over time"
HEATMAP_TITLE = "Pearson Correlation Heatmap"
TOP_UNIVARIATE = 20
TOP_DISTRIBUTION = 10
SUPPORTED_PLAN_TYPES = ["line", "bar", "scatter", "box", "heatmap"]

PLAN_SCHEMA = "ord int, kind string, chart_type string, x string, y string, color string, title string, description string"


def _types_map(df: DataFrame, types_df: DataFrame | None = None) -> dict[str, str]:
    t = types_df if types_df is not None else P.column_types(df, counts=False)  # types only
    return {r["column"]: r["type"] for r in t.select("column", "type", "ord").orderBy("ord").collect()}


def _by_type(tmap: dict[str, str], typ: str) -> list[str]:
    return [c for c, t in tmap.items() if t == typ]


def dated(df: DataFrame, tmap: dict[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns typed datetime (``12/31/2023``) as timestamps: parsed once, under the format all
    their values fit (C13).  ``cols`` names the columns a chart needs."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and tmap.get(f.name) == "datetime" and (cols is None or f.name in cols)]
    return parse_dates(df, text) if text else df


# ---------------------------------------------------------------------------
# V1 univariate, V2-V6 bivariate, V7 heat map, V8 distribution grid
# ---------------------------------------------------------------------------


def univariate(df: DataFrame, col: str, tmap: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """V1: numerical -> histogram + density; categorical/boolean -> value
    counts; datetime -> counts per month; anything else -> top 20."""
    tmap = tmap or _types_map(df)
    t = tmap.get(col)
    if t == "numerical":
        st = S.range_stats(df, col)  # one min/max/count pass for both charts
        return {"histogram": S.histogram(df, col, stats=st), "density": S.histogram(df, col, bins=S.DENSITY_BINS, density=True, stats=st)}
    if t in ("categorical", "boolean"):
        return {"value_counts": P.value_counts(df, col)}
    if t == "datetime":
        return {"by_period": S.counts_by_period(dated(df, tmap, [col]), col)}
    return {"top": P.top_values(df, [col], k=TOP_UNIVARIATE)}


def scatter_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """V2 / V6: the null-free (x, y[, color]) pairs."""
    cols = [x, y] + ([color] if color else [])
    return df.select(*[_c(c).alias(c) for c in cols]).filter(_c(x).isNotNull() & _c(y).isNotNull())


def time_series(df: DataFrame, dt: str, y: str, period: str | None = None) -> DataFrame:
    """V5: points in time order, or totals per 'day' / 'month' period."""
    pairs = scatter_data(df, dt, y)
    if period is None:
        return S.sorted_by(pairs, dt)
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[period]
    return pairs.groupBy(F.date_format(_c(dt), fmt).alias("period")).agg(F.sum(_c(y)).alias("total")).orderBy("period")


def bivariate(df: DataFrame, a: str, b: str, tmap: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """V2-V6 dispatch on the two semantic types; returns (chart_type, data).

    Scatter, strip and line hold the raw pairs here, as many as the table has;
    ``bivariate_data`` gives the aggregates a chart of a large table is drawn from."""
    tmap = tmap or _types_map(df)
    df = dated(df, tmap, [a, b])
    ta, tb = tmap.get(a), tmap.get(b)
    cat = ("categorical", "boolean")
    if ta == "numerical" and tb == "numerical":
        return "scatter", scatter_data(df, a, b)
    if (ta in cat and tb == "numerical") or (ta == "numerical" and tb in cat):
        g, v = (a, b) if ta in cat else (b, a)
        return "box", S.box_stats(df, v, by=g)
    if ta in cat and tb in cat:
        return "stacked_bar", S.contingency(df, a, b)
    if ta == "datetime" and tb == "numerical":
        return "line", time_series(df, a, b)
    return "strip", scatter_data(df, a, b)


def _axis(df: DataFrame, col: str, typ: str | None, bins: int) -> Column:
    """The cell of a value along one axis: equal-width bins of numbers (their lower edge), months of
    dates, whole values of any text, however many there are."""
    if typ == "numerical":
        lo, hi, n = S.range_stats(df, col)
        if not n:
            return F.lit(None).cast("double")
        lo, width = float(lo), (float(hi) - float(lo)) / bins or 1.0
        x = S._num(df, col)
        k = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        return F.when(x.isNotNull(), F.lit(lo) + k * F.lit(width))
    if typ == "datetime":
        return F.date_format(_c(col), "yyyy-MM")
    return _c(col).cast("string")


def binned_pairs(df: DataFrame, x: str, y: str, tmap: dict[str, str], color: str | None = None, bins: int = 30) -> DataFrame:
    """V2 / V6 over the whole table: (x, y[, color], count) of a grid of at most ``bins`` cells per
    numeric axis - every null-free pair is counted, none is sampled.

    Text is grouped by its whole value, combined map side: an axis of distinct values gives as many
    cells as pairs.  A choice or shortening for display is the caller's, after the counts."""
    df = dated(df, tmap, [x, y])
    cells = [_axis(df, x, tmap.get(x), bins).alias("x"), _axis(df, y, tmap.get(y), bins).alias("y")]
    if color:
        cells.append(_axis(df, color, tmap.get(color), bins).alias("color"))
    return df.select(*cells).filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*(["x", "y"] + ["color"] * bool(color))).agg(F.count("*").alias("count"))


def period_totals(df: DataFrame, dt: str, y: str, tmap: dict[str, str], color: str | None = None) -> DataFrame:
    """V5 over the whole table: (period[, color], total, mean, count) in time order; days when the
    dates span up to a year, else months."""
    df = dated(df, tmap, [dt])
    span = df.agg(F.datediff(F.max(_c(dt).cast("date")), F.min(_c(dt).cast("date"))).alias("d")).first()["d"]
    period = F.date_format(_c(dt), "yyyy-MM-dd" if (span or 0) <= 366 else "yyyy-MM").alias("period")
    rows = df.select(period, S._num(df, y).alias("v"), *([_c(color).alias("color")] if color else [])).filter(F.col("period").isNotNull() & F.col("v").isNotNull())
    keys = ["period"] + ["color"] * bool(color)
    return rows.groupBy(*keys).agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.count("*").alias("count")).orderBy(*keys)


def bivariate_data(df: DataFrame, a: str, b: str, tmap: dict[str, str] | None = None) -> tuple[str, dict[str, DataFrame]]:
    """V2-V6 as aggregates of the whole table: (chart_type, named frames).  A scatter comes with its trend line."""
    tmap = tmap or _types_map(df)
    ta, tb = tmap.get(a), tmap.get(b)
    if ta == "numerical" and tb == "numerical":
        return "scatter", {"scatter": binned_pairs(df, a, b, tmap), "trend_line": S.trend_line(df, a, b)}
    if ta == "datetime" and tb == "numerical":
        return "line", {"line": period_totals(df, a, b, tmap)}
    kind, frame = bivariate(df, a, b, tmap)
    return kind, {kind: binned_pairs(df, a, b, tmap) if kind == "strip" else frame}


def heatmap(df: DataFrame) -> DataFrame | None:
    """V7: full correlation square (x, y, r) incl. diagonal; None if < 2 numerics."""
    if len(numeric_columns(df)) < 2:
        return None
    p = S.correlation_pairs(df, full=True)
    return p.select(F.col("col1").alias("x"), F.col("col2").alias("y"), "r", "i", "j")


def distribution(df: DataFrame, col: str, tmap: dict[str, str] | None = None) -> tuple[str, DataFrame]:
    """V8 (one cell): numerical -> box; categorical/boolean -> pie (<= 8 values)
    or bar; datetime -> monthly bars; other -> top 10."""
    tmap = tmap or _types_map(df)
    t = tmap.get(col)
    if t == "numerical":
        return "box", S.box_stats(df, col)
    if t in ("categorical", "boolean"):
        shares = S.category_shares(df, col)
        if shares.limit(1).count():
            return "pie", shares
        return "bar", P.value_counts(df, col)
    if t == "datetime":
        return "bar", S.counts_by_period(dated(df, tmap, [col]), col)
    return "bar", P.top_values(df, [col], k=TOP_DISTRIBUTION)


def distribution_grid(df: DataFrame, tmap: dict[str, str] | None = None) -> list[tuple[str, str, DataFrame]]:
    """V8: one (column, chart_type, data) per column, in column order."""
    tmap = tmap or _types_map(df)
    return [(c, *distribution(df, c, tmap)) for c in df.columns if c in tmap]


# ---------------------------------------------------------------------------
# V9 rule plan, V10 external plan, V11 classes, V12 records, R8 filters
# ---------------------------------------------------------------------------


def rule_plan_rows(
    tmap: dict[str, str],
    numeric_dtype_cols: Sequence[str],
    pair_numerics: int = MAX_PAIR_NUMERICS,
    box_categoricals: int = MAX_BOX_CATEGORICALS,
    box_numerics: int = MAX_BOX_NUMERICS,
    time_datetimes: int = MAX_TIME_DATETIMES,
    time_numerics: int = MAX_TIME_NUMERICS,
) -> list[tuple]:
    """V9 rows; the parameters say how many columns of each kind get two-column charts."""
    rows: list[tuple] = []

    def add(kind, chart, x, y, title):
        rows.append((len(rows), kind, chart, x, y, None, title, ""))

    for c, t in tmap.items():
        if t == "high_cardinality":
            continue
        if t == "numerical":
            add("univariate", "histogram", c, None, TITLE_DISTRIBUTION.format(x=c))
        elif t in ("categorical", "boolean"):
            add("univariate", "bar", c, None, TITLE_VALUE_COUNTS.format(x=c))
        elif t == "datetime":
            add("univariate", "line", c, None, TITLE_TIME_SERIES.format(x=c))
    nums = _by_type(tmap, "numerical")[:pair_numerics]
    for i, c1 in enumerate(nums):
        for c2 in nums[i + 1:]:
            add("bivariate", "scatter", c1, c2, TITLE_SCATTER.format(x=c1, y=c2))
    for cat in _by_type(tmap, "categorical")[:box_categoricals]:
        for num in nums[:box_numerics]:
            add("bivariate", "box", cat, num, TITLE_BOX.format(x=cat, y=num))
    for dt in _by_type(tmap, "datetime")[:time_datetimes]:
        for num in nums[:time_numerics]:
            add("bivariate", "line", dt, num, TITLE_OVER_TIME.format(x=dt, y=num))
    if len(numeric_dtype_cols) >= 2:
        add("correlation", "heatmap", None, None, HEATMAP_TITLE)
    return rows


def rule_plan(df: DataFrame, types_df: DataFrame | None = None, **limits: int) -> DataFrame:
    """V9: the rule-based chart plan as a DataFrame (bounded by the column count); ``limits``
    are those of ``rule_plan_rows``."""
    tmap = _types_map(df, types_df)
    rows = rule_plan_rows(tmap, numeric_columns(df), **limits)
    return df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)


def classify_plan(plan: DataFrame) -> DataFrame:
    """kind = correlation (heat map) / bivariate ('vs', '×', ' by ' in
    the title) / univariate."""
    t = F.lower(F.coalesce(F.col("title"), F.lit("")))
    kind = (
        F.when(F.col("chart_type") == "heatmap", "correlation")
        .when(t.contains("vs") | F.col("title").contains("×") | t.contains(" by "), "bivariate")
        .otherwise("univariate")
    )
    return plan.withColumn("kind", kind)


def filter_plan(plan: DataFrame, kind: str | None = None, chart_type: str | None = None) -> DataFrame:
    """Keep plan/chart records of one kind and/or chart type."""
    out = plan
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if chart_type is not None:
        out = out.filter(F.col("chart_type") == chart_type)
    return out


PLAN_ITEM = "title string, description string, chart_type string, x string, y string, color string"


def parse_plan(replies: DataFrame, col: str) -> DataFrame:
    """E2 applied to a plan reply: rows of (ord, title, description, chart_type, x, y, color);
    ``ord`` is the item's place in the reply, a missing title or description is empty."""
    from tablewise.operators.enrich import parse_reply

    return parse_reply(replies, col, PLAN_ITEM, kind="array", position="ord").fillna("", ["title", "description"])


def validate_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """V10 (checks): drop items whose x or y is not a column or whose type is
    unsupported; an unknown color is ignored (NULL).  Adds ord and kind."""
    names = F.array(*[F.lit(c) for c in df.columns])
    known = lambda c: F.col(c).isNull() | (F.col(c) == "") | F.array_contains(names, F.col(c))
    ok = known("x") & known("y") & F.col("chart_type").isin(SUPPORTED_PLAN_TYPES)
    color = F.when(F.array_contains(names, F.col("color")), F.col("color"))
    p = plan.filter(ok).withColumn("color", color)
    if "ord" not in p.columns:
        p = p.withColumn("ord", F.monotonically_increasing_id())
    return classify_plan(p)


def _counted(df: DataFrame, x: str) -> Q.Cells | DataFrame:
    """A3 as cells: (value, count)."""
    value = nan_to_null(_c(x), _types(df)[x])
    axis = Q.value_axis(df, x, value)
    if axis is None:
        return P.value_counts(df, x)
    return Q.Cells([axis], value.isNotNull(), lambda t: t.select(F.col("a0").alias("value"), "count").orderBy(F.desc("count"), F.asc("value")))


def _periods(x: str) -> Q.Cells:
    """A8 as cells: (period, count)."""
    return Q.Cells([Q.month_axis(x)], _c(x).isNotNull(), lambda t: t.select(F.col("a0").alias("period"), "count").orderBy("period"))


def _totals(df: DataFrame, x: str, y: str, color: str | None) -> Q.Cells | DataFrame:
    """A18 as cells: (x[, color], total); rows without a value on an axis make a group of their own."""
    names = [x] + [color] * bool(color)
    axes = [Q.value_axis(df, c) for c in names]
    if None in axes:
        return S.bar_totals(df, x, y, color)
    return Q.Cells(axes, F.lit(True), lambda t: t.select(*[F.col(f"a{n}").alias(c) for n, c in enumerate(names)], "total"), S._num(df, y))


def _timed(df: DataFrame, dt: str, y: str, days: int, color: str | None = None) -> Q.Cells | DataFrame:
    """V5 as cells: as ``period_totals``."""
    colors = [Q.value_axis(df, color)] if color else []
    if None in colors:
        return period_totals(df, dt, y, {}, color)
    keys = ["period"] + ["color"] * bool(color)
    v = S._num(df, y)

    def finish(t: DataFrame) -> DataFrame:
        labels = [F.col(f"a{n}").alias(c) for n, c in enumerate(keys)]
        return t.select(*labels, "total", (F.col("total") / F.col("count")).alias("mean"), "count").orderBy(*keys)

    return Q.Cells([Q.day_axis(dt) if days <= 366 else Q.month_axis(dt), *colors], _c(dt).isNotNull() & v.isNotNull(), finish, v)


def _grid(df: DataFrame, x: str, y: str, color: str | None, tmap: dict[str, str], ranges: dict, bins: int = 30) -> Q.Cells:
    """V2 / V6 as cells: as ``binned_pairs``."""
    names = [x, y] + [color] * bool(color)
    kinds = [tmap.get(c) for c in names]
    axes = [Q.number_axis(df, c, ranges[c], bins) if k == "numerical" else Q.month_axis(c) if k == "datetime" else Q.text_axis(c) for c, k in zip(names, kinds)]
    shown = ["x", "y"] + ["color"] * bool(color)
    return Q.Cells(axes, axes[0].cell().isNotNull() & axes[1].cell().isNotNull(), lambda t: t.select(*[F.col(f"a{n}").alias(c) for n, c in enumerate(shown)], "count"))


def _bars(df: DataFrame, x: str, stats: tuple, **how) -> Q.Cells:
    """A12 / A13 as cells."""
    bin_of, filled = S.histogram_layout(df, x, stats, **how)
    axis = Q.Axis(bin_of, None, lambda i, _t: i.cast("int"))
    return Q.Cells([axis], bin_of.isNotNull(), lambda t: filled(t.select(F.col("a0").alias("bin"), "count")))


def _box(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """A14 of one value per group; two group columns go as one struct."""
    if len(groups) < 2:
        return S.box_stats(df, value, by=groups[0] if groups else None)
    pair = df.select(F.struct(*[_c(c).alias(f"g{n}") for n, c in enumerate(groups)]).alias("__pair"), _c(value).alias(value))
    pair = pair.filter(F.col("__pair.g0").isNotNull() & F.col("__pair.g1").isNotNull())
    out = S.box_stats(pair, value, by="__pair")
    return out.select(*[F.col(f"__pair.g{n}").alias(c) for n, c in enumerate(groups)], *[c for c in out.columns if c != "__pair"])


def _parts_of(df: DataFrame, item: dict, tmap: dict[str, str], ranges: dict, rules: bool) -> dict | None:
    """The named datasets of a plan item: ``Cells``, ('trend', x, y), ('box', value, groups) or a frame.
    None if the item cannot be drawn (a needed column is missing or is not a number)."""
    ct, x, y, color = item["chart_type"], item.get("x") or None, item.get("y") or None, item.get("color") or None
    numeric = set(numeric_columns(df))
    if ct == "heatmap":
        return {ct: heatmap(df)}
    if x is None or (y is not None and ct in ("line", "bar", "box") and y not in numeric):
        return None
    if ct == "histogram":
        return {"histogram": _bars(df, x, ranges[x]), "density": _bars(df, x, ranges[x], bins=S.DENSITY_BINS, density=True)}
    if ct == "line":
        if y is None:
            return {"by_period" if rules else ct: _periods(x) if tmap.get(x) == "datetime" else _counted(df, x)}
        return {ct: _timed(df, x, y, ranges[x], color) if tmap.get(x) == "datetime" else _totals(df, x, y, color)}
    if ct == "bar":
        return {ct: _totals(df, x, y, color)} if y else {"value_counts" if rules else ct: _counted(df, x)}
    if ct == "scatter" and y:
        return {ct: _grid(df, x, y, color, tmap, ranges)} | ({"trend_line": ("trend", x, y)} if rules else {})
    if ct == "box" and (y or x) in numeric:
        groups = [c for c in ((x if y else None), color) if c]
        nested = None in [Q.value_axis(df, g) for g in groups]  # arrays, maps, structs: a quantile call of their own
        return {ct: _box(df, y or x, groups) if nested else ("box", y or x, groups)}
    return None


def plan_data(df: DataFrame, items: Sequence[dict], tmap: dict[str, str] | None = None, rules: bool = False) -> list[dict[str, DataFrame] | None]:
    """The datasets of many plan items, each an aggregate of the whole table: one dict of named frames per
    item, None for an item that cannot be drawn.

    The number of scans does not depend on the number of charts: one aggregate for the ranges of all axes,
    one scan for all cells, one for all trend lines, the passes of one grouped quantile call for all boxes
    (and one scan per heat map).  ``rules`` names the datasets as ``univariate`` and ``bivariate_data`` do;
    otherwise an item has one dataset, named by its chart type."""
    if not items:
        return []
    tmap = tmap or _types_map(df)
    used = {c for it in items for c in (it.get("x"), it.get("y"), it.get("color")) if c}
    df = dated(df, tmap, [c for c in df.columns if c in used])
    axes = {c for it in items if it["chart_type"] in ("histogram", "scatter") for c in (it.get("x"), it.get("y"), it.get("color")) if c and tmap.get(c) == "numerical"}
    times = {it["x"] for it in items if it["chart_type"] == "line" and it.get("y") and tmap.get(it.get("x")) == "datetime"}
    ranges = Q.axis_ranges(df, [c for c in df.columns if c in axes], [c for c in df.columns if c in times])
    parts = [_parts_of(df, it, tmap, ranges, rules) for it in items]
    kinds: dict[str, list] = {"cells": [], "trend": [], "box": []}
    where = []
    for item in parts:
        for name, part in (item or {}).items():
            kind = "cells" if isinstance(part, Q.Cells) else part[0] if isinstance(part, tuple) else None
            where.append(None if kind is None else (kind, len(kinds[kind])))
            if kind:
                kinds[kind].append(part if kind == "cells" else part[1:])
    made = {"cells": Q.chart_cells(df, kinds["cells"]), "trend": Q.trend_lines(df, kinds["trend"]), "box": Q.boxes(df, kinds["box"])}
    at = iter(where)
    return [item and {name: made[w[0]][w[1]] if (w := next(at)) else part for name, part in item.items()} for item in parts]


def chart_data(df: DataFrame, item: dict, tmap: dict[str, str] | None = None) -> DataFrame | None:
    """V10 (execution) for one validated plan item; several items go through ``plan_data`` at once."""
    (data,) = plan_data(df, [item], tmap)
    return data and data[item["chart_type"]]


def execute_plan(df: DataFrame, plan: DataFrame, tmap: dict[str, str] | None = None) -> list[tuple[dict, DataFrame]]:
    """Validated plan items with their datasets (plan size is small).  An item that cannot be
    drawn is left out; the others are not affected."""
    items = [r.asDict() for r in validate_plan(df, plan).orderBy("ord").collect()]
    tmap = tmap or (_types_map(df) if items else {})
    return [(it, data[it["chart_type"]]) for it, data in zip(items, plan_data(df, items, tmap)) if data is not None and data[it["chart_type"]] is not None]


def chart_records(plan: DataFrame) -> DataFrame:
    """(type, column, title, description) records for each planned chart."""
    typ = F.when(F.col("chart_type") == "heatmap", "correlation_heatmap").otherwise(F.col("chart_type"))
    return plan.select(
        "ord", typ.alias("type"), F.coalesce(F.col("x"), F.lit("")).alias("column"), "title",
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )


def visualize(df: DataFrame, plan: DataFrame | None = None) -> dict:
    """The chart step end to end: types, plan, per-chart datasets (each a dict of
    named small DataFrames), statistical summary.

    ``plan`` is an external plan (``parse_plan``); if none of its items can be drawn, or
    none is given, the rule plan is used.  ``route`` says which.
    """
    types_df = P.column_types(df)
    tmap = _types_map(df, types_df)
    df = dated(df, tmap)
    summary = P.statistical_summary(df)
    if plan is not None:
        drawn = execute_plan(df, plan, tmap)
        if drawn:
            charts = [(it, {it["chart_type"]: data}) for it, data in drawn]
            return {"column_types": types_df, "plan": validate_plan(df, plan), "charts": charts, "statistical_summary": summary, "route": "external"}
    plan = rule_plan(df, types_df)
    items = [r.asDict() for r in plan.orderBy("ord").collect()]
    charts = list(zip(items, plan_data(df, items, tmap, rules=True)))
    return {"column_types": types_df, "plan": plan, "charts": charts, "statistical_summary": summary, "route": "rules"}
