"""Rule-based insights I1-I11 over the statistics results.

Every text is built with ``format_string`` / ``format_number`` on the small
result tables (one row per column or per pair), so the input table is only
touched by the statistics jobs themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import general_number, is_numeric_type, non_numeric_columns, numeric_columns
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.operators.clean import _c, date_text_plan

# Thresholds, name hints and sentence templates.
SKEW_LIMIT = 1.0
MISSING_PCT_LIMIT = 5.0
CV_LIMIT = 1.0
VALUE_NAMES = ["sales", "revenue", "amount", "price", "quantity", "quantityordered"]
DATE_NAME_HINTS = ["date", "time"]
CONTEXT_COLUMNS = 3  # business context: first 3 non-numeric columns ...
CONTEXT_TOP = 3  # ... their top 3 values ...
CONTEXT_WIDTH = 20  # ... cut to 20 characters
PATTERN_TRENDS = 3
BLOCK_PAIRS = 8
BLOCK_OUTLIERS = 6
BLOCK_TRENDS = 5
RIGHT_SKEW = "'%s' is heavily right-skewed (skew=%.2f), indicating a long tail of high values."
LEFT_SKEW = "'%s' is heavily left-skewed (skew=%.2f), indicating a concentration of high values."
MISSING_TREND = "Dataset has %.1f%% missing values — imputation strategy significantly impacts results."
SHAPE_SENTENCE = "The dataset contains %s rows and %d columns."
MISSING_SENTENCE = "%s missing values were detected and handled during cleaning."
CORR_SENTENCE = "Strongest correlation: '%s' and '%s' (%+.2f, %s)."
OUTLIER_SENTENCE = "'%s' has the most outliers (%s%% of values fall outside [%.2f, %.2f])."
CV_SENTENCE = "'%s' shows high variability (CV = %.2f)."
REC_OUTLIERS = "Investigate outlier rows manually before using the data for modelling."
REC_FEATURES = "Consider using '%s' and '%s' as features in a predictive model."
REC_SCALING = "Apply feature scaling (StandardScaler / MinMaxScaler) before ML training."
EXTRA_RECS = [
    "Investigate outlier rows manually before using the data for modelling.",
    "Apply feature scaling before ML training.",
    "Consider dimensionality reduction if the feature count is large.",
]
SUMMARY_SENTENCE = (
    "This dataset (%s rows × %d cols) has been cleaned and analysed. "
    "%d significant correlations and %d columns with outliers were identified. "
    "See detailed insights and recommendations above."
)

LINES = "ord int, text string"


def _thousands(c: Column) -> Column:
    """Integer with thousands separators, like Python's ``{:,}``."""
    return F.format_number(c.cast("long"), 0)


def _lines(df: DataFrame, text: Column, order: Column) -> DataFrame:
    return df.select(order.cast("int").alias("ord"), text.alias("text"))


# ---------------------------------------------------------------------------
# I1 trends
# ---------------------------------------------------------------------------


def trends(df: DataFrame, table: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Skew > 1 / < -1 sentences per numeric column (>= 3 values), then the
    missing-cells sentence when more than 5 % of cells are missing.

    ``table`` (rows, columns, missing) and ``summary`` (``numeric_summary``) may be passed
    in when already known; otherwise one light aggregate counts rows and missing cells (no
    duplicate detection is needed here)."""
    parts = []
    if numeric_columns(df):
        s = (summary if summary is not None else P.numeric_summary(df, with_quartiles=False)).filter(F.col("count") >= 3)
        sk = F.col("skewness")
        text = (
            F.when(sk > SKEW_LIMIT, F.format_string(RIGHT_SKEW, F.col("column"), sk))
            .when(sk < -SKEW_LIMIT, F.format_string(LEFT_SKEW, F.col("column"), sk))
        )
        parts.append(_lines(s, text, F.col("ord")).filter(F.col("text").isNotNull()))
    if table is None:
        table = shape_and_missing(df)
    cells = table.select(
        (F.col("missing") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)) * 100).alias("pct")
    )
    parts.append(
        _lines(cells.filter(F.col("pct") > MISSING_PCT_LIMIT), F.format_string(MISSING_TREND, F.col("pct")), F.lit(10_000))
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# I3 column choice, I2 business context
# ---------------------------------------------------------------------------


def choose_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """Date column = first timestamp/date column, or first TEXT column whose
    name contains date/time and fully parses; value column = first named
    sales / revenue / amount / price / quantity / quantityordered (case-
    insensitive), else the first numeric column."""
    date_col = None
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            date_col = f.name
            break
        if isinstance(f.dataType, T.StringType) and any(h in f.name.lower() for h in DATE_NAME_HINTS):
            if date_text_plan(df, [f.name]):
                date_col = f.name
                break
    value_col = next((c for c in df.columns if c.lower() in VALUE_NAMES), None)
    if value_col is None:
        nums = numeric_columns(df)
        value_col = nums[0] if nums else None
    return date_col, value_col


def business_context(df: DataFrame, columns: int = CONTEXT_COLUMNS, top: int = CONTEXT_TOP, width: int = CONTEXT_WIDTH) -> DataFrame:
    """The ``top`` values of the first ``columns`` non-numeric columns (cut to ``width``) and
    monthly totals of the value column over the date column, as text lines."""
    parts = []
    cats = [c for c in non_numeric_columns(df) if c in df.columns][:columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in cats if not isinstance(types[c], (T.ArrayType, T.MapType, T.StructType))]
    spark = df.sparkSession
    if cats:
        best = P.top_values(df, cats, k=top, width=width)
        order = {c: i for i, c in enumerate(cats)}
        ordmap = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
        item = F.format_string("'%s': %d records", F.col("value"), F.col("count"))
        per_col = best.groupBy("column").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("t")))), lambda s: s["t"]), ", ").alias("items")
        )
        parts.append(spark.createDataFrame([(0, "Categorical Columns Top Values:")], LINES))
        parts.append(_lines(per_col, F.format_string("  • %s: %s", F.col("column"), F.col("items")), ordmap[F.col("column")] + 1))
    date_col, value_col = choose_columns(df)
    if date_col and value_col:
        d = df
        if isinstance(types[date_col], T.StringType):
            fmt = date_text_plan(df, [date_col])[date_col]
            d = df.withColumn(date_col, F.try_to_timestamp(_c(date_col), F.lit(fmt)))
        m = S.monthly_totals(d, date_col, value_col)
        item = F.format_string("%s: %s", F.col("month_name"), F.format_number(F.col("total"), 2))
        line = m.agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("month", item.alias("t")))), lambda s: s["t"]), ", ").alias("t")
        )
        parts.append(spark.createDataFrame([(100, f"Seasonal Trends ({value_col} summed by Month):")], LINES))
        parts.append(_lines(line, F.concat(F.lit("  "), F.col("t")), F.lit(101)))
    if not parts:
        return spark.createDataFrame([], LINES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# I4-I9, I11
# ---------------------------------------------------------------------------


def shape_and_missing(df: DataFrame) -> DataFrame:
    """(rows, columns, missing) from one aggregate."""
    from tablewise.operators.profile import _null_expr

    types = {f.name: f.dataType for f in df.schema.fields}
    total = sum((F.count_if(_null_expr(n, t)) for n, t in types.items()), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("rows"), F.lit(len(types)).cast("long").alias("columns"), total.cast("long").alias("missing"))


def _first_or_empty(df: DataFrame) -> DataFrame:
    return df.limit(1)


def rule_insights(df: DataFrame, correlations: DataFrame, outliers: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """I4: shape, missing, strongest correlation, worst outlier sentences."""
    tbl = table if table is not None else shape_and_missing(df)
    shape_l = _lines(tbl, F.format_string(SHAPE_SENTENCE, _thousands(F.col("rows")), F.col("columns")), F.lit(0))
    miss_l = _lines(tbl.filter(F.col("missing") > 0), F.format_string(MISSING_SENTENCE, _thousands(F.col("missing"))), F.lit(1))
    top = _first_or_empty(correlations.orderBy(F.desc(F.abs("correlation")), "i", "j"))
    corr_l = _lines(top, F.format_string(CORR_SENTENCE, "col1", "col2", F.col("correlation"), "strength"), F.lit(2))
    worst = _first_or_empty(outliers.orderBy(F.desc("outlier_pct"), "ord"))
    out_l = _lines(
        worst,
        F.format_string(OUTLIER_SENTENCE, "column", F.col("outlier_pct").cast("string"), F.col("lower_bound"), F.col("upper_bound")),
        F.lit(3),
    )
    return shape_l.unionByName(miss_l).unionByName(corr_l).unionByName(out_l)


def patterns(df: DataFrame, trend_lines: DataFrame, summary: DataFrame | None = None, cv_columns: int | None = None, first: int = PATTERN_TRENDS) -> DataFrame:
    """CV > 1 sentences then the ``first`` trends.  Every numeric column counts;
    ``cv_columns=1`` looks at the first numeric column only."""
    parts = []
    if numeric_columns(df):
        if summary is not None:
            v = summary.select("column", "ord", F.try_divide(F.col("std"), F.abs("mean")).alias("cv")).filter(F.col("cv") > CV_LIMIT)
        else:
            v = S.variability(df).filter(F.col("high_variability"))
        if cv_columns is not None:
            v = v.filter(F.col("ord") < cv_columns)
        parts.append(_lines(v, F.format_string(CV_SENTENCE, "column", F.col("cv")), F.col("ord")))
    first3 = trend_lines.orderBy("ord").limit(first).collect()  # a few short lines
    spark = df.sparkSession
    parts.append(spark.createDataFrame([(100_001 + k, r["text"]) for k, r in enumerate(first3)], LINES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommendations(correlations: DataFrame) -> DataFrame:
    """Fixed advice, plus the top pair as model features when there is one."""
    spark = correlations.sparkSession
    top = _first_or_empty(correlations.orderBy(F.desc(F.abs("correlation")), "i", "j"))
    fixed = spark.createDataFrame([(0, REC_OUTLIERS), (2, REC_SCALING)], LINES)
    pair = _lines(top, F.format_string(REC_FEATURES, "col1", "col2"), F.lit(1))
    return fixed.unionByName(pair)


def top_up_recommendations(recs: DataFrame, minimum: int = 3, maximum: int = 5) -> DataFrame:
    """When fewer than ``minimum`` recommendations exist, append the fixed
    extras in order until there are ``maximum``."""
    spark = recs.sparkSession
    n = recs.count()  # a handful of rows
    if n >= minimum:
        return recs
    extras = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA_RECS[: max(0, maximum - n)])], LINES)
    return recs.select("ord", "text").unionByName(extras)


def executive_summary(table: DataFrame, correlations: DataFrame, outliers: DataFrame) -> DataFrame:
    """The one-sentence summary (from one-row results)."""
    t = table.first()
    nc = correlations.count()  # one row per strong pair
    no = outliers.count()  # one row per numeric column
    text = SUMMARY_SENTENCE % (f"{t['rows']:,}", t["columns"], nc, no)
    return table.sparkSession.createDataFrame([(0, text)], LINES)


def metrics(before: DataFrame, after: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    """I8: total_rows, total_columns, missing_values_handled, duplicates_removed,
    outliers_detected (before/after kept apart, see P4)."""
    b = P.table_stats_row(before)
    a = P.table_stats_row(after)
    o = S.total_outliers(outliers if outliers is not None else S.outlier_report(after)).first()["outliers_detected"]
    row = (a["rows"], a["columns"], b["missing"] - a["missing"], max(b["rows"] - a["rows"], 0), o)
    return after.sparkSession.createDataFrame(
        [row], "total_rows long, total_columns long, missing_values_handled long, duplicates_removed long, outliers_detected long"
    )


def context_block(describe_df: DataFrame, correlations: DataFrame, outliers: DataFrame, trend_lines: DataFrame, plan: DataFrame | None = None, pairs: int = BLOCK_PAIRS, outlier_columns: int = BLOCK_OUTLIERS, first_trends: int = BLOCK_TRENDS) -> DataFrame:
    """The text block handed to an external model (top ``pairs``, worst
    ``outlier_columns``, ``first_trends``, stats lines, chart lines) as one row (text).

    Every block is a top-k (``orderBy().limit(k)``) of a table with one row
    per column or pair, so only a few dozen short lines reach the driver.
    """
    spark = describe_df.sparkSession

    def lines(df: DataFrame, text: Column, order: list, k: int | None) -> list[str]:
        q = df.orderBy(*order)
        if k is not None:
            q = q.limit(k)
        return [r[0] for r in q.select(text).collect()]

    out = ["Numerical statistics:"]
    g = lambda c: general_number(F.col(c))  # noqa: E731 - Python-style %.4g
    out += lines(describe_df, F.format_string("  %s: mean=%s, std=%s, min=%s, max=%s", "column", g("mean"), g("std"), g("min"), g("max")), ["ord"], None)
    out.append("Correlations:")
    out += lines(correlations, F.format_string("  %s ↔ %s: r=%+.2f (%s)", "col1", "col2", "correlation", "strength"),
                 [F.desc(F.abs("correlation")), "i", "j"], pairs)
    out.append("Outliers:")
    out += lines(outliers, F.format_string("  %s: %d outliers (%s%%)", "column", "outlier_count", F.col("outlier_pct").cast("string")),
                 [F.desc("outlier_pct"), "ord"], outlier_columns)
    out.append("Trends:")
    out += lines(trend_lines, F.concat(F.lit("  • "), F.col("text")), ["ord"], first_trends)
    out.append("Charts:")
    if plan is not None:
        out += lines(plan, F.format_string("  • Chart %d: '%s' - %s", F.col("ord") + 1, "title", F.coalesce("description", F.lit(""))), ["ord"], None)
    return spark.createDataFrame([("\n".join(out),)], "text string")


def _local(df: DataFrame) -> DataFrame:
    """A small result (one row per column / pair / sentence) held as a local frame."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


INSIGHT_REPLY = "insights array<string>, patterns array<string>, recommendations array<string>, executive_summary string"


def reply_sections(replies: DataFrame, col: str) -> DataFrame:
    """An object reply as (section, ord, text) rows: insights, patterns, recommendations, executive_summary.
    A broken reply gives no row."""
    from tablewise.operators.enrich import parse_reply

    o = parse_reply(replies, col, INSIGHT_REPLY, kind="object")
    def rows(section: str) -> Column:
        items = F.coalesce(F.col(section), F.array().cast("array<string>"))
        return F.transform(items, lambda t, i: F.struct(F.lit(section).alias("section"), i.cast("int").alias("ord"), t.alias("text")))

    lists = [rows(section) for section in ("insights", "patterns", "recommendations")]
    one = F.array(F.struct(F.lit("executive_summary").alias("section"), F.lit(0).alias("ord"), F.col("executive_summary").alias("text")))
    return o.select(F.explode(F.concat(*lists, one)).alias("r")).select("r.*").filter(F.col("text").isNotNull())


def analyze(df: DataFrame, approx: bool = False, persist: bool = False, reply: DataFrame | None = None, reply_col: str = "reply") -> dict[str, DataFrame]:
    """The whole insight step.

    Every result is a small table (per column, per pair or per sentence),
    materialised before returning, so the returned frames never re-read the
    input.  The moments and quantiles are computed once and handed to trends, patterns,
    outliers and describe.  ``persist=True`` caches the input for the passes (for inputs
    dear to recompute).  ``correlations`` shows at most ``MAX_PAIRS`` pairs, counts use all.

    ``reply`` (one row, a model's answer in ``reply_col``) takes the place of the rule
    sentences it holds; a broken reply, or a section it lacks, falls back to the rules, and
    recommendations are topped up (I9).  ``route`` says which was used.
    """
    from pyspark import StorageLevel

    cached = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
    try:
        table = _local(P.table_stats(cached))
        has_num = any(is_numeric_type(f.dataType) for f in cached.schema.fields)
        every = _local(S.strong_correlations(cached)) if has_num else _empty_corr(cached)
        corr = _local(every.orderBy(F.desc(F.abs("correlation")), "i", "j").limit(S.MAX_PAIRS))
        summary = _local(P.numeric_summary(cached, approx=approx)) if has_num else None
        outl = _local(S.outlier_report(cached, approx=approx, summary=summary))
        trend_l = _local(trends(cached, table, summary))
        out = {
            "table": table,
            "correlations": corr,
            "outliers": outl,
            "trends": trend_l,
            "insights": _local(rule_insights(cached, corr, outl, table)),
            "patterns": _local(patterns(cached, trend_l, summary)),
            "recommendations": _local(recommendations(corr)),
            "executive_summary": executive_summary(table, every, outl),
            "business_context": _local(business_context(cached)),
        }
        if has_num:
            out["numerical"] = _local(P._described(summary))
        route = "rules"
        if reply is not None:
            said = _local(reply_sections(reply, reply_col))
            for section in ("insights", "patterns", "recommendations", "executive_summary"):
                part = said.filter(F.col("section") == section).select("ord", "text")
                if not part.isEmpty():
                    out[section], route = part, "reply"
            out["recommendations"] = _local(top_up_recommendations(out["recommendations"]))
        out["route"] = cached.sparkSession.createDataFrame([(route,)], "route string")
        return out
    finally:
        if persist:
            cached.unpersist()


def _empty_corr(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "col1 string, col2 string, correlation double, strength string, i int, j int")


def report_lines(result: dict[str, DataFrame]) -> DataFrame:
    """K4 input: (section_ord, section, ord, text) for summary, numbered
    insights, bullet patterns and numbered recommendations (each section is
    a handful of sentences)."""
    spark = result["insights"].sparkSession
    rows = []
    heads = ["EXECUTIVE SUMMARY", "KEY INSIGHTS", "PATTERNS", "RECOMMENDATIONS"]
    names = ["summary", "insights", "patterns", "recommendations"]
    for sec, (head, name) in enumerate(zip(heads, names)):
        rows.append((sec, name, -1, head))
        key = "executive_summary" if name == "summary" else name
        for k, r in enumerate(result[key].orderBy("ord").select("ord", "text").collect()):
            if name in ("insights", "recommendations"):
                text = f"{k + 1}. {r['text']}"
            elif name == "patterns":
                text = f"- {r['text']}"
            else:
                text = r["text"]
            rows.append((sec, name, r["ord"], text))
    return spark.createDataFrame(rows, "section_ord int, section string, ord int, text string")
