"""Registered queries: statistics (A4-A18) and sorts / top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.plans import fixtures as fx
from tablewise.plans.registry import _r, _with, query

_CF = fx.CORR_FRAME_SQL
_CF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "qty_disc", "neg_qty_tax"]
_EV_NUM = ["event_id", "user_id", "value"]


def _corr_sql(a: str, b: str) -> str:
    # pairwise-complete r; undefined (constant) -> NULL instead of NaN
    return (
        f"CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 OR isnan(corr({a}, {b})) THEN NULL "
        f"ELSE corr({a}, {b}) END"
    )


def _pairs(cols):
    return [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def pairs_sql(src: str, cols: list[str]) -> str:
    """All column pairs with their pairwise-complete r (NULL if undefined)."""
    return " UNION ALL ".join(
        f"SELECT '{cols[i]}' AS col1, '{cols[j]}' AS col2, {i} AS i, {j} AS j, {_corr_sql(cols[i], cols[j])} AS r FROM {src}"
        for i, j in _pairs(cols)
    )


def strong_pairs_sql(src: str, cols: list[str]) -> str:
    """A6 in SQL: rounded r, |r| >= 0.3, labelled, by |r| desc, at most 15."""
    return f"""SELECT col1, col2, correlation, i, j,
       CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.5 THEN 'moderate' ELSE 'weak' END
       || ' ' || CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS strength
    FROM (SELECT col1, col2, i, j, ROUND(r, 4) AS correlation FROM ({pairs_sql(src, cols)}) WHERE r IS NOT NULL)
    WHERE abs(correlation) >= 0.3 ORDER BY abs(correlation) DESC, i, j LIMIT 15"""


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{_CF_COLS[i]}' AS col1, '{_CF_COLS[j]}' AS col2, {i} AS i, {j} AS j, {_corr_sql(_CF_COLS[i], _CF_COLS[j])} AS r FROM cf"
    for i, j in _pairs(_CF_COLS)
)


@query(
    "a04_quartiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, {_r(f'quantile_cont({c}, 0.25)')} AS q1, {_r(f'quantile_cont({c}, 0.75)')} AS q3 FROM events"
        for c in _EV_NUM
    ),
)
def q_a04(spark, sf):
    q = S.quartiles(fx.table(spark, sf, "events"))
    return q.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"))


@query("a05_correlation_pairs", _with(_CF) + f"SELECT col1, col2, ROUND(r, 4) AS r FROM ({_PAIRS_SQL})")
def q_a05(spark, sf):
    p = S.correlation_pairs(fx.corr_frame(spark, sf))
    return p.select("col1", "col2", F.round("r", 4).alias("r"))


_STRONG_SQL = (
    _with(_CF, f"p AS (SELECT col1, col2, i, j, ROUND(r, 4) AS correlation FROM ({_PAIRS_SQL}) WHERE r IS NOT NULL)")
    + """SELECT col1, col2, correlation,
       CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.5 THEN 'moderate' ELSE 'weak' END
       || ' ' || CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS strength
    FROM p WHERE abs(correlation) >= 0.3 ORDER BY abs(correlation) DESC, i, j LIMIT 15"""
)


@query("a06_strong_correlations", _STRONG_SQL)
def q_a06(spark, sf):
    return S.strong_correlations(fx.corr_frame(spark, sf)).select("col1", "col2", "correlation", "strength")


@query(
    "t05_ranked_pairs",
    "SELECT row_number() OVER (ORDER BY abs(correlation) DESC, col1, col2) AS rank, col1, col2 FROM ("
    + _STRONG_SQL
    + ")",
)
def q_t05(spark, sf):
    s = S.strong_correlations(fx.corr_frame(spark, sf))
    by_strength = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("correlation")), "col1", "col2")  # one row per pair of columns
    return s.select(F.row_number().over(by_strength).cast("long").alias("rank"), "col1", "col2")


_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


@query(
    "a07_monthly_totals",
    f"SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {_MONTHS}[month(o_orderdate)] AS month_name, "
    "ROUND(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
)
def q_a07(spark, sf):
    m = S.monthly_totals(fx.table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return m.select("month", "month_name", F.round("total", 2).alias("total"))


@query(
    "a08_counts_by_period",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1",
)
def q_a08(spark, sf):
    return S.counts_by_period(fx.table(spark, sf, "orders"), "o_orderdate")


def _outlier_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS column, q1, q3, n,
                  (SELECT count(*) FROM {src} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS cnt
               FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM {src})"""
        )
    return (
        _with(f"b AS ({' UNION ALL '.join(parts)})")
        + """SELECT column, CAST(cnt AS BIGINT) AS outlier_count, ROUND(cnt / n * 100, 2) AS outlier_pct,
                    ROUND(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, ROUND(q3 + 1.5 * (q3 - q1), 4) AS upper_bound
             FROM b WHERE n >= 4 AND q3 - q1 <> 0 AND cnt > 0"""
    )


@query("a09_outlier_report", _outlier_sql("events", _EV_NUM))
def q_a09(spark, sf):
    return S.outlier_report(fx.table(spark, sf, "events")).drop("ord")


@query("a09_outlier_report_documents", _outlier_sql("documents", ["doc_id", "n_chars"]))
def q_a09b(spark, sf):
    return S.outlier_report(fx.table(spark, sf, "documents")).drop("ord")


@query(
    "a10_total_outliers",
    "SELECT CAST(sum(outlier_count) AS BIGINT) AS outliers_detected FROM (" + _outlier_sql("events", _EV_NUM) + ")",
)
def q_a10(spark, sf):
    return S.total_outliers(S.outlier_report(fx.table(spark, sf, "events")))


@query(
    "r05_outlier_rows",
    _with("b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)")
    + "SELECT event_id, value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
)
def q_r05(spark, sf):
    return S.outlier_rows(fx.table(spark, sf, "events"), "value").select("event_id", "value")


@query(
    "a11_contingency",
    "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1, 2",
)
def q_a11(spark, sf):
    return S.contingency(fx.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "a11_contingency_wide",
    "SELECT o_orderstatus, "
    + ", ".join(
        f"CAST(count_if(o_orderpriority = '{p}') AS BIGINT) AS \"{p}\""
        for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    )
    + " FROM orders GROUP BY 1",
)
def q_a11w(spark, sf):
    return S.contingency_wide(fx.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def _hist_sql(src: str, col: str, nb: str | int, density: bool) -> str:
    nbs = str(nb)
    return (
        _with(
            f"""st AS (SELECT CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo,
                         CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi,
                         count({col}) AS n FROM {src})""",
            f"nb AS (SELECT {nbs} AS nb FROM st)",
            f"""c AS (SELECT LEAST(CAST(FLOOR(({col} - lo) / (hi - lo) * nb) AS INTEGER), nb - 1) AS bin, count(*) AS cnt
                   FROM {src}, st, nb WHERE {col} IS NOT NULL GROUP BY 1)""",
            "b AS (SELECT CAST(range AS INTEGER) AS bin FROM range((SELECT nb FROM nb)))",
        )
        + f"""SELECT b.bin, ROUND(lo + b.bin * ((hi - lo) / nb), 6) AS lo,
                     ROUND(CASE WHEN b.bin = nb - 1 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / nb) END, 6) AS hi,
                     CAST(coalesce(cnt, 0) AS BIGINT) AS count"""
        + (", ROUND(coalesce(cnt, 0) / (n * ((hi - lo) / nb)), 6) AS density" if density else "")
        + " FROM b LEFT JOIN c ON b.bin = c.bin, st, nb"
    )


def _hist_out(h, density: bool):
    cols = ["bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count"]
    if density:
        cols.append(F.round("density", 6).alias("density"))
    return h.select(*cols)


@query(
    "a12_histogram",
    _hist_sql("events", "value", "CAST(LEAST(50, GREATEST(10, FLOOR(sqrt(n)))) AS INTEGER)", False),
)
def q_a12(spark, sf):
    return _hist_out(S.histogram(fx.table(spark, sf, "events"), "value"), False)


@query("a13_density_histogram", _hist_sql("events", "value", 60, True))
def q_a13(spark, sf):
    return _hist_out(S.histogram(fx.table(spark, sf, "events"), "value", bins=60, density=True), True)


@query(
    "a14_box_stats",
    _with(
        """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                        quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"""
    )
    + """SELECT e.event_type, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
              ROUND(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END), 4) AS lower_whisker,
              ROUND(max(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END), 4) AS upper_whisker,
              ROUND(avg(value), 4) AS mean, ROUND(stddev_samp(value), 4) AS sd, CAST(count(value) AS BIGINT) AS n
         FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type, q1, median, q3""",
)
def q_a14(spark, sf):
    b = S.box_stats(fx.table(spark, sf, "events"), "value", by="event_type")
    return b.select(
        "event_type", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker", "mean", "sd")], "n"
    )


@query(
    "a15_trend_line",
    _with(_CF)
    + "SELECT ROUND(regr_slope(net_price, l_extendedprice), 6) AS slope, ROUND(regr_intercept(net_price, l_extendedprice), 4) AS intercept, "
    "ROUND(regr_r2(net_price, l_extendedprice), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM cf",
)
def q_a15(spark, sf):
    t = S.trend_line(fx.corr_frame(spark, sf), "l_extendedprice", "net_price")
    return t.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(
    "a16_variability",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, ROUND(stddev_samp({c}) / abs(avg({c})), 4) AS cv, stddev_samp({c}) / abs(avg({c})) > 1 AS high_variability FROM events"
        for c in _EV_NUM
    ),
)
def q_a16(spark, sf):
    v = S.variability(fx.table(spark, sf, "events"))
    return v.select("column", F.round("cv", 4).alias("cv"), "high_variability")


@query(
    "a17_category_shares",
    "SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count, ROUND(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM orders GROUP BY 1",
)
def q_a17(spark, sf):
    s = S.category_shares(fx.table(spark, sf, "orders"), "o_orderpriority")
    return s.select("value", "count", F.round("share", 6).alias("share"))


@query(
    "a18_bar_totals",
    "SELECT o_orderpriority, o_orderstatus, ROUND(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
)
def q_a18(spark, sf):
    b = S.bar_totals(fx.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", color="o_orderstatus")
    return b.select("o_orderpriority", "o_orderstatus", F.round("total", 2).alias("total"))


@query("t01_sorted_line", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def q_t01(spark, sf):
    return S.sorted_by(fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


def _topk_sql(src, cols, k, width=None):
    from tablewise.plans.catalog_profile import _topk_sql as t

    return t(src, cols, k, width)


@query("t02_top20_wide_text", _topk_sql("part", ["p_name"], 20))
def q_t02(spark, sf):
    return P.top_values(fx.table(spark, sf, "part"), ["p_name"], k=20)


@query("t03_top10", _topk_sql("part", ["p_brand"], 10))
def q_t03(spark, sf):
    return P.top_values(fx.table(spark, sf, "part"), ["p_brand"], k=10)


@query("t04_top3_first3_text", _topk_sql("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"], 3, 20))
def q_t04(spark, sf):
    o = fx.table(spark, sf, "orders")
    from tablewise.functions.exprs import non_numeric_columns

    first3 = non_numeric_columns(o)[:3]
    return P.top_values(o, first3, k=3, width=20)


@query(
    "a12_histogram_with_nulls",
    _with(fx.DIRTY_EVENTS_SQL)
    + _hist_sql("dirty_ev", "value", "CAST(LEAST(50, GREATEST(10, FLOOR(sqrt(n)))) AS INTEGER)", False).replace("WITH ", ", ", 1),
)
def q_a12n(spark, sf):
    return _hist_out(S.histogram(fx.dirty_events(spark, sf), "value"), False)
