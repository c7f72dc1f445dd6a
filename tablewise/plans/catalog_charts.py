"""Registered queries: chart-ready datasets (V1-V12) and plan filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.plans import charts as V
from tablewise.plans import fixtures as fx
from tablewise.plans.catalog_profile import _LI_COLS, _LI_NUM
from tablewise.plans.registry import _with, query

_CF = fx.CORR_FRAME_SQL
_CF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "qty_disc", "neg_qty_tax"]


def _types_ord_sql(src: str, cols: list[str], dt: set[str], num: set[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT {i} AS ord, '{c}' AS column, count(DISTINCT {c}) AS u, count(*) AS n, "
            f"{'TRUE' if c in dt else 'FALSE'} AS is_dt, {'TRUE' if c in num else 'FALSE'} AS is_num FROM {src}"
        )
    return (
        "SELECT ord, column, CASE WHEN is_dt THEN 'datetime' WHEN u = 2 THEN 'boolean' WHEN is_num THEN 'numerical' "
        "WHEN u / greatest(n, 1) > 0.5 OR u > 50 THEN 'high_cardinality' ELSE 'categorical' END AS type FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


def plan_sql(src: str, cols: list[str], dt: set[str], num: set[str], n_numeric: int) -> str:
    """V9 in SQL: the rule plan from data-driven semantic types (a WITH prefix
    defining ``plan``)."""
    return _with(
    f"t AS ({_types_ord_sql(src, cols, dt, num)})",
    """u AS (SELECT 1 AS sec, ord AS k, 'univariate' AS kind,
                 CASE type WHEN 'numerical' THEN 'histogram' WHEN 'datetime' THEN 'line' ELSE 'bar' END AS chart_type,
                 column AS x, CAST(NULL AS VARCHAR) AS y,
                 CASE type WHEN 'numerical' THEN 'Distribution of ''' || column || ''''
                           WHEN 'datetime' THEN 'Time Series – ''' || column || ''''
                           ELSE 'Value Counts – ''' || column || '''' END AS title
          FROM t WHERE type <> 'high_cardinality')""",
    "num AS (SELECT column, row_number() OVER (ORDER BY ord) AS r FROM t WHERE type = 'numerical')",
    "cat AS (SELECT column, row_number() OVER (ORDER BY ord) AS r FROM t WHERE type = 'categorical')",
    "dtc AS (SELECT column, row_number() OVER (ORDER BY ord) AS r FROM t WHERE type = 'datetime')",
    """sc AS (SELECT 2 AS sec, a.r * 100 + b.r AS k, 'bivariate' AS kind, 'scatter' AS chart_type, a.column AS x, b.column AS y,
                  '''' || a.column || ''' vs ''' || b.column || '''' AS title
           FROM num a JOIN num b ON a.r < b.r WHERE a.r <= 6 AND b.r <= 6)""",
    """bx AS (SELECT 3 AS sec, c.r * 100 + n.r AS k, 'bivariate' AS kind, 'box' AS chart_type, c.column AS x, n.column AS y,
                  '''' || n.column || ''' by ''' || c.column || '''' AS title
           FROM cat c, num n WHERE c.r <= 3 AND n.r <= 3)""",
    """ln AS (SELECT 4 AS sec, d.r * 100 + n.r AS k, 'bivariate' AS kind, 'line' AS chart_type, d.column AS x, n.column AS y,
                  '''' || n.column || ''' over time' AS title
           FROM dtc d, num n WHERE d.r <= 2 AND n.r <= 2)""",
    f"""hm AS (SELECT 5 AS sec, 0 AS k, 'correlation' AS kind, 'heatmap' AS chart_type, CAST(NULL AS VARCHAR) AS x,
                   CAST(NULL AS VARCHAR) AS y, 'Pearson Correlation Heatmap' AS title WHERE {n_numeric} >= 2)""",
    """plan AS (SELECT CAST(row_number() OVER (ORDER BY sec, k) - 1 AS INTEGER) AS ord, kind, chart_type, x, y, title FROM
             (SELECT * FROM u UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM bx UNION ALL SELECT * FROM ln UNION ALL SELECT * FROM hm))""",
)


_PLAN_SQL = plan_sql("lineitem", _LI_COLS, {"l_shipdate"}, set(_LI_NUM), len(_LI_NUM))


@query("v09_rule_chart_plan", _PLAN_SQL + "SELECT ord, kind, chart_type, x, y, title FROM plan")
def q_v09(spark, sf):
    return V.rule_plan(fx.table(spark, sf, "lineitem")).select("ord", "kind", "chart_type", "x", "y", "title")


@query("r08_filter_chart_plan", _PLAN_SQL + "SELECT ord, chart_type, x, y, title FROM plan WHERE kind = 'bivariate' AND chart_type = 'scatter'")
def q_r08(spark, sf):
    p = V.classify_plan(V.rule_plan(fx.table(spark, sf, "lineitem")))
    return V.filter_plan(p, kind="bivariate", chart_type="scatter").select("ord", "chart_type", "x", "y", "title")


@query(
    "v12_chart_records",
    _PLAN_SQL
    + """SELECT ord, CASE WHEN chart_type = 'heatmap' THEN 'correlation_heatmap' ELSE chart_type END AS type,
                coalesce(x, '') AS column, title, '' AS description FROM plan""",
)
def q_v12(spark, sf):
    return V.chart_records(V.rule_plan(fx.table(spark, sf, "lineitem")))


def _external_plan(spark, sf):
    """A plan reply text built from the table's own rule plan plus invalid items
    (unknown column, unsupported chart type, unknown color)."""
    plan = V.rule_plan(fx.table(spark, sf, "lineitem"))
    items = plan.select(
        F.struct(
            "title", F.lit("from rules").alias("description"),
            F.when(F.col("chart_type") == "histogram", "bar").otherwise(F.col("chart_type")).alias("chart_type"),
            "x", "y", F.when(F.col("kind") == "bivariate", F.lit("l_linestatus")).otherwise(F.lit("no_such_col")).alias("color"),
        ).alias("it"),
        "ord",
    )
    bad = spark.createDataFrame(
        [("'a' vs 'b'", "bad x", "scatter", "no_such_col", "l_tax", None, 1000), ("Pie of tax", "bad type", "pie", "l_tax", None, None, 1001)],
        "title string, description string, chart_type string, x string, y string, color string, ord int",
    ).select(F.struct("title", "description", "chart_type", "x", "y", "color").alias("it"), "ord")
    allp = items.unionByName(bad)
    reply = allp.agg(
        F.concat(F.lit("```json\n"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", "it"))), lambda s: s["it"])), F.lit("\n```")).alias("reply")
    )
    return reply


@query(
    "v10_v11_validated_external_plan",
    _PLAN_SQL
    + """SELECT title, CASE WHEN chart_type = 'histogram' THEN 'bar' ELSE chart_type END AS chart_type, x, y,
                CASE WHEN kind = 'bivariate' THEN 'l_linestatus' END AS color,
                CASE WHEN chart_type = 'heatmap' THEN 'correlation'
                     WHEN lower(title) LIKE '%vs%' OR title LIKE '%×%' OR lower(title) LIKE '% by %' THEN 'bivariate'
                     ELSE 'univariate' END AS kind
         FROM plan""",
)
def q_v10(spark, sf):
    df = fx.table(spark, sf, "lineitem")
    parsed = V.parse_plan(_external_plan(spark, sf), "reply")
    return V.validate_plan(df, parsed).select("title", "chart_type", "x", "y", "color", "kind")


@query(
    "v01_univariate_datetime",
    "SELECT strftime(l_shipdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1",
)
def q_v01(spark, sf):
    return V.univariate(fx.table(spark, sf, "lineitem"), "l_shipdate")["by_period"]


@query("v01_univariate_categorical", "SELECT l_returnflag AS value, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def q_v01c(spark, sf):
    return V.univariate(fx.table(spark, sf, "lineitem"), "l_returnflag")["value_counts"]


@query("v02_scatter_pairs", _with(_CF) + "SELECT l_quantity, qty_disc FROM cf WHERE l_quantity IS NOT NULL AND qty_disc IS NOT NULL")
def q_v02(spark, sf):
    df = fx.corr_frame(spark, sf)
    kind, data = V.bivariate(df, "l_quantity", "qty_disc", {"l_quantity": "numerical", "qty_disc": "numerical"})
    assert kind == "scatter"
    return data


@query(
    "v03_box_by_category",
    _with("q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, "
          "quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)")
    + """SELECT l.l_returnflag, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
              ROUND(min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 4) AS lower_whisker,
              ROUND(max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END), 4) AS upper_whisker,
              ROUND(avg(l_extendedprice), 4) AS mean, ROUND(stddev_samp(l_extendedprice), 4) AS sd, CAST(count(*) AS BIGINT) AS n
         FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY l.l_returnflag, q1, median, q3""",
)
def q_v03(spark, sf):
    df = fx.table(spark, sf, "lineitem")
    kind, data = V.bivariate(df, "l_extendedprice", "l_returnflag", {"l_extendedprice": "numerical", "l_returnflag": "categorical"})
    assert kind == "box"
    return data.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker", "mean", "sd")], "n")


@query("v04_stacked_counts", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2")
def q_v04(spark, sf):
    df = fx.table(spark, sf, "lineitem")
    kind, data = V.bivariate(df, "l_returnflag", "l_linestatus", {"l_returnflag": "categorical", "l_linestatus": "boolean"})
    assert kind == "stacked_bar"
    return data


@query("v05_time_series_month", "SELECT strftime(o_orderdate, '%Y-%m') AS period, ROUND(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def q_v05(spark, sf):
    ts = V.time_series(fx.table(spark, sf, "orders"), "o_orderdate", "o_totalprice", period="month")
    return ts.select("period", F.round("total", 2).alias("total"))


@query("v05_time_series_points", "SELECT o_orderdate::VARCHAR AS o_orderdate, o_totalprice FROM orders")
def q_v05p(spark, sf):
    df = fx.table(spark, sf, "orders")
    kind, data = V.bivariate(df, "o_orderdate", "o_totalprice", {"o_orderdate": "datetime", "o_totalprice": "numerical"})
    assert kind == "line"
    return data.select(F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice")


@query("v06_strip_pairs", "SELECT c_name, c_mktsegment FROM customer")
def q_v06(spark, sf):
    df = fx.table(spark, sf, "customer")
    kind, data = V.bivariate(df, "c_name", "c_mktsegment")
    assert kind == "strip"
    return data


def _heat_sql() -> str:
    cols = _CF_COLS
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"SELECT '{a}' AS x, '{a}' AS y, CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS r FROM cf")
            else:
                parts.append(
                    f"SELECT '{a}' AS x, '{b}' AS y, CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END AS r FROM cf"
                )
    return _with(_CF) + "SELECT x, y, ROUND(r, 4) AS r FROM (" + " UNION ALL ".join(parts) + ")"


@query("v07_heatmap_square", _heat_sql())
def q_v07(spark, sf):
    h = V.heatmap(fx.corr_frame(spark, sf))
    return h.select("x", "y", F.round("r", 4).alias("r"))


@query("v08_distribution_pie", "SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count, ROUND(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def q_v08(spark, sf):
    kind, data = V.distribution(fx.table(spark, sf, "orders"), "o_orderpriority", {"o_orderpriority": "categorical"})
    assert kind == "pie"
    return data.select("value", "count", F.round("share", 6).alias("share"))


@query("v08_distribution_bar_many", "SELECT p_brand AS value, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY 1")
def q_v08b(spark, sf):
    kind, data = V.distribution(fx.table(spark, sf, "part"), "p_brand", {"p_brand": "categorical"})
    assert kind == "bar"
    return data


@query(
    "v08_distribution_box",
    _with("q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events)")
    + """SELECT ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
              ROUND(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) AS lower_whisker,
              ROUND(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) AS upper_whisker,
              ROUND(avg(value), 4) AS mean, ROUND(stddev_samp(value), 4) AS sd, CAST(count(*) AS BIGINT) AS n
         FROM events, q GROUP BY q1, median, q3""",
)
def q_v08x(spark, sf):
    kind, data = V.distribution(fx.table(spark, sf, "events"), "value", {"value": "numerical"})
    assert kind == "box"
    return data.select(*[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker", "mean", "sd")], "n")



def _hist(src: str, col: str, nb, density: bool) -> str:
    from tablewise.plans.catalog_stats import _hist_sql

    return _hist_sql(src, col, nb, density)


@query("v01_univariate_numerical_density", _hist("documents", "n_chars", 60, True))
def q_v01n(spark, sf):
    from tablewise.plans.catalog_stats import _hist_out

    parts = V.univariate(fx.table(spark, sf, "documents"), "n_chars", {"n_chars": "numerical"})
    return _hist_out(parts["density"], True)


@query(
    "v01_univariate_high_cardinality",
    "SELECT 'p_name' AS column, CAST(rank AS INTEGER) AS rank, value, count FROM ("
    "SELECT p_name AS value, CAST(count(*) AS BIGINT) AS count, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank "
    "FROM part GROUP BY p_name) WHERE rank <= 20",
)
def q_v01h(spark, sf):
    return V.univariate(fx.table(spark, sf, "part"), "p_name", {"p_name": "high_cardinality"})["top"]


@query("v08_distribution_datetime", "SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def q_v08d(spark, sf):
    kind, data = V.distribution(fx.table(spark, sf, "orders"), "o_orderdate", {"o_orderdate": "datetime"})
    assert kind == "bar"
    return data


@query(
    "v08_distribution_top10_other",
    "SELECT 'c_name' AS column, CAST(rank AS INTEGER) AS rank, value, count FROM ("
    "SELECT c_name AS value, CAST(count(*) AS BIGINT) AS count, row_number() OVER (ORDER BY count(*) DESC, c_name) AS rank "
    "FROM customer GROUP BY c_name) WHERE rank <= 10",
)
def q_v08o(spark, sf):
    kind, data = V.distribution(fx.table(spark, sf, "customer"), "c_name", {"c_name": "high_cardinality"})
    assert kind == "bar"
    return data


@query(
    "v11_classify_plan",
    _PLAN_SQL
    + """SELECT ord, title, CASE WHEN chart_type = 'heatmap' THEN 'correlation'
                     WHEN lower(title) LIKE '%vs%' OR title LIKE '%×%' OR lower(title) LIKE '% by %' THEN 'bivariate'
                     ELSE 'univariate' END AS kind FROM plan""",
)
def q_v11(spark, sf):
    plan = V.rule_plan(fx.table(spark, sf, "lineitem")).drop("kind")
    return V.classify_plan(plan).select("ord", "title", "kind")
