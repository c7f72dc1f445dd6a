"""Registered queries: multi-level quantiles, replies of every kind, text dates in charts, whole-table
chart aggregates, executed external plans and the remaining members of the summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.operators import enrich as E
from tablewise.operators import profile as P
from tablewise.operators.quantiles import quantiles
from tablewise.plans.registry import _r, _with, query  # first: a worker may import this module by itself

from tablewise.plans import charts as V
from tablewise.plans import fixtures as fx
from tablewise.plans import insights as I
from tablewise.plans.catalog_clean import _NAN_EVENTS_SQL, nan_events
from tablewise.plans.prepare import prepare

# --- quantiles that need several levels -----------------------------------------

_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


def _quantile_sql(src: str, cols: list[str], by: str | None = None) -> str:
    parts = [
        f"SELECT {by + ', ' if by else ''}'{c}' AS column, CAST({p} AS DOUBLE) AS p, {_r(f'quantile_cont({c}, {p})')} AS value, CAST(count({c}) AS BIGINT) AS n "
        f"FROM {src}{' GROUP BY ' + by if by else ''}"
        for c in cols
        for p in _PROBS
    ]
    return " UNION ALL ".join(parts)


@query("a04_quantiles_many_levels", _quantile_sql("lineitem", ["l_extendedprice", "l_quantity", "l_partkey"]))
def q_levels(spark, sf):
    out = quantiles(fx.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_partkey"], _PROBS, max_candidates=20)
    return out.withColumn("value", F.round("value", 4))


@query("a04_quantiles_many_levels_grouped", _quantile_sql("lineitem", ["l_extendedprice"], "l_returnflag"))
def q_levels_grouped(spark, sf):
    out = quantiles(fx.table(spark, sf, "lineitem"), ["l_extendedprice"], _PROBS, by=["l_returnflag"], max_candidates=20)
    return out.withColumn("value", F.round("value", 4))


_HEAVY = "(SELECT l_returnflag, CASE WHEN l_orderkey % 3 = 0 THEN CAST(1000 AS DOUBLE) ELSE l_extendedprice END AS price FROM lineitem)"


@query("a04_quantiles_heavy_value", _quantile_sql(_HEAVY, ["price"], "l_returnflag"))
def q_heavy(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    li = li.select("l_returnflag", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1000.0)).otherwise(F.col("l_extendedprice")).alias("price"))
    out = quantiles(li, ["price"], _PROBS, by=["l_returnflag"], max_candidates=50)
    return out.withColumn("value", F.round("value", 4))


# --- replies ----------------------------------------------------------------------


def _replies(spark, sf):
    """One reply per event; its kind goes round: null first field, brackets in the prose, wrong
    type, broken text, plain array without a fence."""
    ev = fx.table(spark, sf, "events")
    k = F.col("event_id") % 5
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    fence = lambda body: F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    reply = (
        F.when(k == 0, fence(F.concat(F.lit('[{"a":null,"b":"'), t, F.lit('"},{"a":'), i, F.lit(',"b":null}]'))))
        .when(k == 1, F.concat(F.lit("See note [1] and {x}.\n"), fence(F.concat(F.lit('[{"a":'), i, F.lit(',"b":"'), t, F.lit('"}]'))), F.lit("\nmore [2].")))
        .when(k == 2, F.concat(F.lit('Here: [{"a":"x","b":"'), t, F.lit('"}] done')))
        .when(k == 3, F.concat(F.lit('ERROR: [{"a":'), i))
        .otherwise(F.concat(F.lit('[{"b":"'), t, F.lit('","a":'), i, F.lit("}]")))
    )
    return ev.select("event_id", reply.alias("reply"))


@query(
    "e02_parse_reply_kinds",
    """SELECT event_id, CAST(0 AS INTEGER) AS pos, CASE WHEN event_id % 5 IN (1, 4) THEN CAST(event_id AS DOUBLE) END AS a, event_type AS b FROM events WHERE event_id % 5 <> 3
       UNION ALL SELECT event_id, 1, CAST(event_id AS DOUBLE), NULL FROM events WHERE event_id % 5 = 0""",
)
def q_reply_kinds(spark, sf):
    out = E.parse_reply(_replies(spark, sf), "reply", "a bigint, b string", keep=["event_id"], position="pos")
    return out.withColumn("a", F.col("a").cast("double"))


@query("e02_reply_ok_flags", "SELECT event_id, event_id % 5 <> 3 AS parse_ok FROM events")
def q_reply_ok(spark, sf):
    return E.reply_ok(_replies(spark, sf), "reply", "a bigint, b string").select("event_id", "parse_ok")


@query("e02_parse_object_reply", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, value FROM events WHERE event_id % 7 <> 0")
def q_reply_object(spark, sf):
    ev = fx.table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"kind":'), kind, F.lit(',"value":'), F.col("value").cast("string"), F.lit("}"))
    reply = F.when(F.col("event_id") % 7 == 0, F.lit("no object here")).otherwise(F.concat(F.lit("Answer {draft}:\n```\n"), body, F.lit("\n```")))
    return E.parse_reply(ev.select("event_id", reply.alias("reply")), "reply", "kind string, value double", kind="object", keep=["event_id"])


def _shout(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(role=pdf["role"].str.upper())


@query("e03_enrich_success", "SELECT conv_id, turn, upper(role) AS role FROM conversations")
def q_enrich_success(spark, sf):
    conv = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out, enhanced, _ = E.enrich_or_fallback(conv, _shout)
    assert enhanced
    return out


@query(
    "c12_prepare_enriched",
    """SELECT DISTINCT conv_id, turn, upper(coalesce(role, (SELECT role FROM (SELECT CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role FROM conversations)
         WHERE role IS NOT NULL GROUP BY role ORDER BY count(*) DESC, role LIMIT 1))) AS role
       FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role FROM conversations)""",
)
def q_prepare(spark, sf):
    conv = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("role"))
    done = prepare(conv, strategy="mode", fn=_shout)
    assert done["enhanced"]
    return done["data"]


# --- text dates ---------------------------------------------------------------------


def _us_orders(spark, sf):
    """Orders whose date is a text like 12/31/1998."""
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"), "o_orderstatus")


@query("v01_univariate_text_date", "SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def q_v01_text(spark, sf):
    return V.univariate(_us_orders(spark, sf), "order_date")["by_period"]


@query("v08_distribution_text_date", "SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def q_v08_text(spark, sf):
    return V.distribution(_us_orders(spark, sf), "order_date")[1]


@query(
    "v05_points_of_a_text_date_in_order",
    "SELECT CAST(o_orderdate AS TIMESTAMP) AS order_date, o_totalprice FROM orders",
)
def q_v05_text(spark, sf):
    kind, data = V.bivariate(_us_orders(spark, sf), "order_date", "o_totalprice")
    assert kind == "line"
    return data.select(F.col("order_date").cast("timestamp_ntz").alias("order_date"), "o_totalprice")


@query(
    "v05_period_totals_text_date",
    f"SELECT strftime(o_orderdate, '%Y-%m') AS period, {_r('sum(o_totalprice)', 2)} AS total, {_r('avg(o_totalprice)', 4)} AS mean, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1",
)
def q_v05_totals(spark, sf):
    kind, data = V.bivariate_data(_us_orders(spark, sf), "order_date", "o_totalprice")
    assert kind == "line"
    return data["line"].select("period", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "count")


@query(
    "i02_business_context_text_date",
    """SELECT 101 AS ord, '  ' || string_agg(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][m] || ': ' || format('{:,.2f}', total), ', ' ORDER BY m) AS text
       FROM (SELECT month(o_orderdate) AS m, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders GROUP BY 1)""",
)
def q_i02_text(spark, sf):
    return I.business_context(_us_orders(spark, sf)).filter("ord = 101")


# --- whole-table chart data ---------------------------------------------------------


def _bin_sql(col: str, src: str, bins: int = 30) -> str:
    lo, w = f"(SELECT min({col}) FROM {src})", f"((SELECT max({col}) - min({col}) FROM {src}) / {bins}.0)"
    return f"ROUND({lo} + least(floor(({col} - {lo}) / {w}), {bins - 1}) * {w}, 4)"


@query(
    "v02_scatter_bins",
    f"SELECT {_bin_sql('l_extendedprice', 'lineitem')} AS x, {_bin_sql('l_tax', 'lineitem')} AS y, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2",
)
def q_v02_bins(spark, sf):
    kind, data = V.bivariate_data(fx.table(spark, sf, "lineitem"), "l_extendedprice", "l_tax")
    assert kind == "scatter"
    return data["scatter"].select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "count")


@query(
    "v02_scatter_trend_line",
    f"SELECT {_r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {_r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, "
    f"{_r('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2, CAST(count(*) AS BIGINT) AS n FROM lineitem",
)
def q_v02_trend(spark, sf):
    t = V.bivariate_data(fx.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")[1]["trend_line"]
    return t.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("v06_strip_counts", "SELECT event_type AS x, strftime(ts, '%Y-%m') AS y, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2")
def q_v06(spark, sf):
    kind, data = V.bivariate_data(fx.table(spark, sf, "events"), "event_type", "ts")
    assert kind == "strip"
    return data["strip"]


@query("v06_strip_counts_high_cardinality", "SELECT c_name AS x, c_mktsegment AS y, CAST(count(*) AS BIGINT) AS count FROM customer GROUP BY 1, 2")
def q_v06_text(spark, sf):
    kind, data = V.bivariate_data(fx.table(spark, sf, "customer"), "c_name", "c_mktsegment")
    assert kind == "strip"
    return data["strip"]


# --- external plans -------------------------------------------------------------------

_PLAN = """[{"title":"a","chart_type":"bar","x":"l_returnflag","y":"l_quantity","color":"l_linestatus"},
{"title":null,"chart_type":"bar","x":null,"y":"l_tax"}, {"title":"text y","chart_type":"bar","x":"l_returnflag","y":"l_linestatus"},
{"title":"b","chart_type":"box","x":"l_returnflag","y":"l_quantity","color":"l_linestatus"}, {"title":"c","chart_type":"scatter","x":"l_discount","y":"l_tax"},
{"title":"d","chart_type":"line","x":"l_shipdate","y":"l_quantity"}, {"chart_type":"heatmap"}, {"title":"p","chart_type":"pie","x":"l_tax"}]"""


def _drawn(spark, sf, chart: str):
    li = fx.table(spark, sf, "lineitem")
    # the reply is one text, given once per row of region and cut to one: it comes from a table as all replies do
    reply = fx.table(spark, sf, "region").limit(1).select(F.lit("Plan [draft]:\n```json\n" + _PLAN + "\n```").alias("reply"))
    return {it["chart_type"]: data for it, data in V.execute_plan(li, V.parse_plan(reply, "reply"))}[chart]


@query("v10_executed_bar", "SELECT l_returnflag, l_linestatus, ROUND(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2")
def q_v10_bar(spark, sf):
    return _drawn(spark, sf, "bar").withColumn("total", F.round("total", 2))


@query(
    "v10_executed_box_by_color",
    f"SELECT l_returnflag, l_linestatus, {_r('quantile_cont(l_quantity, 0.25)')} AS q1, {_r('quantile_cont(l_quantity, 0.5)')} AS median, "
    f"{_r('quantile_cont(l_quantity, 0.75)')} AS q3, {_r('avg(l_quantity)')} AS mean, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2",
)
def q_v10_box(spark, sf):
    r = lambda c: F.round(c, 4).alias(c)
    return _drawn(spark, sf, "box").select("l_returnflag", "l_linestatus", r("q1"), r("median"), r("q3"), r("mean"), "n")


@query(
    "v10_executed_scatter",
    f"SELECT {_bin_sql('l_discount', 'lineitem')} AS x, {_bin_sql('l_tax', 'lineitem')} AS y, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2",
)
def q_v10_scatter(spark, sf):
    return _drawn(spark, sf, "scatter").select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "count")


@query("v10_executed_line", "SELECT strftime(l_shipdate, '%Y-%m') AS period, ROUND(sum(l_quantity), 2) AS total, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def q_v10_line(spark, sf):
    return _drawn(spark, sf, "line").select("period", F.round("total", 2).alias("total"), "count")


@query("v10_visualize_broken_plan_uses_rules", "SELECT 'rules' AS route, CAST(count(*) AS BIGINT) AS types FROM (SELECT unnest(range(6)))")
def q_v10_route(spark, sf):
    ev = fx.table(spark, sf, "events")
    out = V.visualize(ev, plan=V.parse_plan(fx.table(spark, sf, "region").limit(1).select(F.lit("no plan today [sorry").alias("r")), "r"))
    return out["column_types"].agg(F.lit(out["route"]).alias("route"), F.count("*").alias("types"))


# --- all charts of a plan from a fixed number of scans -------------------------------


_PLAN_ITEMS = [("histogram", "l_quantity", None), ("bar", "l_returnflag", None), ("line", "l_shipdate", None), ("scatter", "l_extendedprice", "l_tax"), ("line", "l_shipdate", "l_quantity"), ("box", "l_returnflag", "l_quantity")]


@query(
    "v09_plan_data_one_cube",
    f"""WITH st AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(least(50, greatest(10, floor(sqrt(count(l_quantity))))) AS BIGINT) AS nb FROM lineitem),
    h AS (SELECT least(CAST(floor((l_quantity - lo) / (hi - lo) * nb) AS BIGINT), nb - 1) AS b, count(*) AS n FROM lineitem, st GROUP BY 1),
    cells AS (
      SELECT 'histogram' AS chart, CAST(NULL AS VARCHAR) AS label, CAST(i AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, coalesce(n, 0) AS count, CAST(NULL AS DOUBLE) AS total
        FROM (SELECT unnest(range(nb)) AS i FROM st) LEFT JOIN h ON b = i
      UNION ALL SELECT 'value_counts', l_returnflag, NULL, NULL, count(*), NULL FROM lineitem GROUP BY 2
      UNION ALL SELECT 'by_period', strftime(l_shipdate, '%Y-%m'), NULL, NULL, count(*), NULL FROM lineitem GROUP BY 2
      UNION ALL SELECT 'scatter', NULL, {_bin_sql('l_extendedprice', 'lineitem')}, {_bin_sql('l_tax', 'lineitem')}, count(*), NULL FROM lineitem GROUP BY 3, 4
      UNION ALL SELECT 'trend_line', NULL, {_r('regr_r2(l_tax, l_extendedprice)')}, {_r('regr_intercept(l_tax, l_extendedprice)')}, count(*), NULL FROM lineitem
      UNION ALL SELECT 'line', strftime(l_shipdate, '%Y-%m'), NULL, NULL, count(*), ROUND(sum(l_quantity), 2) FROM lineitem GROUP BY 2
      UNION ALL SELECT 'box', l_returnflag, {_r('quantile_cont(l_quantity, 0.25)')}, {_r('quantile_cont(l_quantity, 0.5)')}, count(*), {_r('avg(l_quantity)')} FROM lineitem GROUP BY 2)
    SELECT chart, label, x, y, CAST(count AS BIGINT) AS count, total FROM cells""",
)
def q_v09_cube(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    items = [{"chart_type": t, "x": x, "y": y} for t, x, y in _PLAN_ITEMS]
    tmap = {"l_quantity": "numerical", "l_extendedprice": "numerical", "l_tax": "numerical", "l_returnflag": "categorical", "l_shipdate": "datetime"}
    shown = {
        "histogram": (None, F.col("bin"), None, "count", None),
        "value_counts": (F.col("value"), None, None, "count", None),
        "by_period": (F.col("period"), None, None, "count", None),
        "scatter": (None, F.round("x", 4), F.round("y", 4), "count", None),
        "trend_line": (None, F.round("r2", 4), F.round("intercept", 4), "n", None),
        "line": (F.col("period"), None, None, "count", F.round("total", 2)),
        "box": (F.col("l_returnflag"), F.round("q1", 4), F.round("median", 4), "n", F.round("mean", 4)),
    }
    out = None
    for data in V.plan_data(li, items, tmap, rules=True):
        for name, frame in data.items():
            if name == "density":  # the histogram's cells once more
                continue
            label, x, y, n, total = (F.lit(None) if c is None else c for c in shown[name])
            part = frame.select(F.lit(name).alias("chart"), label.cast("string").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col(n).alias("count"), total.cast("double").alias("total"))
            out = part if out is None else out.unionByName(part)
    return out


# --- insight replies -----------------------------------------------------------------


def _insight_reply(spark, sf, broken: bool):
    """A model's answer that quotes the table: the number of events and the first type."""
    ev = fx.table(spark, sf, "events").agg(F.count("*").cast("string").alias("n"), F.min("event_type").alias("t"))
    body = F.concat(F.lit('{"insights":["'), "n", F.lit(' events","first type '), "t", F.lit('"],"patterns":[],"recommendations":["Check '), "t", F.lit('"],"executive_summary":"'), "n", F.lit(' rows"}'))
    return ev.select((F.lit("Sorry {") if broken else F.concat(F.lit("Result {v1}:\n```json\n"), body, F.lit("\n```"))).alias("reply"))


_EXTRA = "'Investigate outlier rows manually before using the data for modelling.', 'Apply feature scaling before ML training.', 'Consider dimensionality reduction if the feature count is large.'"


@query(
    "i10_reply_used",
    f"""WITH e AS (SELECT CAST(count(*) AS VARCHAR) AS n, min(event_type) AS t FROM events)
    SELECT 'insights' AS section, n || ' events' AS text FROM e UNION ALL SELECT 'insights', 'first type ' || t FROM e
    UNION ALL SELECT 'executive_summary', n || ' rows' FROM e UNION ALL SELECT 'recommendations', 'Check ' || t FROM e
    UNION ALL SELECT 'recommendations', unnest([{_EXTRA}])""",
)
def q_i10_reply(spark, sf):
    out = I.analyze(fx.table(spark, sf, "events"), reply=_insight_reply(spark, sf, broken=False))
    parts = [out[s].select(F.lit(s).alias("section"), "text") for s in ("insights", "executive_summary", "recommendations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("i10_reply_broken", "SELECT 'rules' AS route, 'The dataset contains ' || format('{:,}', count(*)) || ' rows and 6 columns.' AS first FROM events")
def q_i10_broken(spark, sf):
    out = I.analyze(fx.table(spark, sf, "events"), reply=_insight_reply(spark, sf, broken=True))
    return out["insights"].filter("ord = 0").join(F.broadcast(out["route"])).select("route", F.col("text").alias("first"))  # one row each


_EV = ["event_id", "user_id", "value"]


@query("i10_analyze_describe", " UNION ALL ".join(f"SELECT '{c}' AS column, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS std, {_r(f'quantile_cont({c}, 0.5)')} AS q50 FROM events" for c in _EV))
def q_i10_describe(spark, sf):
    return I.analyze(fx.table(spark, sf, "events"))["numerical"].select("column", "mean", "std", "q50")


@query(
    "i10_analyze_outliers",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count "
        f"FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events) HAVING outlier_count > 0"
        for c in _EV
    ),
)
def q_i10_outliers(spark, sf):
    return I.analyze(fx.table(spark, sf, "events"))["outliers"].select("column", "outlier_count")


# --- small points -----------------------------------------------------------------------


@query(
    "e05_group_impute_nan",
    _with(_NAN_EVENTS_SQL, "v AS (SELECT n.event_id, e.event_type, CASE WHEN isnan(n.value) OR isinf(n.value) THEN NULL ELSE n.value END AS value FROM nan_ev n JOIN events e ON n.event_id = e.event_id)",
          "g AS (SELECT event_type, avg(value) AS gv FROM v GROUP BY 1)")
    + "SELECT v.event_id, v.event_type, ROUND(coalesce(v.value, g.gv), 6) AS value FROM v JOIN g ON v.event_type = g.event_type",
)
def q_e05_nan(spark, sf):
    types = fx.table(spark, sf, "events").select("event_id", "event_type")
    ev = nan_events(spark, sf).withColumn("value", F.when(F.abs("value") != float("inf"), F.col("value"))).join(types, "event_id")
    return E.impute_by_group(ev, "value", "event_type").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "c04_mode_signed_zero",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 OR l_orderkey % 10 < 5 THEN CAST(0 AS DOUBLE) WHEN l_orderkey % 10 < 8 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS x FROM lineitem",
)
def q_signed_zero(spark, sf):
    k = F.col("l_orderkey") % 10
    x = F.when(k == 0, F.lit(None).cast("double")).when(k < 3, F.lit(0.0)).when(k < 5, F.lit(-0.0)).when(k < 8, F.lit(1.0)).otherwise(F.lit(2.0))
    out = C.impute(fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")), strategy="mode")
    return out.withColumn("x", F.when(F.col("x") == 0, F.lit(0.0)).otherwise(F.col("x")))


@query(
    "p13_statistical_summary_missing",
    _with(fx.DIRTY_EVENTS_SQL) + "SELECT 'event_type' AS column, CAST(count_if(event_type IS NULL) AS BIGINT) AS missing FROM dirty_ev UNION ALL SELECT 'value', CAST(count_if(value IS NULL) AS BIGINT) FROM dirty_ev",
)
def q_p13_missing(spark, sf):
    return P.statistical_summary(fx.dirty_events(spark, sf))["missing_values"].select("column", "missing")


@query("p13_statistical_summary_shape", _with(fx.DIRTY_EVENTS_SQL) + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns FROM dirty_ev")
def q_p13_shape(spark, sf):
    return P.statistical_summary(fx.dirty_events(spark, sf))["shape"]


@query("p14_compact_summary_moments", " UNION ALL ".join(f"SELECT '{c}' AS column, {_r(f'skewness({c})')} AS skewness, {_r(f'kurtosis({c})')} AS kurtosis FROM documents" for c in ("doc_id", "n_chars")))
def q_p14_moments(spark, sf):
    return P.compact_summary(fx.table(spark, sf, "documents"))["moments"].select("column", "skewness", "kurtosis")


@query(
    "p14_compact_summary_categorical",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM orders) AS \"unique\", {c} AS top_value, CAST(count(*) AS BIGINT) AS top_count "
        f"FROM orders GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def q_p14_categorical(spark, sf):
    out = P.compact_summary(fx.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    return out["categorical"].select("column", "unique", "top_value", "top_count")
