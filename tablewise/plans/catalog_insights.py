"""Registered queries: insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators import stats as S
from tablewise.plans import fixtures as fx
from tablewise.plans import insights as I
from tablewise.plans.catalog_stats import _STRONG_SQL, _outlier_sql, strong_pairs_sql
from tablewise.plans.registry import _with, query

_CF = fx.CORR_FRAME_SQL
_CF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "qty_disc", "neg_qty_tax"]
_DEV_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def _trend_sql(src: str, num_cols: list[str], all_cols: list[str]) -> str:
    sk = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS column, skewness({c}) AS s, count({c}) AS n FROM {src}" for i, c in enumerate(num_cols)
    )
    miss = " + ".join(f"count_if({c} IS NULL)" for c in all_cols)
    return f"""SELECT ord, text FROM (
        SELECT ord, CASE WHEN s > 1 THEN printf('''%s'' is heavily right-skewed (skew=%.2f), indicating a long tail of high values.', column, s)
                         WHEN s < -1 THEN printf('''%s'' is heavily left-skewed (skew=%.2f), indicating a concentration of high values.', column, s)
                    END AS text
        FROM ({sk}) WHERE n >= 3
        UNION ALL
        SELECT 10000 AS ord, printf('Dataset has %.1f%% missing values — imputation strategy significantly impacts results.', pct) AS text
        FROM (SELECT ({miss}) / greatest(count(*) * {len(all_cols)}, 1) * 100 AS pct FROM {src}) WHERE pct > 5
    ) WHERE text IS NOT NULL"""


@query("i01_trends", _with(fx.DIRTY_EVENTS_SQL) + _trend_sql("dirty_ev", ["event_id", "user_id", "value"], _DEV_COLS))
def q_i01(spark, sf):
    return I.trends(fx.dirty_events(spark, sf))


@query("i01_trends_documents", _trend_sql("documents", ["doc_id", "n_chars"], ["doc_id", "text", "lang", "source", "n_chars"]))
def q_i01b(spark, sf):
    return I.trends(fx.table(spark, sf, "documents"))


def _top3_sql() -> str:
    cols = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
    vc = " UNION ALL ".join(
        f"SELECT {i} AS cord, '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY {c}" for i, c in enumerate(cols)
    )
    return f"""SELECT CAST(cord + 1 AS INTEGER) AS ord, '  • ' || column || ': ' || string_agg(printf('''%s'': %d records', substr(value, 1, 20), n), ', ' ORDER BY rn) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY column ORDER BY n DESC, value) AS rn FROM ({vc})) WHERE rn <= 3
        GROUP BY cord, column"""


_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


@query(
    "i02_business_context",
    "SELECT 0 AS ord, 'Categorical Columns Top Values:' AS text UNION ALL "
    + _top3_sql()
    + " UNION ALL SELECT 100, 'Seasonal Trends (o_orderkey summed by Month):' UNION ALL "
    + f"""SELECT 101, '  ' || string_agg({_MONTHS}[m] || ': ' || format('{{:,.2f}}', total), ', ' ORDER BY m) FROM
          (SELECT month(o_orderdate) AS m, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders GROUP BY 1)""",
)
def q_i02(spark, sf):
    return I.business_context(fx.table(spark, sf, "orders"))


@query(
    "i03_choose_columns",
    _with("dt AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS Price FROM orders)")
    + "SELECT CASE WHEN count_if(try_strptime(order_date, '%Y-%m-%d') IS NULL) = 0 THEN 'order_date' END AS date_col, "
    "'Price' AS value_col FROM dt",
)
def q_i03(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_totalprice").alias("Price")
    )
    d, v = I.choose_columns(o)  # the date probe scans the whole text column
    return spark.createDataFrame([(d, v)], "date_col string, value_col string")


def _i4_sql() -> str:
    strong = "(" + _STRONG_SQL + ")"
    outl = "(" + _outlier_sql("cf", _CF_COLS) + ")"
    return (
        "SELECT 0 AS ord, printf('The dataset contains %s rows and %d columns.', format('{:,}', count(*)), 7) AS text FROM lineitem "
        f"UNION ALL SELECT 2, printf('Strongest correlation: ''%s'' and ''%s'' (%+.2f, %s).', col1, col2, correlation, strength) FROM (SELECT * FROM {strong} LIMIT 1) "
        "UNION ALL SELECT 3, printf('''%s'' has the most outliers (%s%% of values fall outside [%.2f, %.2f]).', column, CAST(outlier_pct AS VARCHAR), lower_bound, upper_bound) "
        f"FROM (SELECT * FROM {outl} ORDER BY outlier_pct DESC LIMIT 1)"
    )


def _cf_wrap(sql: str) -> str:
    # the strong-pairs and outlier SQL each carry their own WITH; give them cf
    return sql.replace("FROM cf", f"FROM ({fx.CORR_FRAME_SQL.strip()[len('cf AS ('):-1]})")


@query("i04_rule_insights", _cf_wrap(_i4_sql()))
def q_i04(spark, sf):
    cf = fx.corr_frame(spark, sf)
    return I.rule_insights(cf, S.strong_correlations(cf), S.outlier_report(cf))


@query(
    "i05_patterns",
    _with(fx.DIRTY_EVENTS_SQL)
    + "SELECT CAST(ord AS INTEGER) AS ord, text FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, printf('''%s'' shows high variability (CV = %.2f).', '{c}', stddev_samp({c}) / abs(avg({c}))) AS text "
        f"FROM dirty_ev HAVING stddev_samp({c}) / abs(avg({c})) > 1"
        for i, c in enumerate(["event_id", "user_id", "value"])
    )
    + " UNION ALL SELECT 100000 + row_number() OVER (ORDER BY ord) AS ord, text FROM ("
    + _trend_sql("dirty_ev", ["event_id", "user_id", "value"], _DEV_COLS)
    + ") QUALIFY row_number() OVER (ORDER BY ord) <= 3)",
)
def q_i05(spark, sf):
    d = fx.dirty_events(spark, sf)
    return I.patterns(d, I.trends(d))


@query(
    "i06_recommendations",
    _cf_wrap(
        "SELECT 0 AS ord, 'Investigate outlier rows manually before using the data for modelling.' AS text "
        "UNION ALL SELECT 2, 'Apply feature scaling (StandardScaler / MinMaxScaler) before ML training.' "
        f"UNION ALL SELECT 1, printf('Consider using ''%s'' and ''%s'' as features in a predictive model.', col1, col2) FROM (SELECT * FROM ({_STRONG_SQL}) LIMIT 1)"
    ),
)
def q_i06(spark, sf):
    return I.recommendations(S.strong_correlations(fx.corr_frame(spark, sf)))


@query(
    "i07_executive_summary",
    _cf_wrap(
        "SELECT 0 AS ord, printf('This dataset (%s rows × %d cols) has been cleaned and analysed. %d significant correlations and %d columns with outliers were identified. See detailed insights and recommendations above.', "
        f"format('{{:,}}', (SELECT count(*) FROM lineitem)), 7, (SELECT count(*) FROM ({_STRONG_SQL})), (SELECT count(*) FROM ({_outlier_sql('cf', _CF_COLS)}))) AS text"
    ),
)
def q_i07(spark, sf):
    cf = fx.corr_frame(spark, sf)
    return I.executive_summary(I.shape_and_missing(cf), S.strong_correlations(cf), S.outlier_report(cf))


@query(
    "i08_metrics",
    _with(fx.DIRTY_LINEITEM_SQL,
          __import__("tablewise.plans.registry", fromlist=["x"])._CLEANED_LINEITEM_SQL)
    + """SELECT CAST((SELECT count(*) FROM cleaned) AS BIGINT) AS total_rows, CAST(10 AS BIGINT) AS total_columns,
              CAST((SELECT count_if(l_quantity IS NULL) + count_if(l_extendedprice IS NULL) + count_if(l_returnflag IS NULL) FROM dirty) AS BIGINT) AS missing_values_handled,
              CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM cleaned) AS BIGINT) AS duplicates_removed,
              CAST((""" + " + ".join(
        f"""(SELECT count(*) FROM cleaned, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cleaned)
              WHERE q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))"""
        for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "part_txt")
    ) + """) AS BIGINT) AS outliers_detected""",
)
def q_i08(spark, sf):
    from tablewise.plans.registry import cleaned_lineitem

    from tablewise.session import release

    d = fx.dirty_lineitem(spark, sf)
    c = cleaned_lineitem(spark, sf)
    out = I.metrics(d, c)  # one row, computed here
    release(c)
    return out


@query(
    "i09_top_up_recommendations",
    _with(
        f"sp AS ({strong_pairs_sql('events', ['event_id', 'user_id', 'value'])})",
        """recs AS (SELECT 0 AS ord, 'Investigate outlier rows manually before using the data for modelling.' AS text
                   UNION ALL SELECT 2, 'Apply feature scaling (StandardScaler / MinMaxScaler) before ML training.'
                   UNION ALL SELECT 1, printf('Consider using ''%s'' and ''%s'' as features in a predictive model.', col1, col2)
                             FROM (SELECT * FROM sp LIMIT 1))""",
        "n AS (SELECT count(*) AS n FROM recs)",
        """extra AS (SELECT * FROM (VALUES
                     (1000, 'Investigate outlier rows manually before using the data for modelling.'),
                     (1001, 'Apply feature scaling before ML training.'),
                     (1002, 'Consider dimensionality reduction if the feature count is large.')) t(ord, text))""",
    )
    + "SELECT CAST(ord AS INTEGER) AS ord, text FROM recs UNION ALL "
    "SELECT CAST(extra.ord AS INTEGER), extra.text FROM extra, n WHERE n.n < 3 AND extra.ord - 1000 < 5 - n.n",
)
def q_i09(spark, sf):
    ev = fx.table(spark, sf, "events")
    return I.top_up_recommendations(I.recommendations(S.strong_correlations(ev)))


@query(
    "i09_top_up_not_needed",
    _cf_wrap(
        _with(f"sp AS ({strong_pairs_sql('cf', _CF_COLS)})")
        + "SELECT 0 AS ord, 'Investigate outlier rows manually before using the data for modelling.' AS text "
        "UNION ALL SELECT 2, 'Apply feature scaling (StandardScaler / MinMaxScaler) before ML training.' "
        "UNION ALL SELECT 1, printf('Consider using ''%s'' and ''%s'' as features in a predictive model.', col1, col2) FROM (SELECT * FROM sp LIMIT 1)"
    ),
)
def q_i09b(spark, sf):
    return I.top_up_recommendations(I.recommendations(S.strong_correlations(fx.corr_frame(spark, sf))))


_EV_NUM = ["event_id", "user_id", "value"]

_I10_SQL = (
    _with(f"sp AS ({strong_pairs_sql('events', _EV_NUM)})", f"ol AS ({_outlier_sql('events', _EV_NUM)})")
    + "SELECT 0 AS ord, printf('The dataset contains %s rows and %d columns.', format('{:,}', count(*)), 6) AS text FROM events "
    "UNION ALL SELECT 2, printf('Strongest correlation: ''%s'' and ''%s'' (%+.2f, %s).', col1, col2, correlation, strength) "
    "FROM (SELECT * FROM sp LIMIT 1) "
    "UNION ALL SELECT 3, printf('''%s'' has the most outliers (%s%% of values fall outside [%.2f, %.2f]).', column, "
    "CAST(outlier_pct AS VARCHAR), lower_bound, upper_bound) FROM (SELECT * FROM ol ORDER BY outlier_pct DESC LIMIT 1)"
)


@query("i10_analyze_insights", _I10_SQL)
def q_i10(spark, sf):
    return I.analyze(fx.table(spark, sf, "events"))["insights"]


def _i11_sql() -> str:
    from tablewise.plans.catalog_charts import plan_sql

    num = ["event_id", "user_id", "value"]
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    desc = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS column, ROUND(avg({c}), 4) AS mean, ROUND(stddev_samp({c}), 4) AS std, "
        f"ROUND(CAST(min({c}) AS DOUBLE), 4) AS min, ROUND(CAST(max({c}) AS DOUBLE), 4) AS max FROM events"
        for i, c in enumerate(num)
    )
    pos = "CASE column " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(num)) + " END"
    lines = " UNION ALL ".join(
        [
            "SELECT 0 AS o, 'Numerical statistics:' AS t",
            "SELECT 100 + ord, printf('  %s: mean=%.4g, std=%.4g, min=%.4g, max=%.4g', column, mean, std, min, max) FROM dsc",
            "SELECT 200000, 'Correlations:'",
            "SELECT 200000 + row_number() OVER (ORDER BY abs(correlation) DESC, i, j), "
            "printf('  %s ↔ %s: r=%+.2f (%s)', col1, col2, correlation, strength) "
            "FROM (SELECT * FROM sp ORDER BY abs(correlation) DESC, i, j LIMIT 8)",
            "SELECT 300000, 'Outliers:'",
            "SELECT 300000 + row_number() OVER (ORDER BY outlier_pct DESC, pos), "
            "printf('  %s: %d outliers (%s%%)', column, outlier_count, CAST(outlier_pct AS VARCHAR)) "
            f"FROM (SELECT *, {pos} AS pos FROM ol ORDER BY outlier_pct DESC, pos LIMIT 6)",
            "SELECT 400000, 'Trends:'",
            "SELECT 400000 + row_number() OVER (ORDER BY ord), '  • ' || text FROM (SELECT * FROM tr ORDER BY ord LIMIT 5)",
            "SELECT 500000, 'Charts:'",
            "SELECT 500001 + ord, printf('  • Chart %d: ''%s'' - %s', ord + 1, title, '') FROM plan",
        ]
    )
    prefix = plan_sql("events", cols, {"ts"}, set(num), len(num)).rstrip().rstrip("\n")
    return (
        prefix
        + f",\ndsc AS ({desc}),\nsp AS ({strong_pairs_sql('events', num)}),\nol AS ({_outlier_sql('events', num)}),\n"
        + f"tr AS ({_trend_sql('events', num, cols)}),\nlines AS ({lines})\n"
        + "SELECT string_agg(t, chr(10) ORDER BY o) AS text FROM lines"
    )


@query("i11_context_block", _i11_sql())
def q_i11(spark, sf):
    from tablewise.operators import profile as P
    from tablewise.plans.charts import rule_plan

    ev = fx.table(spark, sf, "events")
    corr = S.strong_correlations(ev)
    outl = S.outlier_report(ev)
    return I.context_block(P.describe(ev), corr, outl, I.trends(ev), rule_plan(ev))
