"""Registered queries: sources (S1-S9), sinks (K1-K6), projections."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.operators import columns as R
from tablewise.operators import enrich as E
from tablewise.operators import profile as P
from tablewise.operators import stats as S
from tablewise.plans import fixtures as fx
from tablewise.plans.catalog_clean import _NAN_EVENTS_SQL, nan_events
from tablewise.plans.registry import _r, _with, query
from tablewise.session import ensure_checkpoint_dir
from tablewise.sources import readers as SR
from tablewise.sources import sinks as SK


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster: ``ensure_checkpoint_dir`` refuses an unset value there)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/exports/{name}-{uuid.uuid4().hex}"


_TOKENS_SQL = """
tok AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, supp_txt FROM dirty)
"""


@query(
    "s01_read_csv_tokens_inference",
    _with(fx.DIRTY_LINEITEM_SQL, _TOKENS_SQL)
    + "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag, supp_txt, 'Missing' AS note FROM tok",
)
def q_s01(spark, sf):
    d = fx.dirty_lineitem(spark, sf)
    # write the dirty view as CSV with several spellings of "missing"
    out = d.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.coalesce(F.col("l_quantity").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("NULL")).otherwise(F.lit("nan"))).alias("l_quantity"),
        F.coalesce(F.col("l_returnflag"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("N/A")).otherwise(F.lit("#N/A"))).alias("l_returnflag"),
        "supp_txt",
        F.lit("Missing").alias("note"),
    )
    path = scratch_path(spark, "s01")
    SK.write_csv(out, path)
    return SR.read_csv(spark, path)


@query(
    "s02_read_csv_latin1_fallback",
    "SELECT doc_id, lang, text FROM documents",
)
def q_s02(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "s02")
    _csv(docs, path, "ISO-8859-1")
    return SR.read_csv(spark, path)


def _csv(df, path: str, encoding: str) -> None:
    df.write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


@query("s02_mixed_encodings_in_one_folder", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '\ufffd €' ELSE text END AS text FROM documents")
def q_s02_mixed(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    path = scratch_path(spark, "s02m")
    even = F.col("doc_id") % 2 == 0
    _csv(docs.filter(even).withColumn("text", F.concat("text", F.lit("\ufffd €"))), f"{path}/utf8", "UTF-8")
    _csv(docs.filter(~even), f"{path}/latin1", "ISO-8859-1")
    return SR.read_csv(spark, [f"{path}/utf8", f"{path}/latin1"])


_S04 = """SELECT n.n_name AS nation, c.c_mktsegment AS segment, count(*) AS orders, sum(o.o_totalprice) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, c.c_mktsegment"""


@query("s04_sql_text_source", f"SELECT nation, segment, CAST(orders AS BIGINT) AS orders, ROUND(revenue, 2) AS revenue FROM ({_S04})")
def q_s04(spark, sf):
    tables = {t: f"{sf}/{t}.parquet" for t in ("orders", "customer", "nation")}
    out = SR.read_sql(spark, _S04, tables)
    return out.select("nation", "segment", "orders", F.round("revenue", 2).alias("revenue"))


@query("s05_json_payload_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_s05(spark, sf):
    return SR.records_from_column(fx.table(spark, sf, "events"), "props", "k bigint", keep=["event_id"])


@query("s05_json_records_files", "SELECT event_id, event_type, value FROM events")
def q_s05b(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    path = scratch_path(spark, "s05")
    SK.write_json(ev, path)
    return SR.read_json_records(spark, path, schema="event_id bigint, event_type string, value double", multiline=False)


@query("s07_read_table_dispatch", "SELECT p_partkey, p_brand, p_size FROM part")
def q_s07(spark, sf):
    return SR.read_table(spark, f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size")


@query("s09_row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 30")
def q_s09(spark, sf):
    return SR.cap_rows(fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 30, ["o_orderkey"])


@query("k01_csv_export", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_k01(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "k01")
    SK.write_csv(o, path)
    return SR.read_csv(spark, path)


@query(
    "k02_json_export",
    _with(_NAN_EVENTS_SQL) + "SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM nan_ev",
)
def q_k02(spark, sf):
    path = scratch_path(spark, "k02")
    SK.write_json(nan_events(spark, sf), path)
    return SR.read_json_records(spark, path, schema="event_id bigint, value double", multiline=False)


@query(
    "k03_two_table_export",
    "SELECT CAST(count(*) AS BIGINT) AS rows, " + _r("sum(o_totalprice)", 2) + " AS total, "
    "(SELECT CAST(count(*) AS BIGINT) FROM (SELECT unnest([corr(o_orderkey, o_custkey), corr(o_orderkey, o_totalprice), corr(o_custkey, o_totalprice)]) AS r) WHERE abs(round(r, 4)) >= 0.3) AS pairs FROM orders",
)
def q_k03(spark, sf):
    o = fx.table(spark, sf, "orders")
    paths = SK.write_tables({"cleaned": C.clean(o), "correlations": S.strong_correlations(o)}, scratch_path(spark, "k03"))
    back = spark.read.parquet(paths["cleaned"])
    pairs = spark.read.parquet(paths["correlations"]).agg(F.count("*").alias("pairs"))
    return back.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).join(F.broadcast(pairs))  # one row each


def _k04_sql() -> str:
    from tablewise.plans.catalog_insights import _I10_SQL, _trend_sql
    from tablewise.plans.catalog_stats import _outlier_sql, strong_pairs_sql

    num = ["event_id", "user_id", "value"]
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    cv = " UNION ALL ".join(
        f"SELECT {i} AS ord, printf('''%s'' shows high variability (CV = %.2f).', '{c}', stddev_samp({c}) / abs(avg({c}))) AS text "
        f"FROM events HAVING stddev_samp({c}) / abs(avg({c})) > 1"
        for i, c in enumerate(num)
    )
    return _with(
        f"sp AS ({strong_pairs_sql('events', num)})",
        f"ol AS ({_outlier_sql('events', num)})",
        f"ins AS ({_I10_SQL})",
        f"tr AS ({_trend_sql('events', num, cols)})",
        f"pat AS ({cv} UNION ALL SELECT 100000 + row_number() OVER (ORDER BY ord) AS ord, text FROM tr QUALIFY row_number() OVER (ORDER BY ord) <= 3)",
        """recs AS (SELECT 0 AS ord, 'Investigate outlier rows manually before using the data for modelling.' AS text
                   UNION ALL SELECT 2, 'Apply feature scaling (StandardScaler / MinMaxScaler) before ML training.'
                   UNION ALL SELECT 1, printf('Consider using ''%s'' and ''%s'' as features in a predictive model.', col1, col2)
                             FROM (SELECT * FROM sp LIMIT 1))""",
        """summ AS (SELECT printf('This dataset (%s rows × %d cols) has been cleaned and analysed. %d significant correlations and %d columns with outliers were identified. See detailed insights and recommendations above.',
                                  format('{:,}', (SELECT count(*) FROM events)), 6, (SELECT count(*) FROM sp), (SELECT count(*) FROM ol)) AS text)""",
    ) + """SELECT 'EXECUTIVE SUMMARY' AS value UNION ALL SELECT text FROM summ
           UNION ALL SELECT 'KEY INSIGHTS' UNION ALL SELECT CAST(row_number() OVER (ORDER BY ord) AS VARCHAR) || '. ' || text FROM ins
           UNION ALL SELECT 'PATTERNS' UNION ALL SELECT '- ' || text FROM pat
           UNION ALL SELECT 'RECOMMENDATIONS' UNION ALL SELECT CAST(row_number() OVER (ORDER BY ord) AS VARCHAR) || '. ' || text FROM recs"""


@query("k04_insights_text_export", _k04_sql())
def q_k04(spark, sf):
    from tablewise.plans.insights import analyze, report_lines

    res = analyze(fx.table(spark, sf, "events"))
    path = scratch_path(spark, "k04")
    SK.write_text_report(report_lines(res), path)
    return spark.read.text(path)


@query(
    "k05_cleaning_summary",
    _with(fx.DIRTY_EVENTS_SQL,
          """modes AS (SELECT event_type AS m FROM dirty_ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
          """c AS (SELECT DISTINCT event_id, ts, user_id, coalesce(event_type, (SELECT m FROM modes)) AS event_type,
                        coalesce(value, (SELECT avg(value) FROM dirty_ev)) AS value FROM dirty_ev)""",
          """b AS (SELECT count(*) AS rows, 5 AS columns, count_if(event_type IS NULL) + count_if(value IS NULL) AS missing,
                        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_ev)) AS duplicates FROM dirty_ev)""",
          """a AS (SELECT count(*) AS rows, 5 AS columns, count_if(event_type IS NULL) + count_if(value IS NULL) AS missing,
                        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS duplicates FROM c)""")
    + """SELECT 'rows' AS metric, CAST(b.rows AS BIGINT) AS before, CAST(a.rows AS BIGINT) AS after FROM a, b
         UNION ALL SELECT 'columns', CAST(b.columns AS BIGINT), CAST(a.columns AS BIGINT) FROM a, b
         UNION ALL SELECT 'missing', CAST(b.missing AS BIGINT), CAST(a.missing AS BIGINT) FROM a, b
         UNION ALL SELECT 'duplicates', CAST(b.duplicates AS BIGINT), CAST(a.duplicates AS BIGINT) FROM a, b""",
)
def q_k05(spark, sf):
    d = fx.dirty_events(spark, sf)
    return P.cleaning_report(d, C.clean(d)).select("metric", "before", "after")


@query(
    "k06_json_safe_values",
    _with(_NAN_EVENTS_SQL) + "SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM nan_ev",
)
def q_k06(spark, sf):
    return SK.json_safe_frame(nan_events(spark, sf))


@query("r01_select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def q_r01(spark, sf):
    return R.select_columns(fx.table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("r02_select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_r02(spark, sf):
    return R.select_kind(fx.table(spark, sf, "orders"), "numeric")


@query(
    "r03_drop_any_null",
    _with(fx.DIRTY_EVENTS_SQL) + "SELECT event_id, user_id, event_type, value FROM dirty_ev WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def q_r03(spark, sf):
    return C.drop_null_rows(fx.dirty_events(spark, sf)).select("event_id", "user_id", "event_type", "value")


@query("r04_drop_null_in_column", _with(fx.DIRTY_EVENTS_SQL) + "SELECT event_id, event_type, value FROM dirty_ev WHERE value IS NOT NULL")
def q_r04(spark, sf):
    return C.drop_null_rows(fx.dirty_events(spark, sf), ["value"]).select("event_id", "event_type", "value")


@query("r06_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def q_r06(spark, sf):
    return R.preview(fx.table(spark, sf, "customer"), ["c_custkey"])


@query("r09_row_gate", "SELECT count(*) <= 500 AS small_enough FROM (SELECT * FROM conversations LIMIT 501)")
def q_r09(spark, sf):
    small = E.row_gate(fx.table(spark, sf, "conversations"))
    return spark.createDataFrame([(small,)], "small_enough boolean")
