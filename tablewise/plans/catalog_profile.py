"""Registered queries: profiling (P1-P15) and basic aggregates (A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators import profile as P
from tablewise.plans import fixtures as fx
from tablewise.plans.registry import _CLEANED_LINEITEM_SQL, _describe_cols, _r, _with, query, sql_describe

_D = fx.DIRTY_LINEITEM_SQL
_DIRTY_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
               "l_linestatus", "l_shipdate", "part_txt", "supp_txt"]
_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORD_TXT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@query("p01_shape", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def q_p01(spark, sf):
    return P.shape(fx.table(spark, sf, "lineitem"))


@query(
    "p02_missing_total",
    _with(_D) + "SELECT CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in _DIRTY_COLS) + " AS BIGINT) AS missing FROM dirty",
)
def q_p02(spark, sf):
    return P.missing_total(fx.dirty_lineitem(spark, sf))


@query(
    "p03_missing_per_column",
    _with(_D)
    + "SELECT column, missing FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM dirty" for c in _DIRTY_COLS)
    + ") WHERE missing > 0",
)
def q_p03(spark, sf):
    return P.missing_per_column(fx.dirty_lineitem(spark, sf)).select("column", "missing")


def _stats_sql(src: str, cols: list[str]) -> str:
    miss = " + ".join(f"count_if({c} IS NULL)" for c in cols)
    return (
        f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST({len(cols)} AS BIGINT) AS columns, CAST({miss} AS BIGINT) AS missing, "
        f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicates FROM {src}"
    )


@query(
    "p04_cleaning_report",
    _with(_D, _CLEANED_LINEITEM_SQL, f"b AS ({_stats_sql('dirty', _DIRTY_COLS)})", f"a AS ({_stats_sql('cleaned', _DIRTY_COLS)})")
    + """SELECT 'rows' AS metric, b.rows AS before, a.rows AS after FROM a, b
         UNION ALL SELECT 'columns', b.columns, a.columns FROM a, b
         UNION ALL SELECT 'missing', b.missing, a.missing FROM a, b
         UNION ALL SELECT 'duplicates', b.duplicates, a.duplicates FROM a, b""",
)
def q_p04(spark, sf):
    from tablewise.plans.registry import cleaned_lineitem
    from tablewise.session import release

    cleaned = cleaned_lineitem(spark, sf)
    out = P.cleaning_report(fx.dirty_lineitem(spark, sf), cleaned).select("metric", "before", "after")  # four rows, computed here
    release(cleaned)
    return out


def _types_sql(src: str, cols: list[str], dt: set[str], num: set[str]) -> str:
    parts = []
    for c in cols:
        is_dt = "TRUE" if c in dt else "FALSE"
        is_num = "TRUE" if c in num else "FALSE"
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_, "
            f"CAST(count(*) AS BIGINT) AS n_rows, {is_dt} AS is_dt, {is_num} AS is_num FROM {src}"
        )
    inner = " UNION ALL ".join(parts)
    return (
        "SELECT column, CASE WHEN is_dt THEN 'datetime' WHEN unique_ = 2 THEN 'boolean' WHEN is_num THEN 'numerical' "
        "WHEN unique_ / greatest(n_rows, 1) > 0.5 OR unique_ > 50 THEN 'high_cardinality' ELSE 'categorical' END AS type, "
        f"non_null, unique_ AS \"unique\" FROM ({inner})"
    )


@query("p05_column_types", _types_sql("lineitem", _LI_COLS, {"l_shipdate"}, set(_LI_NUM)))
def q_p05(spark, sf):
    return P.column_types(fx.table(spark, sf, "lineitem")).select("column", "type", "non_null", "unique")


@query(
    "p05_column_types_customer",
    _types_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], set(),
               {"c_custkey", "c_nationkey", "c_acctbal"}),
)
def q_p05b(spark, sf):
    return P.column_types(fx.table(spark, sf, "customer")).select("column", "type", "non_null", "unique")


_CUST = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query(
    "p06_column_catalog",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM customer"
        for c, t in _CUST
    ),
)
def q_p06(spark, sf):
    return P.column_catalog(fx.table(spark, sf, "customer")).select("column", "dtype", "non_null", "nulls", "unique")


@query("p07_describe_events", sql_describe("events", ["event_id", "user_id", "value"]))
def q_p07(spark, sf):
    return _describe_cols(P.describe(fx.table(spark, sf, "events")))


@query("p07_describe_documents", sql_describe("documents", ["doc_id", "n_chars"]))
def q_p07b(spark, sf):
    return _describe_cols(P.describe(fx.table(spark, sf, "documents")))


def _moments_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, {_r(f'skewness({c})')} AS skewness, {_r(f'kurtosis({c})')} AS kurtosis FROM {src}" for c in cols
    )


@query("p08_p09_skew_kurtosis", _moments_sql("events", ["event_id", "user_id", "value"]))
def q_p08(spark, sf):
    return P.skew_kurtosis(fx.table(spark, sf, "events")).select("column", "skewness", "kurtosis")


@query("p08_p09_skew_kurtosis_documents", _moments_sql("documents", ["doc_id", "n_chars"]))
def q_p08b(spark, sf):
    return P.skew_kurtosis(fx.table(spark, sf, "documents")).select("column", "skewness", "kurtosis")


def _vc_long_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count "
        f"FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols
    )


@query(
    "p10_categorical_profile",
    _with(f"vc AS ({_vc_long_sql('orders', _ORD_TXT)})")
    + """SELECT column, CAST(count(*) AS BIGINT) AS "unique",
                arg_min(value, (-count, value)) AS top_value, CAST(max(count) AS BIGINT) AS top_count
         FROM vc GROUP BY column""",
)
def q_p10(spark, sf):
    return P.categorical_profile(fx.table(spark, sf, "orders")).select("column", "unique", "top_value", "top_count")


def _topk_sql(src: str, cols: list[str], k: int, width: int | None = None) -> str:
    val = "value" if width is None else f"substr(value, 1, {width})"
    return (
        _with(f"vc AS ({_vc_long_sql(src, cols)})")
        + f"SELECT column, CAST(rank AS INTEGER) AS rank, {val} AS value, count FROM ("
        "SELECT column, value, count, row_number() OVER (PARTITION BY column ORDER BY count DESC, value ASC) AS rank FROM vc"
        f") WHERE rank <= {k}"
    )


@query("p11_top20_values", _topk_sql("orders", _ORD_TXT, 20))
def q_p11(spark, sf):
    return P.top_values(fx.table(spark, sf, "orders"), _ORD_TXT, k=20)


@query(
    "p12_planning_metadata",
    _with(f"t AS ({_types_sql('orders', _ORD_COLS, {'o_orderdate'}, {'o_orderkey', 'o_custkey', 'o_totalprice'})})",
          """num AS (SELECT 'o_orderkey' AS column, CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, avg(o_orderkey) AS mean FROM orders
                UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), avg(o_custkey) FROM orders
                UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice), avg(o_totalprice) FROM orders)""",
          """sv AS (SELECT column, string_agg(value, '|' ORDER BY value) AS samples FROM (
                 SELECT column, value, row_number() OVER (PARTITION BY column ORDER BY value) AS rn FROM (
                   SELECT DISTINCT 'o_orderstatus' AS column, substr(o_orderstatus, 1, 20) AS value FROM orders
                   UNION ALL SELECT DISTINCT 'o_orderpriority', substr(o_orderpriority, 1, 20) FROM orders)) WHERE rn <= 2
                 GROUP BY column)""")
    + """SELECT t.column, t.type, t.non_null, t."unique", ROUND(num.min, 4) AS min, ROUND(num.max, 4) AS max,
                ROUND(num.mean, 4) AS mean, sv.samples
         FROM t LEFT JOIN num ON t.column = num.column AND t.type = 'numerical'
                LEFT JOIN sv ON t.column = sv.column AND t.type = 'categorical'
         WHERE t.type <> 'high_cardinality'""",
)
def q_p12(spark, sf):
    m = P.planning_metadata(fx.table(spark, sf, "orders"))
    return m.select(
        "column", "type", "non_null", "unique", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
        F.round("mean", 4).alias("mean"), F.array_join("sample_values", "|").alias("samples"),
    )


@query(
    "p13_statistical_summary_numerical",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS std, "
        f"{_r(f'min({c})')} AS min, {_r(f'quantile_cont({c}, 0.25)')} AS q25, {_r(f'quantile_cont({c}, 0.5)')} AS q50, "
        f"{_r(f'quantile_cont({c}, 0.75)')} AS q75, {_r(f'max({c})')} AS max, {_r(f'skewness({c})')} AS skewness, "
        f"{_r(f'kurtosis({c})')} AS kurtosis FROM events"
        for c in ["event_id", "user_id", "value"]
    ),
)
def q_p13(spark, sf):
    s = P.statistical_summary(fx.table(spark, sf, "events"))
    return s["numerical"].drop("ord")


@query("p14_compact_summary_table", _with(_D) + _stats_sql("dirty", _DIRTY_COLS))
def q_p14(spark, sf):
    return P.compact_summary(fx.dirty_lineitem(spark, sf))["table"]


@query(
    "p15_type_counts",
    _with(f"t AS ({_types_sql('lineitem', _LI_COLS, {'l_shipdate'}, set(_LI_NUM))})")
    + "SELECT type, CAST(count(*) AS BIGINT) AS columns FROM t GROUP BY type",
)
def q_p15(spark, sf):
    return P.type_counts(P.column_types(fx.table(spark, sf, "lineitem"), counts=False))


@query(
    "a01_scalar_aggregates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, {_r(f'sum({c})')} AS sum, {_r(f'avg({c})')} AS mean, "
        f"{_r(f'median({c})')} AS median, {_r(f'min({c})')} AS min, {_r(f'max({c})')} AS max FROM lineitem"
        for c in _LI_NUM
    ),
)
def q_a01(spark, sf):
    s = P.scalar_aggregates(fx.table(spark, sf, "lineitem"))
    return s.select("column", "count", *[F.round(c, 4).alias(c) for c in ("sum", "mean", "median", "min", "max")])


@query(
    "a02_distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM orders" for c in _ORD_COLS),
)
def q_a02(spark, sf):
    return P.distinct_counts(fx.table(spark, sf, "orders")).select("column", "unique")


@query(
    "a03_value_counts",
    "SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1",
)
def q_a03(spark, sf):
    return P.value_counts(fx.table(spark, sf, "orders"), "o_orderpriority")


@query("r07_sample_values",
       "SELECT column, CAST(rank AS INTEGER) AS rank, value FROM (SELECT column, value, row_number() OVER (PARTITION BY column ORDER BY value) AS rank FROM ("
       "SELECT DISTINCT 'c_mktsegment' AS column, substr(c_mktsegment, 1, 20) AS value FROM customer "
       "UNION ALL SELECT DISTINCT 'c_name', substr(c_name, 1, 20) FROM customer)) WHERE rank <= 2")
def q_r07(spark, sf):
    return P.sample_values(fx.table(spark, sf, "customer"), ["c_mktsegment", "c_name"]).select("column", "rank", "value")


@query(
    "p13_statistical_summary_categorical",
    _with(f"vc AS ({_vc_long_sql('orders', _ORD_TXT)})")
    + """SELECT column, CAST(count(*) AS BIGINT) AS "unique",
                arg_min(value, (-count, value)) AS top_value, CAST(max(count) AS BIGINT) AS top_count
         FROM vc GROUP BY column""",
)
def q_p13c(spark, sf):
    s = P.statistical_summary(fx.table(spark, sf, "orders"))
    return s["categorical"].select("column", "unique", "top_value", "top_count")


@query("p13_statistical_summary_value_counts", _topk_sql("orders", _ORD_TXT, 20))
def q_p13v(spark, sf):
    return P.statistical_summary(fx.table(spark, sf, "orders"))["value_counts"]


@query(
    "p14_compact_summary_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS std, "
        f"{_r(f'min({c})')} AS min, {_r(f'quantile_cont({c}, 0.25)')} AS q25, {_r(f'quantile_cont({c}, 0.5)')} AS q50, "
        f"{_r(f'quantile_cont({c}, 0.75)')} AS q75, {_r(f'max({c})')} AS max FROM orders"
        for c in ["o_orderkey", "o_custkey", "o_totalprice"]
    ),
)
def q_p14d(spark, sf):
    return P.compact_summary(fx.table(spark, sf, "orders"))["numerical"].drop("ord")


@query(
    "p09_kurtosis",
    " UNION ALL ".join(f"SELECT '{c}' AS column, {_r(f'kurtosis({c})')} AS kurtosis FROM documents" for c in ["doc_id", "n_chars"]),
)
def q_p09(spark, sf):
    return P.skew_kurtosis(fx.table(spark, sf, "documents")).select("column", "kurtosis")
