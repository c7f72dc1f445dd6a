"""Registered queries: one per operator of the survey inventory.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql)``.
The oracle SQL runs on DuckDB over the same parquet tables; ``None`` means the
operator is not SQL-expressible and only a rows check applies.  Computed
columns carry the same alias on both sides; doubles are rounded on both
sides after aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewise.plans import fixtures as fx

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


_BARE_COLUMN = re.compile(r"(?<![\w'\"])column(?![\w'\"])")


def _quote_keywords(sql: str) -> str:
    """DuckDB reserves ``column``; quote it wherever it is used as a name."""
    return _BARE_COLUMN.sub('"column"', sql)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, _quote_keywords(sql) if sql else None)
        return fn

    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


def _r(expr: str, nd: int = 4) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {nd})"


def sql_describe(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {_r(f'avg({c})')} AS mean, "
            f"{_r(f'stddev_samp({c})')} AS std, {_r(f'min({c})')} AS min, "
            f"{_r(f'quantile_cont({c}, 0.25)')} AS q25, {_r(f'quantile_cont({c}, 0.5)')} AS q50, "
            f"{_r(f'quantile_cont({c}, 0.75)')} AS q75, {_r(f'max({c})')} AS max FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


def _describe_cols(df: DataFrame) -> DataFrame:
    return df.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


# --- flagship -----------------------------------------------------------------

_CLEANED_LINEITEM_SQL = """
stats AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM dirty),
mode_rf AS (SELECT l_returnflag AS m FROM dirty WHERE l_returnflag IS NOT NULL
            GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag ASC LIMIT 1),
filled AS (
  SELECT DISTINCT l_orderkey, l_linenumber,
         coalesce(l_quantity, (SELECT mq FROM stats)) AS l_quantity,
         coalesce(l_extendedprice, (SELECT mp FROM stats)) AS l_extendedprice,
         l_discount,
         coalesce(l_returnflag, (SELECT m FROM mode_rf)) AS l_returnflag,
         l_linestatus, l_shipdate, part_txt, supp_txt
  FROM dirty),
cleaned AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag,
         l_linestatus, l_shipdate, CAST(part_txt AS BIGINT) AS part_txt, supp_txt
  FROM filled)
"""


def cleaned_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewise.operators.clean import clean

    # written once to the checkpoint folder: its consumers read it in several passes
    return clean(fx.dirty_lineitem(spark, sf_dir), strategy="mean", checkpoint=True)


@query(
    "c12_clean_describe",
    _with(fx.DIRTY_LINEITEM_SQL, _CLEANED_LINEITEM_SQL)
    + sql_describe(
        "cleaned",
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "part_txt"],
    ),
)
def q_clean_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewise.operators.profile import describe
    from tablewise.plans.insights import _local
    from tablewise.session import release

    cleaned = cleaned_lineitem(spark, sf_dir)
    out = _local(_describe_cols(describe(cleaned)))  # one row per column
    release(cleaned)
    return out
from tablewise.plans import catalog_clean  # noqa: E402,F401
from tablewise.plans import catalog_profile  # noqa: E402,F401
from tablewise.plans import catalog_stats  # noqa: E402,F401
from tablewise.plans import catalog_io  # noqa: E402,F401
from tablewise.plans import catalog_enrich  # noqa: E402,F401
from tablewise.plans import catalog_charts  # noqa: E402,F401
from tablewise.plans import catalog_insights  # noqa: E402,F401
from tablewise.plans import catalog_streaming  # noqa: E402,F401
from tablewise.plans import catalog_extended  # noqa: E402,F401
