"""tablewise: table preparation, profiling, statistics, chart data and
insights as Spark DataFrame operators.

The most used entry points are re-exported here; everything else lives in
``tablewise.operators``, ``tablewise.sources``, ``tablewise.plans`` and
``tablewise.streaming``.
"""

from tablewise.operators.clean import clean, dedupe, duplicate_stats, impute, minmax_scale, parse_dates, retype_numeric
from tablewise.operators.profile import (
    categorical_profile,
    cleaning_report,
    column_types,
    describe,
    distinct_counts,
    skew_kurtosis,
    top_values,
    value_counts,
)
from tablewise.operators.quantiles import quantiles
from tablewise.operators.stats import (
    box_stats,
    correlation_pairs,
    histogram,
    outlier_report,
    strong_correlations,
)
from tablewise.plans.charts import rule_plan, visualize
from tablewise.plans.insights import analyze
from tablewise.session import get_spark, materialize, release_materialized
from tablewise.sources.readers import read_csv, read_json_records, read_sql, read_table

__all__ = [
    "analyze", "box_stats", "categorical_profile", "clean", "cleaning_report", "column_types", "correlation_pairs",
    "dedupe", "describe", "distinct_counts", "duplicate_stats", "get_spark", "histogram", "impute", "materialize",
    "minmax_scale", "outlier_report", "parse_dates", "quantiles", "read_csv", "read_json_records", "read_sql",
    "read_table", "release_materialized", "retype_numeric", "rule_plan", "skew_kurtosis", "strong_correlations",
    "top_values", "value_counts", "visualize",
]
