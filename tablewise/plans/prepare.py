"""The clean entry end to end: read, clean, enrich or fall back, JSON-safe result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewise.operators.clean import clean
from tablewise.operators.enrich import enrich_or_fallback
from tablewise.operators.profile import cleaning_report
from tablewise.sources.readers import read_table
from tablewise.sources.sinks import json_safe_frame

FALLBACK = "cleaned by rules"


def prepare(
    source: DataFrame | str | Sequence[str],
    strategy: str = "mean",
    fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    schema: T.StructType | str | None = None,
    max_rows: int | None = None,
    spark: SparkSession | None = None,
    **read_options,
) -> dict:
    """Read ``source`` (a frame or a path), clean it, run ``fn`` over it if given.

    Returns ``data`` (JSON-safe frame), ``enhanced`` (whether ``fn`` succeeded on every
    chunk), ``message`` and ``report`` (before / after).  If any chunk fails, or the
    table has more than ``max_rows`` rows when that is set, the rule-cleaned table stays.
    """
    if isinstance(source, DataFrame):
        raw = source
    else:
        raw = read_table(spark or SparkSession.active(), source, **read_options)
    cleaned = clean(raw, strategy=strategy)
    data, enhanced, message = cleaned, False, FALLBACK
    if fn is not None:
        data, enhanced, message = enrich_or_fallback(cleaned, fn, schema, max_rows=max_rows)
    return {"data": json_safe_frame(data), "enhanced": enhanced, "message": message, "report": cleaning_report(raw, cleaned)}
