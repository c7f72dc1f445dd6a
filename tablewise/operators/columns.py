"""Projections and previews R1, R2, R6 (R3/R4 live in ``clean``, R5 in
``stats``, R7 in ``profile``, R8 in ``plans.charts``, R9 in ``enrich``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewise.functions.exprs import non_numeric_columns, numeric_columns
from tablewise.operators.clean import _c


def select_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The chosen columns; an empty choice means all columns."""
    if not cols:
        return df
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*[_c(c) for c in cols])


def select_kind(df: DataFrame, kind: str = "numeric") -> DataFrame:
    """R2: numeric or non-numeric columns (bool/dates/text are non-numeric)."""
    if kind == "numeric":
        return df.select(*[_c(c) for c in numeric_columns(df)])
    if kind == "non_numeric":
        return df.select(*[_c(c) for c in non_numeric_columns(df)])
    raise ValueError("kind must be 'numeric' or 'non_numeric'")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows under an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*[_c(c) for c in order_by]).limit(n)
