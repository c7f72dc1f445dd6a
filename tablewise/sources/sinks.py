"""Sinks K1-K6: CSV / JSON export, two-table export, insights text, JSON-safe
values.  Writers are distributed (one file per partition); nothing is
collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import json_safe
from tablewise.operators.clean import _c


def json_safe_frame(df: DataFrame) -> DataFrame:
    """K6: NaN / +-Infinity -> NULL in every float column, also nested."""
    return df.select(*[json_safe(_c(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K1: CSV with a header row, no index column.  Array / map / struct
    columns (which CSV cannot hold) are written as JSON text."""
    flat = df.select(
        *[
            F.to_json(_c(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else _c(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K2: JSON records (one object per line; NaN/Inf written as null)."""
    json_safe_frame(df).write.mode(mode).json(path)
    return path


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """K3: several tables (e.g. cleaned + correlations) as Parquet folders."""
    out = {}
    for name, df in tables.items():
        p = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(p)
        out[name] = p
    return out


def write_text_report(lines: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K4: a (section, ord, text) frame as one ordered text file."""
    ordered = lines.orderBy("section_ord", "ord").select(F.col("text").alias("value"))
    ordered.coalesce(1).write.mode(mode).text(path)
    return path
