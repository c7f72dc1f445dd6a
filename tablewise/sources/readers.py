"""Sources S1-S9: CSV (with null tokens, encoding fallback and type
inference), JDBC query scan, SQL text over registered tables, JSON records,
in-memory records, dispatch by extension, intake caps.

Every reader returns a DataFrame whose NaNs are already NULL (C1), so all
later operators see one kind of "missing".
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import INTEGER_REGEX, NULL_TOKENS, STRICT_NUMBER_REGEX, nullify_tokens
from tablewise.operators.clean import _c, apply_numeric_plan, nan_to_null_all
from tablewise.sources.csv_records import quoted_records

# Text read as booleans by the CSV loader.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
BOM = "﻿"


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0] if df.columns else None
    if first and first.startswith(BOM):
        return df.withColumnRenamed(first, first[len(BOM):])
    return df


def _raw_csv(spark: SparkSession, path: str | Sequence[str], encoding: str, multiline: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
    )
    return _strip_bom(reader.csv(path if isinstance(path, str) else list(path)))


def _broken_lines(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Does a quoted cell go on over a line break?  Then some line holds an odd number of
    quotes (an escaped quote counts twice).  One scan of the raw lines."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.option("encoding", "ISO-8859-1").text(path if isinstance(path, str) else list(path))
    return not lines.filter(quotes % 2 == 1).isEmpty()


#: Column that names a record's file when records are cut from lines.
_SOURCE = "__source_file"
#: Encodings whose line feeds and quotes are single bytes.
_BYTE_ENCODINGS = ("ISO-8859-1", "UTF-8", "US-ASCII", "LATIN1", "LATIN-1", "UTF8")


def _cut_csv(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame | None:
    """Files with quoted line breaks as text columns plus ``_SOURCE``, read by many tasks. None where a carriage
    return stands alone (a break of its own, or a character of a cell): such files are read whole."""
    if encoding.upper() not in _BYTE_ENCODINGS:
        return None
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    if not lines.where(F.col("value").rlike("\r.")).isEmpty():
        return None
    names = [n.removesuffix("\r") for n in _raw_csv(spark, path, encoding, True).columns]  # reads the first header only
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    records = quoted_records(spark, path)
    text = F.make_valid_utf8(F.col("record").cast("string")) if encoding.upper() in ("UTF-8", "UTF8") else F.decode("record", "ISO-8859-1")
    row = F.from_csv(text, cells, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.select(row.alias("r"), F.col("file").alias(_SOURCE)).select("r.*", _SOURCE).toDF(*names, _SOURCE)


def _text_of(c: Column, utf8: Column) -> Column:
    """A cell read as ISO-8859-1 (which keeps every byte) in its file's real encoding."""
    return F.when(utf8, F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def _by_file_encoding(raw: DataFrame) -> DataFrame:
    """Decode each file by itself: UTF-8 where all its bytes are valid UTF-8, else Latin-1.

    ``raw`` was read as ISO-8859-1.  One aggregate lists the files that are not UTF-8; a
    folder whose files are all UTF-8 (or all not) needs no list.
    """
    cells = F.concat_ws("\n", *[_c(n) for n in raw.columns if n != _SOURCE])
    valid = F.is_valid_utf8(F.encode(cells, "ISO-8859-1").cast("string"))
    file = F.col(_SOURCE) if _SOURCE in raw.columns else F.col("_metadata.file_path")
    flagged = raw.select(file.alias("f"), valid.alias("v")).groupBy("f").agg(F.bool_and("v").alias("v"))
    n = flagged.agg(F.count_if("v").alias("good"), F.count_if(~F.col("v")).alias("bad")).first()
    if not n["bad"]:
        utf8 = F.lit(True)
    elif not n["good"]:
        utf8 = F.lit(False)
    else:
        files = flagged.filter(~F.col("v")).select(F.col("f").alias("__file"), F.lit(True).alias("__latin1"))
        raw = raw.withColumn("__file", file).join(files, "__file", "left")
        utf8 = F.col("__latin1").isNull()
    names = [c for c in raw.columns if c not in ("__file", "__latin1", _SOURCE)]
    return raw.select(*[_text_of(_c(c), utf8).alias(c) for c in names])


def _inference_aggs(df: DataFrame, text: Sequence[str]) -> list:
    """Every per-column check of type inference, for ONE aggregate."""
    toks = TRUE_TOKENS + FALSE_TOKENS
    aggs = []
    for i, n in enumerate(text):
        c = _c(n)
        blank = c.isNull() | (F.trim(c) == "")
        aggs += [
            F.count(c).alias(f"nn_{i}"),
            F.count_if(~blank & ~c.rlike(STRICT_NUMBER_REGEX)).alias(f"bad_{i}"),
            F.count_if(blank | ~c.rlike(INTEGER_REGEX) | F.trim(c).try_cast("bigint").isNull()).alias(f"nonint_{i}"),
            F.count_if(c.isNotNull() & ~c.isin(toks)).alias(f"nonbool_{i}"),
        ]
    return aggs


def _plan_from_row(row, text: Sequence[str]) -> tuple[dict[str, str], list[str], list[str]]:
    numeric: dict[str, str] = {}
    empty: list[str] = []
    bools: list[str] = []
    for i, n in enumerate(text):
        if row[f"nn_{i}"] == 0:
            empty.append(n)
        elif row[f"bad_{i}"] == 0:
            numeric[n] = "bigint" if row[f"nonint_{i}"] == 0 else "double"
        elif row[f"nonbool_{i}"] == 0:
            bools.append(n)
    return numeric, empty, bools


def _apply_inference(df: DataFrame, numeric: dict[str, str], empty: list[str], bools: list[str]) -> DataFrame:
    out = apply_numeric_plan(df, numeric)
    sel = []
    for n in out.columns:
        if n in empty:
            sel.append(F.lit(None).cast("double").alias(n))
        elif n in bools:
            sel.append(F.when(_c(n).isin(TRUE_TOKENS), True).when(_c(n).isin(FALSE_TOKENS), False).alias(n))
        else:
            sel.append(_c(n))
    return out.select(*sel)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns -> bigint / double / boolean when every value allows it
    (the whole column or not at all); an all-null column becomes double.
    One aggregate decides every column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [n for n, t in types.items() if isinstance(t, T.StringType)]
    if not text:
        return df
    row = df.agg(*_inference_aggs(df, text)).first()
    return _apply_inference(df, *_plan_from_row(row, text))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    null_tokens: Sequence[str] | None = None,
    encoding: str | None = None,
    infer: bool = True,
    multiline: bool | None = None,
) -> DataFrame:
    """S1 + S2: CSV with header; the 18 default null tokens and the empty cell
    become NULL; types inferred per whole column; each file is UTF-8 if its bytes are
    valid UTF-8 and ISO-8859-1 otherwise (one bad file does not touch the others, and
    a valid U+FFFD is kept).

    Quoted line breaks are kept: with ``multiline=None`` one scan of the raw lines
    looks for an open quote, and only then are records cut by ``quoted_records``, whose tasks share
    a large file like any other (files with single carriage returns are read as a whole).  ``True`` reads
    whole files, ``False`` lines as records, both without that scan.  An explicit ``encoding`` skips the encoding check.
    """
    toks = list(NULL_TOKENS if null_tokens is None else null_tokens)
    raw = None
    if multiline is None:
        multiline = _broken_lines(spark, path)
        raw = _cut_csv(spark, path, encoding or "ISO-8859-1") if multiline else None
    if raw is None:
        raw = _raw_csv(spark, path, encoding or "ISO-8859-1", multiline)
    elif encoding is not None:
        raw = _strip_bom(raw.drop(_SOURCE))
    if not raw.columns:
        return raw
    if encoding is None:
        names = [n.encode("ISO-8859-1") for n in raw.columns if n != _SOURCE]
        raw = _by_file_encoding(raw)
        try:
            raw = raw.toDF(*[n.decode("UTF-8").removeprefix(BOM) for n in names])
        except UnicodeDecodeError:
            pass
    clean = raw.select(*[nullify_tokens(_c(n), toks).alias(n) for n in raw.columns])
    if not infer:
        return clean
    text = list(clean.columns)
    row = clean.agg(*_inference_aggs(clean, text)).first()
    return _apply_inference(clean, *_plan_from_row(row, text))


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10000,
) -> dict[str, str]:
    """S3: options for ``spark.read.format('jdbc')``.

    ``query`` pushes arbitrary SQL to the database (one task); a ``table``
    with ``partition_column`` + bounds + ``num_partitions`` reads in parallel
    ranges.  Credentials are arguments, never constants.
    """
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query / table")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if query is not None:
        if partition_column:
            raise ValueError("partitioned reads need table=, not query=")
        opts["query"] = query
    else:
        opts["dbtable"] = table
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(
            partitionColumn=partition_column, lowerBound=str(lower_bound), upperBound=str(upper_bound), numPartitions=str(num_partitions)
        )
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    return opts


def read_jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    """S3: database query scan (needs the JDBC driver jar on the classpath)."""
    return nan_to_null_all(spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load())


def read_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame | str] | None = None) -> DataFrame:
    """Run a SELECT over registered tables (DataFrames or parquet paths)."""
    given = {name: spark.read.parquet(src) if isinstance(src, str) else src for name, src in (tables or {}).items()}
    before = {name: spark.table(name) for name in given if _is_temp_view(spark, name)}
    try:
        for name, df in given.items():
            df.createOrReplaceTempView(name)
        return nan_to_null_all(spark.sql(query))  # resolved here: the views are not needed afterwards
    finally:
        for name in given:  # the caller's views of the same names come back
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _is_temp_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary


def read_json_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """JSON array-of-objects payload files (``multiline``) or JSON lines."""
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null_all(reader.json(path if isinstance(path, str) else list(path)))


def records_from_column(df: DataFrame, col: str, schema: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON payload already in a text column -> rows (array or object)."""
    elem = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    body = F.trim(_c(col))
    as_array = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return df.select(*[_c(k) for k in keep], F.inline_outer(F.from_json(as_array, T.ArrayType(elem))))


def from_records(spark: SparkSession, records: Sequence[Mapping], schema: T.StructType | str | None = None) -> DataFrame:
    """In-memory records (small, already on the driver) -> DataFrame."""
    return nan_to_null_all(spark.createDataFrame(list(records), schema))


SUPPORTED = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **kwargs) -> DataFrame:
    """Choose the reader by extension (or ``fmt``); others raise ValueError."""
    kind = fmt or SUPPORTED.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind == "csv":
        return read_csv(spark, path, **kwargs)
    if kind == "json":
        return read_json_records(spark, path, **kwargs)
    if kind == "parquet":
        return nan_to_null_all(spark.read.parquet(path))
    raise ValueError(f"unsupported file type for {path!r}; use CSV, JSON or Parquet")


def cap_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows under an explicit order (top-k, no full sort)."""
    return df.orderBy(*[_c(c) for c in order_by]).limit(n)


def cut_text(df: DataFrame, col: str, width: int = 100) -> DataFrame:
    """Cut a text column to ``width`` characters (intake option)."""
    return df.withColumn(col, F.substring(_c(col), 1, width))
