"""Scalar column expressions shared by every operator.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage codegen and works on batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "NULL_TOKENS",
    "DATE_FORMATS",
    "DATE_SHAPES",
    "STRICT_NUMBER_REGEX",
    "INTEGER_REGEX",
    "PUNCTUATION_MAP",
    "MONTH_ABBR",
    "is_numeric_type",
    "is_scalar_type",
    "numeric_columns",
    "non_numeric_columns",
    "nan_to_null",
    "nullify_tokens",
    "strict_number",
    "standardize_text",
    "latin1_safe",
    "json_safe",
    "safe_corr",
    "corrected_skewness",
    "corrected_kurtosis",
    "strength_label",
    "quote_ident",
    "general_number",
]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results)
# ---------------------------------------------------------------------------

# Text cells read as missing by the CSV loader (the pandas default list), plus
# the empty cell. "Missing", "-" and "na" are ordinary values.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Text date formats accepted when probing a text column for dates.  A column
# is a date column only if every non-null value parses under ONE format.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd MMM yyyy",
]
# Necessary text shapes of the formats above, same order (a cheap screen
# before the real parse).
DATE_SHAPES = [
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2} [A-Za-z]{3,} \d{4}$",
]

# A cell counts as a number only if it matches this (case-insensitive):
# optional blanks, sign, digits with optional fraction and exponent, or
# inf / infinity / nan.  Spark's own cast alone is too lenient ('1d' -> 1.0).
STRICT_NUMBER_REGEX = (
    r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
)
INTEGER_REGEX = r"^\s*[+-]?\d+\s*$"

# Latin-1-safe export text: 1:1 and 1:n replacements, then any other
# character outside Latin-1 becomes '?'.
PUNCTUATION_MAP = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "—": "-",
    "–": "-",
    "•": "-",
    "₠": "EUR",
    "€": "EUR",
    "™": "TM",
}

MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Correlation strength bands on |r| (rounded to 4): strong, moderate, else weak.
STRONG_R = 0.7
MODERATE_R = 0.5

# ---------------------------------------------------------------------------
# Schema helpers
# ---------------------------------------------------------------------------

_COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the reference's sense: a number type, never bool/date/text."""
    return isinstance(dt, T.NumericType)


def is_scalar_type(dt: T.DataType) -> bool:
    return not isinstance(dt, _COMPLEX) and not isinstance(dt, T.BinaryType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------------------
# Cell-level expressions
# ---------------------------------------------------------------------------


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    """NaN is missing (pandas semantics); Spark keeps NaN apart from NULL."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def nullify_tokens(c: Column, tokens: list[str] | None = None) -> Column:
    """Text cell equal to one of the null tokens (exact, case-sensitive) -> NULL."""
    toks = NULL_TOKENS if tokens is None else tokens
    return F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)


def strict_number(c: Column) -> Column:
    """Text -> double, NULL when the text is not a strict number (blank -> NULL)."""
    return F.when(c.rlike(STRICT_NUMBER_REGEX), F.trim(c).try_cast("double"))


def standardize_text(c: Column, case: str | None = None) -> Column:
    """Trim, collapse inner whitespace, optional case (lower / upper / title)."""
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    if case is None or case == "keep":
        return out
    if case == "lower":
        return F.lower(out)
    if case == "upper":
        return F.upper(out)
    if case == "title":
        return F.initcap(out)
    raise ValueError(f"unknown case {case!r}")


def latin1_safe(c: Column) -> Column:
    """Smart punctuation -> Latin-1 text; other non-Latin-1 characters -> '?'."""
    out = c
    one_to_one = {k: v for k, v in PUNCTUATION_MAP.items() if len(v) == 1}
    out = F.translate(out, "".join(one_to_one), "".join(one_to_one.values()))
    for k, v in PUNCTUATION_MAP.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"[^\x00-\xFF]", "?")


def json_safe(c: Column, dt: T.DataType) -> Column:
    """NaN / +-Infinity -> NULL, recursively through arrays and structs."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(dt)).otherwise(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _k, v: json_safe(v, dt.valueType))
    return c


# ---------------------------------------------------------------------------
# Aggregate expressions
# ---------------------------------------------------------------------------


def safe_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r that never raises under ANSI mode.

    NULL for constant, pairwise-constant and single-row input; equal to
    ``corr`` otherwise.  (``corr`` itself raises DIVIDE_BY_ZERO on a constant.)
    """
    both = a.isNotNull() & b.isNotNull()
    a2 = F.when(both, a)
    b2 = F.when(both, b)
    return F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``); 0.0 for a constant."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    var = F.var_pop(c)
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(var == 0, F.lit(0.0))
        .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))
    )


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurtosis``); 0.0 for a constant."""
    n = F.count(c).cast("double")
    k = F.kurtosis(c)
    var = F.var_pop(c)
    return (
        F.when(n < 4, F.lit(None).cast("double"))
        .when(var == 0, F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    )


def strength_label(r: Column) -> Column:
    """Band on |r| (>=0.7 strong, >=0.5 moderate, else weak) and sign by r > 0."""
    a = F.abs(r)
    band = F.when(a >= STRONG_R, "strong").when(a >= MODERATE_R, "moderate").otherwise("weak")
    sign = F.when(r > 0, "positive").otherwise("negative")
    return F.concat_ws(" ", band, sign)


def general_number(c: Column, digits: int = 4) -> Column:
    """``%.<digits>g`` text without trailing zeros (Python / C style); Java's
    ``%g`` keeps them ("25.40" -> "25.4", "100.0" -> "100")."""
    g = F.format_string(f"%.{digits}g", c)
    g = F.regexp_replace(g, r"^([-+]?\d+\.\d*?)0+(e[-+]\d+)?$", "$1$2")
    return F.regexp_replace(g, r"^([-+]?\d+)\.(e[-+]\d+)?$", "$1$2")
