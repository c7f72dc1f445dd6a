"""Distinct counts by sketches, top values by hashed counts, duplicates by digest: exact at every threshold."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewise.operators import clean as C
from tablewise.operators import profile as P


@pytest.mark.parametrize("n", [P.EXACT_BELOW - 1, P.EXACT_BELOW, P.EXACT_BELOW + 1, 3 * P.EXACT_BELOW])
def test_counts_around_the_sketch_size(spark, n):
    rows = 3 * P.EXACT_BELOW + 7
    df = spark.range(0, rows, 1, 6).select(
        (F.col("id") % n).alias("a"), (F.col("id") % n).cast("string").alias("t"), (F.col("id") % 2).alias("two"), (F.col("id") % 50).cast("string").alias("fifty"),
        (F.col("id") % 51).cast("string").alias("more"), F.when(F.col("id") > 5, "").alias("empty"), F.lit(None).cast("string").alias("none"), (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"), (F.col("id") % n).cast("decimal(30,2)").alias("dec"),
    )
    got = {r["column"]: r for r in P.column_types(df).collect()}
    assert {c: r["unique"] for c, r in got.items()} == {"a": n, "t": n, "two": 2, "fifty": 50, "more": 51, "empty": 1, "none": 0, "flag": 2, "zero": 1, "dec": n}
    kinds = {c: r["type"] for c, r in got.items()}
    assert kinds["fifty"] == kinds["none"] == kinds["empty"] == "categorical" and kinds["more"] == kinds["t"] == "high_cardinality" and kinds["two"] == kinds["flag"] == "boolean"
    assert kinds == {r["column"]: r["type"] for r in P.column_types(df, counts=False).collect()}
    assert {r["column"]: r["unique"] for r in P.column_catalog(df).collect()} == {c: r["unique"] for c, r in got.items()}


def test_text_is_high_cardinality_from_half_the_rows(spark):
    for rows, distinct, kind in ((20, 10, "categorical"), (20, 11, "high_cardinality"), (200, 50, "categorical"), (90, 46, "high_cardinality")):
        df = spark.range(rows).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("t"))
        assert P.column_types(df).first()["type"] == kind


HEAD = "the same beginning of very many long texts " * 3


def plain_top(values, k):
    return [(v, n) for v, n in sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))][:k]


@pytest.mark.parametrize("cap", [C.MAX_TOP_ROWS, 3])
def test_long_texts_with_ties(spark, monkeypatch, cap):
    monkeypatch.setattr(C, "MAX_TOP_ROWS", cap)
    alike = [HEAD + str(k % 70) for k in range(140)]  # ties that only the whole text tells apart
    mixed = [HEAD[: C.HEAD_CHARS], *[HEAD + "x"] * 3, *["short"] * 3, *["Ä" * 80] * 5, None, "", *["b" * 64] * 2, *["b" * 65] * 2]
    frame = spark.createDataFrame([(a, mixed[i] if i < len(mixed) else None, i % 3) for i, a in enumerate(alike)], "alike string, mixed string, n int").repartition(5)
    got = {}
    for r in P.top_values(frame, k=6).orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append((r["value"], r["count"]))
    assert got["alike"] == plain_top(alike, 6) and got["mixed"] == plain_top(mixed, 6)
    prof = {r["column"]: r for r in P.categorical_profile(frame).collect()}
    assert prof["alike"]["unique"] == 70 and (prof["alike"]["top_value"], prof["alike"]["top_count"]) == plain_top(alike, 1)[0]
    assert prof["mixed"]["top_value"] == "Ä" * 80
    assert C.modes(frame, ["alike", "mixed"]) == {"alike": plain_top(alike, 1)[0][0], "mixed": "Ä" * 80}


def test_whole_texts_are_not_shuffled(spark):
    df = spark.range(100).select(F.concat(F.lit("x" * 500), F.col("id")).alias("t"))
    keyed, _names, _cells = C._keyed_counts(df, ["t"])
    widest = keyed.agg(F.max(F.octet_length("value"))).first()[0]
    assert widest <= 4 * C.HEAD_CHARS and keyed.count() == 100


def test_duplicates_by_digest(spark):
    rows = [(1, "a", None, 0.0, [1, None]), (1, "a", None, -0.0, [1, None]), (1, None, "a", 0.0, [1]), (1, "a", None, 0.0, [None, 1]), (None, "1", "a", 0.0, []), (None, "1", "a", 0.0, None)]
    df = spark.createDataFrame(rows * 2, "i int, s string, t string, d double, l array<int>")
    assert tuple(C.duplicate_stats(df).first()) == (12, 5, 7)
    assert C.dedupe(df).count() == 5
    assert tuple(C.duplicate_stats(df.limit(0)).first()) == (0, 0, 0)
    plan = C.duplicate_stats(df.drop("l"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_groupingexpression" in plan and "hashpartitioning(s#" not in plan


def test_moments_merge_in_any_order():
    import numpy as np

    from tablewise.operators.stats import _Moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)) + np.array([0, 1e9, -5, 1e-9, 3])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:300, 4] = np.nan  # absent from the first tasks
    parts = [_Moments.of_batch(p) for p in np.array_split(x, 90)]
    while len(parts) > 1:
        parts = [parts[i] if i + 1 == len(parts) else _Moments.unpack(parts[i].merge(parts[i + 1]).pack(), 5) for i in range(0, len(parts), 2)]
    for r in parts[0].pairs().itertuples():
        both = x[:, [r.i, r.j]][~np.isnan(x[:, [r.i, r.j]]).any(axis=1)]
        d = both - both.mean(axis=0)
        assert r.n == len(both) and r.cxy == pytest.approx((d[:, 0] * d[:, -1]).sum(), rel=1e-6, abs=1e-6) and r.cxx == pytest.approx((d[:, 0] ** 2).sum(), rel=1e-9)


def test_correlations_send_one_row_per_task(spark):
    from tablewise.operators import stats as S

    df = spark.range(0, 4000, 1, 200).select(*[(F.rand(i) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(12)])
    pdf = df.toPandas()
    got = {(r["col1"], r["col2"]): r["r"] for r in S.correlation_pairs(df).collect()}
    assert len(got) == 66 and all(v == pytest.approx(pdf[a].corr(pdf[b])) for (a, b), v in got.items())
    assert S.correlation_pairs(df.where("id < 0")).where("r is not null").isEmpty()
