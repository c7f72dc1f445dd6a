import numpy as np
import pandas as pd
import pytest

from tablewise.operators.quantiles import quantiles


def _pandas_q(pdf, col, p):
    return pdf[col].dropna().quantile(p)


@pytest.mark.parametrize("max_candidates", [1_000_000, 50, 5])
def test_exact_quantiles_match_pandas(spark, max_candidates):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], n),
            "x": rng.lognormal(size=n),
            "y": rng.integers(0, 20, n).astype(float),
        }
    )
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = quantiles(df, ["x", "y"], probs, by=["g"], max_candidates=max_candidates).toPandas()
    for (g, col, p), val in got.set_index(["g", "column", "p"])["value"].items():
        exp = _pandas_q(pdf[pdf.g == g], col, p)
        assert val == pytest.approx(exp, rel=1e-12, abs=1e-12), (g, col, p)
    assert len(got) == 3 * 2 * len(probs)


def test_heavy_tie_group(spark):
    # one value holds most rows: bracket collapses onto it
    vals = [5.0] * 2000 + list(np.arange(300, dtype=float))
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = quantiles(df, ["x"], [0.1, 0.5, 0.9], max_candidates=20).toPandas()
    s = pd.Series(vals)
    for _, r in got.iterrows():
        assert r.value == pytest.approx(s.quantile(r.p))


def test_approx_quantiles(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as x")
    got = quantiles(df, ["x"], [0.5], approx=True).first()
    assert abs(got.value - 499.5) <= 2


def test_refine_path_heavy_tie(spark):
    vals = [5.0] * 2000 + list(np.arange(300, dtype=float))
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = quantiles(df, ["x"], [0.1, 0.5, 0.9, 1.0], max_candidates=3).toPandas()
    s = pd.Series(vals)
    for _, r in got.iterrows():
        assert r.value == pytest.approx(s.quantile(r.p))


def test_refine_path_equals_default_on_driver_table(spark):
    from tests.conftest import SF01

    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cols, probs = ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99]
    a = sorted(map(tuple, quantiles(li, cols, probs).collect()))
    b = sorted(map(tuple, quantiles(li, cols, probs, max_candidates=200).collect()))
    assert a == b


def test_grouped_quantiles_read_their_input_twice(spark):
    """The stored targets are found again: sketch and selection are one pass each, for any number of groups."""
    pdf = pd.DataFrame({"g": ["p", "q", None] * 20, "v": [float(i % 17) for i in range(60)]})
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    base = spark.createDataFrame(pdf)
    df = base.mapInPandas(watched, base.schema)
    got = {(r.g, r.p): r.value for r in quantiles(df, ["v"], [0.25, 0.5], by=["g"]).collect()}
    assert seen.value == 2 * len(pdf)
    assert got == {(None if pd.isna(g) else g, p): x["v"].quantile(p) for g, x in pdf.groupby("g", dropna=False) for p in (0.25, 0.5)}  # a NULL group is a group
