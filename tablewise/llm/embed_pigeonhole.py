"""Near-duplicate embeddings by a subspace pigeonhole join.

For unit vectors, cosine >= t means a squared distance of at most 2 - 2t.  The
vectors are rotated (principal axes of all rows) and the axes dealt into blocks.
If the squared distance of a pair is within the budget, then in at least one block it is
within that block's share of the budget; shares are proportional to the blocks' variance.
So each block is range-joined by itself:

* a grid over the block's leading axes, with cells as wide as the block's radius, is the
  join key: near pairs lie in the same or in adjacent cells, and each
  vector is sent to the adjacent cells of one half-space only, so a pair meets once;
* a cell holding more than ``max_cell`` rows is cut into tiles of which every two meet once;
* a tile compares in the block's subspace first; the surviving candidates are verified
  exactly (cosine in double precision).  A pair that an earlier block has within
  its share was found there and is left to it, so the union over blocks needs no
  shuffle of pairs.

A tile returns link counts per vector and a spanning forest of its links, not the
pairs themselves.  Equal vectors of a label meet in one aggregate before and enter the join
once; their links are counted by multiplicity.
"""

from __future__ import annotations


from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import components, prepare, read_table, store

#: Slack of prefilters against rounding; the exact check decides.
SLACK = 1e-9
#: The table of cut cells is broadcast up to this many rows and label bytes, and joined by shuffle beyond.
BROADCAST_CELLS, BROADCAST_BYTES = 100_000, 8 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, label, v, ok): ok is false for vectors that are null, zero or hold null or non-finite components."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).withColumn(
        "ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    )


def cosine(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, summed in component order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out / (na * nb)


def rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """x @ axes, summed in component order: a row's result never depends on the rows beside it."""
    out = np.zeros((len(x), axes.shape[1]))
    for j in range(x.shape[1]):
        out += x[:, j, None] * axes[None, j]
    return out


def norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.sqrt(out)


def _moments(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, outer, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, dim))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total, outer, n = total + x.sum(axis=0), outer + x.T @ x, n + len(x)
        flat = np.concatenate(([n], total, outer.ravel()))
        yield pd.DataFrame({"k": np.arange(len(flat)), "x": flat})

    return run


def rotation(vectors: DataFrame, dim: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Principal axes (columns), the axes of each block and each block's share of the variance.

    The moments are sums over all rows, added up by Spark: 1 + d + d*d numbers reach the driver.
    """
    sums = vectors.select("v").mapInPandas(_moments(dim), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toPandas()["x"].to_numpy()
    n, mean, outer = sums[0], sums[1 : 1 + dim] / sums[0], sums[1 + dim :].reshape(dim, dim) / sums[0]
    values, axes = np.linalg.eigh(outer - np.outer(mean, mean))
    order = np.argsort(-values)
    values, axes = np.maximum(values[order], 1e-12), axes[:, order]
    blocks = min(blocks, dim)
    dealt = [np.arange(b, dim, blocks) for b in range(blocks)]
    share = np.array([values[d].sum() for d in dealt])
    return axes, dealt, share / share.sum()


def _cells(dealt: list[np.ndarray], axes: np.ndarray, radius: np.ndarray, grid: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(rid, block, cell, home) for the home cell and the adjacent cells of one half-space."""
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            parts = []
            for b, d in enumerate(dealt):
                g = d[:grid]
                r = radius[b] * (1 + SLACK) + SLACK
                z = x @ axes[:, g]
                cell = np.floor(z / r).astype(np.int64)
                low = z - cell * r  # distance to the lower border; the upper one is r - low
                for step in product((-1, 0, 1), repeat=len(g)):
                    if step < (0,) * len(g):
                        continue
                    s = np.array(step)
                    gap = np.where(s < 0, low, np.where(s > 0, r - low, 0.0))
                    near = (gap**2).sum(axis=1) <= r * r + SLACK
                    to = (cell + s)[near]
                    key = np.zeros(len(to), dtype=np.int64)
                    for j in range(len(g)):
                        key = key * 1_000_003 + to[:, j]
                    parts.append(pdf[near].assign(block=b, cell=key, home=not any(step)))
            yield pd.concat(parts, ignore_index=True)[["label", "block", "cell", "home", "rid", "n", "v"]]

    return run


def _join_cell(dealt: list[np.ndarray], axes: np.ndarray, budget: np.ndarray, floor: float, step: int = 256):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b, first, second = int(key[1]), int(key[3]), int(key[4])
        rid, mult, home, piece = pdf["rid"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["home"].to_numpy(bool), pdf["piece"].to_numpy()
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        size = norms(raw)
        z = rotated(raw / size[:, None], axes)
        own = z[:, dealt[b]]
        sq = (own**2).sum(axis=1)
        # Home rows meet home rows and visitors.  In a cut cell, tile (i, j) joins piece i's home
        # rows with all of piece j; both orders exist for visitors, home pairs count once.
        left = np.flatnonzero(home & (piece == first))
        right = np.flatnonzero(piece == second)
        links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        for s in range(0, len(left), step):
            rows = left[s : s + step]
            d2 = sq[rows, None] + sq[None, right] - 2 * own[rows] @ own[right].T
            i, j = np.nonzero(d2 <= budget[b] + 1e-7)
            i, j = rows[i], right[j]
            keep = ~home[j] | (rid[i] < rid[j])  # one order of a home pair
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 15):
                a, c = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                swap = rid[a] > rid[c]  # the same arithmetic for a pair wherever it is met
                a, c = np.where(swap, c, a), np.where(swap, a, c)
                gap = (z[a] - z[c]) ** 2
                ok = np.ones(len(a), bool)
                for e in range(b):  # an earlier block has found it
                    ok &= gap[:, dealt[e]].sum(axis=1) > budget[e]
                ok &= (gap[:, dealt[b]].sum(axis=1) <= budget[b]) | ~ok
                a, c = a[ok], c[ok]
                ok = cosine(raw[a], raw[c], size[a], size[c]) >= floor
                a, c = a[ok], c[ok]
                np.add.at(links, a, mult[c])
                np.add.at(links, c, mult[a])
                _unite(root, a, c)
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"rid": rid[hit], "links": links[hit], "to": rid[root[hit]]})

    return run


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k] for all k; root holds each member's smallest position."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", blocks: int = 4, grid: int = 2, max_cell: int = 4096) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows of one label (not null) link at a cosine of ``threshold`` or more.  Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without an id or
    label, link with nothing: n_links 0 and their own id as component.  Vectors of different
    dimensions do not link.  Repeated rows are rows of their own and link with each other.
    An empty table gives an empty result; further columns are ignored.
    """
    given = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = store(usable(given, "vec_id", "embedding"))
    classes = rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep")).withColumn("dim", F.size("v"))
    classes = store(classes.withColumn("rid", F.monotonically_increasing_id()))  # ids may repeat, class numbers do not
    found = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):  # dimensions of one table: a handful
        part = _range_joins(classes.where(F.col("dim") == dim), dim, threshold, blocks, grid, max_cell)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tiles = store(found)
    comps = store(components(tiles.select("rid", "to"), "rid", "to"))
    per = classes.join(tiles.groupBy("rid").agg(F.sum("links").alias("links")), "rid", "left").join(comps.withColumnRenamed("node", "rid"), "rid", "left")
    per = per.withColumn("component", F.coalesce("component", "rid"))
    named = per.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = per.join(named, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("ok"))
    out = rows.join(by_class, ["label", "v", "ok"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.coalesce(F.col("vec_id") == comp, F.lit(True))).alias("kept"))


def _range_joins(classes: DataFrame, dim: int, threshold: float, blocks: int, grid: int, max_cell: int) -> DataFrame:
    axes, dealt, share = rotation(classes, dim, blocks)
    # the budget covers pairs that rounding puts on either side; the exact check decides
    budget = (2 - 2 * threshold + 1e-9) * share + 1e-9
    radius = np.sqrt(budget)
    sent = classes.select("label", "rid", "n", "v").mapInPandas(_cells(dealt, axes, radius, grid), "label string, block int, cell long, home boolean, rid long, n long, v array<double>")
    at = ["label", "block", "cell"]
    hot = store(sent.groupBy(*at).count().where(F.col("count") > max_cell).select(*at, F.ceil(F.col("count") / max_cell).cast("int").alias("pieces")))
    n, label_bytes = hot.agg(F.count("*"), F.coalesce(F.sum(F.length("label")), F.lit(0))).first()
    small = n <= BROADCAST_CELLS and 4 * label_bytes <= BROADCAST_BYTES
    cut = sent.join(F.broadcast(hot) if small else hot, at, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    # piece i meets piece j in tile (i, j): home rows of i against all rows of j
    as_right = cut.withColumn("i", F.explode(every)).withColumn("j", F.col("piece"))
    as_left = cut.where("home and pieces > 1").withColumn("j", F.explode(every)).withColumn("i", F.col("piece")).where("i <> j")
    cols = ["label", "block", "cell", "i", "j", "home", "piece", "rid", "n", "v"]
    tiles = as_right.select(*cols).union(as_left.select(*cols))
    return tiles.groupBy("label", "block", "cell", "i", "j").applyInPandas(_join_cell(dealt, axes, budget, threshold), "rid long, links long, to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all embeddings, cosine 0.93 within a label."""
    prepare(spark)
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node),
cnt AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN cnt ON cnt.a = e.vec_id LEFT JOIN comp ON comp.node = e.vec_id
"""
