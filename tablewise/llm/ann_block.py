"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are cut into blocks by a hash of their id, and every query
block meets every candidate block in one tile (a cogroup by block numbers).  Both
blocks of a tile are bounded by parameters, so a task's memory is too; the rows sent are
queries x candidate blocks + candidates x query blocks.

Each vector is stored as int8 codes and a scale.  In a tile one matrix product of the
codes (at most 127 * 127 * d, exact in the product's float type) gives every inner
product up to an error bound that follows from the norms:

    |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|

Pairs whose upper bound reaches the query's current k-th best are recomputed in double
precision on the original vectors and pushed into the query's heap.  The tiles' heaps of a
query are merged at the end.  No pair is lost, so recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import cores, prepare, read_table, store


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a finite vector that is not zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scale, norm of the decoded vector and norm of the residual, with a
    margin for rounding in these norms themselves."""
    top = np.abs(x).max(axis=1)
    scale = top / 127.0
    codes = np.rint(x / scale[:, None] if len(x) else x)
    codes = np.clip(np.nan_to_num(codes), -127, 127)  # a scale that underflows to 0 leaves everything to the residual
    back = codes * scale[:, None]
    margin = 1 + 1e-9
    return codes.astype(np.int8), scale, np.linalg.norm(back, axis=1) * margin, np.linalg.norm(x - back, axis=1) * margin + np.abs(x).max(axis=1) * 1e-12


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in component order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _tile(k: int, step: int = 2048):
    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        """The k best of the block's candidates for every query of the block."""
        out: list[tuple] = []
        if len(queries) and len(cands):
            ids, copies, x = _block(queries)
            cid, ccopy, c = _block(cands, "c_")
            exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
            xq, xs, xn, xr = quantise(x)
            cq, cs, _, cr = quantise(c)
            cn = np.linalg.norm(c, axis=1) * (1 + 1e-9)
            heaps: list[list[tuple]] = [[] for _ in ids]
            for at in range(0, len(c), step):
                to = slice(at, at + step)
                codes = cq[to].astype(exact).T
                for lo in range(0, len(x), 512):
                    q = slice(lo, lo + 512)
                    dot = (xq[q].astype(exact) @ codes).astype(np.float64) * xs[q, None] * cs[None, to]
                    err = xr[q, None] * cn[None, to] + xn[q, None] * cr[None, to] + 1e-12 * xn[q, None] * cn[None, to]
                    own = (cid[None, to] == ids[q, None]) & (ccopy[None, to] == copies[q, None])
                    bar = np.array([h[0][0] if len(h) >= k else -np.inf for h in heaps[q]])
                    if dot.shape[1] > k:  # the k-th largest lower bound of this tile is a bar too
                        bar = np.maximum(bar, np.partition(np.where(own, -np.inf, dot - err), -k, axis=1)[:, -k])
                    row, col = np.nonzero((dot + err >= bar[:, None]) & ~own)
                    for s in range(0, len(row), 1 << 16):
                        r, j = row[s : s + (1 << 16)] + lo, col[s : s + (1 << 16)] + at
                        for a, b, v in zip(r.tolist(), cid[j].tolist(), inner(x[r], c[j]).tolist(), strict=True):
                            _push(heaps[a], k, v, b)
            out = [(i, p, -b, v) for i, p, h in zip(ids.tolist(), copies.tolist(), heaps, strict=True) for v, b in h]
        return pd.DataFrame(out, columns=["query_id", "query_copy", "vec_id", "score"])

    return run


def _block(pdf: pd.DataFrame, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vec_id, copy, v = (pdf[prefix + c].to_numpy() for c in ("vec_id", "copy", "v"))
    return vec_id.astype(np.int64), copy.astype(np.int32), np.stack(v).astype(np.float64)


def _push(heap: list[tuple], k: int, score: float, vec_id: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, (score, -vec_id))
    elif (score, -vec_id) > heap[0]:
        heapq.heapreplace(heap, (score, -vec_id))


def _merge(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merge the tiles' heaps of the queries of one query block."""
        heaps: dict[tuple[int, int], list[tuple]] = {}
        for pdf in batches:
            for i, p, b, v in zip(pdf["query_id"].tolist(), pdf["query_copy"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist(), strict=True):
                _push(heaps.setdefault((i, p), []), k, v, b)
        rows = [(i, r, -b, v) for (i, _), h in heaps.items() for r, (v, b) in enumerate(sorted(h, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 32_768, query_block: int = 8192) -> DataFrame:
    """The ``k`` rows of largest inner product for every row for which the column
    ``is_query`` (over ``vec_id``) holds: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; all candidates are returned if there are fewer than
    ``k``.  Rows without an id, and vectors that are null, empty, zero or hold
    null or non-finite components take no part; only vectors of the query's
    dimension are its candidates.  Every row but the query's own is a candidate: rows
    that repeat an id are numbered, so a repeated query row finds its twin, and each
    repeated query row gets its own ranks.  An empty table gives an empty result;
    further columns are ignored.
    """
    rows = usable(df, id_col, vec_col)
    copy = Window.partitionBy("vec_id", "dim").orderBy("v")
    rows = store(rows.withColumn("copy", (F.row_number().over(copy) - 1).cast("int")).withColumn("is_query", is_query))
    n, nq = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    groups = max(1, -(-n // block_rows))
    q_blocks = max(1, -(-nq // query_block))
    # few query blocks: cut the candidates finer until every core has a tile
    groups = max(groups, min(-(-2 * cores(df.sparkSession) // q_blocks), max(1, n // 256)))
    side = ["dim", "qb", "cg"]
    queries = rows.where("is_query").withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"))
    queries = queries.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*side, "vec_id", "copy", "v")
    cands = rows.withColumn("cg", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int"))
    cands = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    cands = cands.select(*side, *[F.col(c).alias("c_" + c) for c in ("vec_id", "copy", "v")])
    found = queries.groupBy(*side).cogroup(cands.groupBy(*side)).applyInPandas(_tile(k), "query_id long, query_copy int, vec_id long, score double")
    merge = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(16 * q_blocks))
    return found.groupBy(merge.alias("mb")).applyInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ids divisible by 20 against all rows, 20 nearest."""
    prepare(spark)
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
