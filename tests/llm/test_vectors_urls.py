"""Embedding and URL operators against plain Python, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import ann_block, embed_pigeonhole, url_digest
from tablewise.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string, score string, n_links string"
NAN, INF = float("nan"), float("inf")
BAD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [NAN] * 8, 1), (904, [INF] + [1.0] * 7, 1), (905, [], 1), (None, [1.0] * 8, 1), (907, [1.0] * 8, None)]


def vectors(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], la, "a", "b", "c", "d") for i, v, la in rows], SCHEMA)


def sample(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = (centre[rng.integers(0, 12, n)] + rng.normal(scale=0.25, size=(n, dim))).astype(np.float32)
    return [(i, x[i].tolist(), int(i % 3)) for i in range(n)]


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def test_nearest_against_brute_force(spark):
    rows = sample() + [(400, sample()[3][1], 0), (401, sample()[3][1], 0), (20, sample()[7][1], 0)] + BAD + [(960, [1.0, 2.0], 1), (961, [3.0, 1.0], 1)]
    out = ann_block.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5, block_rows=90, query_block=4).toPandas()
    good = [(i, np.float32(v).astype(float).tolist()) for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    want = []
    for q, (i, a) in enumerate(good):
        if i % 20 == 0:
            best = sorted(((-dot(a, b), j) for c, (j, b) in enumerate(good) if c != q and len(b) == len(a)))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    got = sorted(zip(out.query_id, out["rank"], out.vec_id, out.score, strict=True))
    # both rows of the repeated id 20 ask for themselves
    assert got == sorted(want) and [r for r in got if r[0] == 960] == [(960, 1, 961, 5.0)]


def test_nearest_of_nothing(spark):
    assert ann_block.nearest(vectors(spark, BAD[:5]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann_block.nearest(vectors(spark, BAD).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 16)) * 10.0 ** rng.integers(-8, 8, (50, 1)), rng.normal(size=(60, 16))
    ca, sa, na, ra = ann_block.quantise(a)
    cb, sb, _, rb = ann_block.quantise(b)
    product = (ca.astype(float) @ cb.astype(float).T) * sa[:, None] * sb
    assert (np.abs(product - a @ b.T) <= ra[:, None] * np.linalg.norm(b, axis=1) + na[:, None] * rb).all()


@pytest.mark.parametrize("max_cell", [4096, 20])
def test_near_vectors_against_all_pairs(spark, max_cell):
    rows = sample() + [(400 + i, sample()[5][1], 2) for i in range(5)] + [(410, [2 * x for x in sample()[5][1]], 2), (6, sample()[6][1], 0)]
    out = embed_pigeonhole.near_duplicates(vectors(spark, rows + BAD), max_cell=max_cell).toPandas()
    assert len(out) == len(rows) + len(BAD)
    x = np.array([np.float32(v) for _, v, _ in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    la = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (la[:, None] == la[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    group = list(range(len(rows)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = group[i], group[j]
        if a != b:
            group = [min(a, b) if g in (a, b) else g for g in group]
    low = {}
    for i, g in zip(ids, group, strict=True):
        low[g] = min(low.get(g, i), i)
    want = sorted((i, int(n), low[g], i == low[g]) for i, n, g in zip(ids, near.sum(axis=1), group, strict=True))
    got = sorted((int(i), int(n), int(c), bool(k)) for i, n, c, k in zip(out.vec_id, out.n_links, out.component_id, out.kept, strict=True) if i == i and i < 900)
    assert got == want
    rest = out[~(out.vec_id < 900)]
    assert (rest.n_links == 0).all() and rest.kept.all() and len(rest) == len(BAD)


def test_near_vectors_of_nothing(spark):
    assert embed_pigeonhole.near_duplicates(vectors(spark, BAD).limit(0)).count() == 0
    out = embed_pigeonhole.near_duplicates(vectors(spark, BAD))
    assert out.count() == len(BAD) and out.where("n_links > 0").count() == 0


URLS = [
    None, "", "no scheme", "http://example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com", "http://example.com?x=/en/",
    "ftp://b.net/es/", "http://net/es/é", "http://bnet/es/", "http://x.net/es", "http://user@com/", "http:///en/", "a://b://c.com/d", "http://example.com./en/", "HTTP://EXAMPLE.COM/EN/",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        if rest[end : end + 1] == "/":
            path = rest[end : min([i for i in range(end, len(rest)) if rest[i] in "?#"], default=len(rest))]
    best = None
    for r, v in url_digest.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls_against_plain_rules(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    out = url_digest.judge_urls(df, dict(url_digest.RULES)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [plain(u) for u in URLS * 2]
    assert url_digest.judge_urls(df, {}).where("verdict <> 'allow'").count() == 0
    assert url_digest.judge_urls(df.limit(0), dict(url_digest.RULES)).count() == 0


def test_digest_collisions_are_confirmed(tmp_dir, monkeypatch):
    monkeypatch.setattr(url_digest.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)  # nearly everything collides
    rules = {f"host{i}.com/{'x' * (i % 5)}": "block" for i in range(40)}
    url_digest.build_index(rules, tmp_dir + "/i")
    index = url_digest.DigestIndex(tmp_dir + "/i")
    names = [r.encode() for r in rules] + [b"host1.org/", b"other/xx"]
    hit = index.find(names)
    assert (hit[:40] >= 0).all() and len(set(hit[:40].tolist())) == 40 and (hit[40:] == -1).all()
