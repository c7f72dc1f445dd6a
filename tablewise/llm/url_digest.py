"""URL rules looked up in a sorted digest array.

The rules become three flat files: the sorted 64-bit xxhash keys, an offset per
rule and the rule strings themselves.  Executors get the files with the job
(``addFile``), map them into memory, and probe them with numpy's vectorised
binary search.  A digest hit counts only if the stored full string is equal, so
a collision of digests can neither block nor allow a page.

A rule is ``host/path``: it fits its host and all subdomains when the page's path
starts with ``/path``; of the fitting rules the longest string wins.  A page needs
one probe per (host suffix, rule path length that occurs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import prepare, read_table

#: Host and path of op8's rules, as the contract lists them.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class DigestIndex:
    """Read side: memory-mapped arrays of one rule set."""

    def __init__(self, base: str):
        self.keys = np.memmap(base + ".keys", dtype="<u8", mode="r")
        self.offsets = np.memmap(base + ".offsets", dtype="<u8", mode="r")
        self.allow = np.memmap(base + ".allow", dtype="u1", mode="r")
        self.strings = np.memmap(base + ".strings", dtype="u1", mode="r")
        self.path_lengths = [int(x) for x in np.fromfile(base + ".lengths", dtype="<u4")]

    def find(self, names: list[bytes]) -> np.ndarray:
        """Row of each name in the index, or -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), dtype="<u8", count=len(names))
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(names), -1, dtype=np.int64)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)):
            row = int(at[k])
            while row < len(self.keys) and self.keys[row] == digests[k]:  # equal digests stand together
                if self.strings[int(self.offsets[row]) : int(self.offsets[row + 1])].tobytes() == names[k]:
                    out[k] = row
                    break
                row += 1
        return out


def build_index(rules: dict[str, str], base: str) -> None:
    """Write the files of a rule set.  Rules repeat at most once by their text, hosts in
    lower case; an empty set is not written (callers skip the lookup)."""
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "allow") for r, v in rules.items())
    np.array([r[0] for r in rows], dtype="<u8").tofile(base + ".keys")
    np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8").tofile(base + ".offsets")
    np.array([r[2] for r in rows], dtype="u1").tofile(base + ".allow")
    np.frombuffer(b"".join(r[1] for r in rows), dtype="u1").tofile(base + ".strings")
    np.array(sorted({len(r) - r.index("/") for r in rules}), dtype="<u4").tofile(base + ".lengths")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def judge_urls(df: DataFrame, rules: dict[str, str], url_col: str = "url", default: str = "allow", max_index_bytes: int = 2 << 30) -> DataFrame:
    """``df`` plus ``host, path, rule, verdict`` (columns of these names are replaced).

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; host letters count in lower
    case.  A page that no rule fits gets ``default``.  A null URL, or one without
    ``://``, has an empty host and path and fits no rule.  The rule list is given by the
    caller and so is driver-sized; a list above ``max_index_bytes`` raises.
    """
    rules = {r[: r.index("/")].translate(_LOWER) + r[r.index("/") :]: v for r, v in rules.items()}
    if any(v not in ("allow", "block") for v in rules.values()):
        raise ValueError("a rule's verdict is allow or block")
    if sum(len(r.encode()) + 17 for r in rules) > max_index_bytes:
        raise ValueError("the rule list is larger than max_index_bytes")
    name = f"url-rules-{uuid.uuid4().hex}"
    if rules:
        base = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
        build_index(rules, base)
        for ext in ("keys", "offsets", "allow", "strings", "lengths"):
            df.sparkSession.sparkContext.addFile(f"{base}.{ext}")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(f"{name}.keys")[: -len(".keys")]) if rules else None
        for batch in batches:
            parts = [split_url(u) for u in batch.column("__tw_url").to_pylist()]
            best = [-1] * len(parts)
            if index is not None:
                probes, owner = [], []
                for k, (host, path) in enumerate(parts):
                    labels = host.split(".") if host else []
                    raw = path.encode()
                    for i in range(len(labels)):
                        suffix = ".".join(labels[i:]).encode()
                        for n in index.path_lengths:
                            if n <= len(raw):
                                probes.append(suffix + raw[:n])
                                owner.append(k)
                hits = index.find(probes)
                size = lambda r: int(index.offsets[r + 1] - index.offsets[r])
                for j in np.flatnonzero(hits >= 0):
                    k, row = owner[j], int(hits[j])
                    if best[k] < 0 or size(row) > size(best[k]):
                        best[k] = row
            rule = [None if r < 0 else index.strings[int(index.offsets[r]) : int(index.offsets[r + 1])].tobytes().decode() for r in best]
            verdict = [default if r < 0 else ("allow" if index.allow[r] else "block") for r in best]
            cols = [batch.column(c) for c in batch.schema.names if c != "__tw_url"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=out.names)

    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    given = df.select(*keep, F.col(url_col).cast("string").alias("__tw_url"))
    out = given.drop("__tw_url").schema
    for c in ("host", "path", "rule", "verdict"):
        out = out.add(c, "string")
    return given.mapInArrow(judge, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page's URL against the five rules; pages without a rule are allowed."""
    prepare(spark)
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return judge_urls(pages, dict(RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL
                       ELSE regexp_replace(substr(url, position('://' IN url) + 3), '[?#](.|\n)*$', '') END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(CASE WHEN position('/' IN rest) = 0 THEN rest ELSE substr(rest, 1, position('/' IN rest) - 1) END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(CASE WHEN position('/' IN rest) = 0 THEN '' ELSE substr(rest, position('/' IN rest)) END, '') AS path FROM split),
rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON p.page_id = f.page_id
"""
