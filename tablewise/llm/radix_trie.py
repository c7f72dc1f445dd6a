"""Trie of conversation prefixes, by adaptive radix trees over turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a byte
string of fixed-width ids that sorts and compares as one big-endian number per turn; texts never travel, only ids and lengths.

1. Conversations are sorted by (key, conv_id) over range partitions; equal ones fold into one
   row per partition and then into one row, with the hash of their ids streamed in order.
2. Distinct keys are sorted over range partitions and cut into chunks of a bounded number of rows and bytes.
   Each chunk is inserted into an adaptive radix tree: nodes grow through layouts for 4, 16, 48 and 256 children,
   common bytes are compressed into a node's prefix, and only byte depths that end a turn emit trie nodes.
3. How many turns a chunk shares with its neighbours in the order says which nodes other chunks hold too. A node
   belongs to the first chunk that holds it, so counts of children, leaves and text lengths add up over
   chunks without counting a node twice. Only these shared nodes (the paths at the edges of chunks) are merged.

However many conversations begin alike, or are alike, no task holds more than its chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import discard, prepare, read_table, store

#: Bytes of a turn id.
WIDTH = 16
#: A chunk closes at so many conversations or bytes of keys.
CHUNK_ROWS, CHUNK_BYTES = 20_000, 32 << 20
#: Characters of joined conversation ids that travel in one row.
IDS_CHARS = 1 << 20
_NONE = hashlib.sha256(b"").hexdigest()


class Node4:
    """Up to 4 children beside their bytes; ``prefix`` holds the bytes all keys below share."""

    __slots__ = ("prefix", "row", "any", "keys", "kids")
    room = 4

    def __init__(self, prefix: bytes, any_row: int):
        self.prefix, self.any, self.row = prefix, any_row, -1
        self.keys, self.kids = bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, child) -> None:
        at = self.keys.find(byte)
        if at < 0:
            self.keys.append(byte)
            self.kids.append(child)
        else:
            self.kids[at] = child

    def full(self) -> bool:
        return len(self.keys) == self.room

    def children(self) -> list[tuple[int, object]]:
        return sorted(zip(self.keys, self.kids, strict=True), key=lambda x: x[0])


class Node16(Node4):
    """As Node4, up to 16."""

    __slots__ = ()
    room = 16


class Node48(Node4):
    """A table of 256 bytes that leads to one of up to 48 slots."""

    __slots__ = ("slot",)
    room = 48

    def __init__(self, prefix: bytes, any_row: int):
        super().__init__(prefix, any_row)
        self.slot = bytearray(b"\xff" * 256)

    def get(self, byte: int):
        return None if self.slot[byte] == 255 else self.kids[self.slot[byte]]

    def put(self, byte: int, child) -> None:
        if self.slot[byte] == 255:
            self.slot[byte] = len(self.kids)
            self.keys.append(byte)
            self.kids.append(child)
        else:
            self.kids[self.slot[byte]] = child


class Node256(Node4):
    """One slot per byte."""

    __slots__ = ()
    room = 257

    def __init__(self, prefix: bytes, any_row: int):
        super().__init__(prefix, any_row)
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child) -> None:
        self.kids[byte] = child

    def full(self) -> bool:
        return False

    def children(self) -> list[tuple[int, object]]:
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


_LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


class RadixTree:
    """Adaptive radix tree from byte strings to row numbers; a key may be a prefix of another."""

    def __init__(self):
        self.root = Node4(b"", -1)

    def insert(self, key: bytes, row: int) -> None:
        node, above, by, at = self.root, None, 0, 0
        if node.any < 0:
            node.any = row
        while True:
            own = node.prefix
            if not key.startswith(own, at):
                self._split(node, above, by, key, at, row)
                return
            at += len(own)
            if at == len(key):
                node.row = row
                return
            child = node.get(key[at])
            if child is None:
                if node.full():
                    node = self._grow(node, above, by)
                leaf = Node4(key[at + 1 :], row)
                leaf.row = row
                node.put(key[at], leaf)
                return
            node, above, by, at = child, node, key[at], at + 1

    def _replace(self, above, by: int, node) -> None:
        if above is None:
            self.root = node
        else:
            above.put(by, node)

    def _grow(self, node, above, by: int):
        larger = _LARGER[type(node)](node.prefix, node.any)
        larger.row = node.row
        for byte, child in node.children():
            larger.put(byte, child)
        self._replace(above, by, larger)
        return larger

    def _split(self, node, above, by: int, key: bytes, at: int, row: int) -> None:
        """A new node takes the bytes that the key shares with the node's prefix."""
        n = _common(node.prefix, key[at : at + len(node.prefix)])
        top = Node4(node.prefix[:n], node.any)
        byte, node.prefix = node.prefix[n], node.prefix[n + 1 :]
        top.put(byte, node)
        if at + n == len(key):
            top.row = row
        else:
            leaf = Node4(key[at + n + 1 :], row)
            leaf.row = row
            top.put(key[at + n], leaf)
        self._replace(above, by, top)

    def aligned(self, width: int) -> Iterator[tuple[int, int, int, int]]:
        """(parent, depth, any row below, row that ends here or -1) of every node at a byte depth
        that is a multiple of ``width``, parents first; parent is a position in this order."""
        todo, n = [(self.root, 0, -1)], 0
        while todo:
            node, before, parent = todo.pop()
            end = before + len(node.prefix)
            first = 0 if parent < 0 else (before - 1) // width + 1  # ``before`` counts the byte that led here
            for depth in range(first, end // width + 1):
                yield parent, depth, node.any, node.row if depth * width == end else -1
                parent, n = n, n + 1
            todo += [(child, end + 1, parent) for _byte, child in reversed(node.children())]


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        cols = list(zip(*rows[at : at + 10_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


_ALIKE = pa.schema([("key", pa.binary()), ("lens", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lens, conv_id), sorted: one row per key and stretch of ids: smallest id, how many, ids joined in order."""
    key, lens, ids, chars, out = None, None, [], 0, []
    for k, le, conv in _rows(batches):
        if ids and (k != key or chars > IDS_CHARS):
            out.append((key, lens, ids[0], len(ids), ",".join(map(str, ids))))
            ids, chars = [], 0
            if len(out) >= 1000 or len(out[-1][4]) > IDS_CHARS // 2:
                yield from _batches(out, _ALIKE)
                out = []
        key, lens = k, le
        ids.append(conv)
        chars += len(str(conv)) + 1
    if ids:
        out.append((key, lens, ids[0], len(ids), ",".join(map(str, ids))))
    yield from _batches(out, _ALIKE)


_DISTINCT = pa.schema([("key", pa.binary()), ("lens", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (key, smallest id): one row per key, the ids hashed as they pass."""
    held, out = None, []
    for key, lens, conv, n, ids in _rows(batches):
        if held is None or held[0] != key:
            if held is not None:
                out.append((*held[:4], held[4].hexdigest()))
                if len(out) >= 1000:
                    yield from _batches(out, _DISTINCT)
                    out = []
            held = [key, lens, conv, 0, hashlib.sha256()]
        else:
            held[4].update(b",")
        held[3] += n
        held[4].update(ids.encode())
    if held is not None:
        out.append((*held[:4], held[4].hexdigest()))
    yield from _batches(out, _DISTINCT)


_CHUNKED = pa.schema([*_DISTINCT, ("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])


def _chunks(width: int, rows: int, size: int) -> Callable:
    """Distinct keys of a sorted partition, in numbered chunks; ``before`` and ``after`` are the turns
    the chunk's first and last key share with the neighbour, null at the partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, used, before = 0, 0, None

        def close(after: int | None, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            end = len(held) - 1
            return _batches([(*r, number, before, after, first and k == 0, last and k == end) for k, r in enumerate(held)], _CHUNKED)

        for r in _rows(batches):
            if held and (len(held) >= rows or used >= size):
                after = _common(held[-1][0], r[0]) // width
                yield from close(after, number == 0, False)
                held, used, number, before = [], 0, number + 1, after
            held.append(r)
            used += len(r[0])
        if held:
            yield from close(None, number == 0, True)

    return run


_NODES = pa.schema(
    [
        ("path", pa.binary()), ("parent_path", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ]
)
_NODES_SQL = "path binary, parent_path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def chunk_nodes(rows: list[tuple], width: int, before: int, after: int) -> list[tuple]:
    """Trie nodes of sorted rows (key, lens, conv_id, n, ends).  ``before`` and ``after``: turns shared with the
    neighbouring chunks (-1: no neighbour).  Nodes that a neighbour holds too carry their path,
    their children their parent's, and the counts of what this chunk holds first."""
    tree = RadixTree()
    for k, r in enumerate(rows):
        tree.insert(r[0], k)
    nodes = list(tree.aligned(width))
    n = len(nodes)
    conv: list[int | None] = [None] * n
    count, kids, leaves, saved, has = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    low, high = [len(rows)] * n, [-1] * n  # first and last row below: only their paths can be shared
    for i in range(n - 1, -1, -1):
        parent, depth, some, end = nodes[i]
        if end >= 0:
            conv[i] = rows[end][2] if conv[i] is None else min(rows[end][2], conv[i])
            count[i] += rows[end][3]
            low[i], high[i] = min(low[i], end), max(high[i], end)
        held_before, held_after = low[i] == 0 and depth <= before, high[i] == len(rows) - 1 and depth <= after
        if not has[i] and not held_after:
            leaves[i] += 1
        length = rows[some][1][depth - 1] if depth else 0
        saved[i] += length * (count[i] - (not held_before))
        if parent >= 0:
            conv[parent] = conv[i] if conv[parent] is None else min(conv[i], conv[parent])
            count[parent] += count[i]
            leaves[parent] += leaves[i]
            saved[parent] += saved[i]
            kids[parent] += not held_before
            has[parent] = True
            low[parent], high[parent] = min(low[parent], low[i]), max(high[parent], high[i])
    shared = [low[i] == 0 and x[1] <= before or high[i] == len(rows) - 1 and x[1] <= after for i, x in enumerate(nodes)]
    out, path = [], [b""] * n  # a path's digest goes on from its parent's; the nodes above a shared one are shared
    for i, (parent, depth, some, end) in enumerate(nodes):
        above = parent >= 0 and shared[parent]
        if shared[i]:
            path[i] = hashlib.sha256((path[parent] if parent >= 0 else b"") + rows[some][0][max(0, depth - 1) * width : depth * width]).digest()
        out.append(
            (
                path[i] if shared[i] else None,
                path[parent] if above else None,
                conv[i], depth, conv[parent] if parent >= 0 and not above else None, count[i], kids[i], leaves[i], saved[i], rows[end][4] if end >= 0 else None,
            )
        )
    return out


def _trees(width: int) -> Callable:
    """Rows of whole chunks, sorted by (part, chunk, key): their trie nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        where = None
        for r in _rows(batches):
            if held and where != (r[5], r[6]):
                yield from _batches(chunk_nodes(held, width, *edge), _NODES)  # noqa: F821 - set with the first row
                held = []
            where, edge = (r[5], r[6]), (r[7], r[8])
            held.append(r)
        if held:
            yield from _batches(chunk_nodes(held, width, *edge), _NODES)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, last, next part's first): turns they share."""
    for b in batches:
        shared = [_common(x, y) // WIDTH for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(shared, pa.int32())], names=["part", "next_part", "shared"])


def trie_nodes(seqs: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """Trie nodes of ``seqs`` (conv_id long, key binary, lens array of int: code points of each turn's text).

    Columns as the module's query returns them.  ``parts`` sets the range partitions (by default one per 5 chunks).
    """
    spark = seqs.sparkSession
    some = seqs.select("key", "lens", "conv_id")
    alike = some.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    alike = alike.mapInArrow(_alike, "key binary, lens array<int>, conv_id long, n long, ids string")
    distinct = store(
        alike.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_fold, "key binary, lens array<int>, conv_id long, n long, ends string")
    )
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("size")).first()
    parts = parts or max(1, -(-total["n"] // (5 * chunk_rows)), -(-total["size"] // (5 * chunk_bytes)))
    cols = ["key", "lens", "conv_id", "n", "ends"]
    chunked = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()).select(*cols, "part")
    chunked = store(
        chunked.mapInArrow(
            _chunks(WIDTH, chunk_rows, chunk_bytes),
            "key binary, lens array<int>, conv_id long, n long, ends string, part int, chunk int, before int, after int, first boolean, last boolean",
        )
    )
    discard(distinct)
    # one row per range partition: its last key beside the first key of the next partition that holds any
    heads = chunked.where("first or last").groupBy("part").agg(F.min("key").alias("head"), F.max("key").alias("tail"))
    heads = store(heads)
    numbers = sorted(r["part"] for r in heads.select("part").collect())  # numbers of partitions
    pairs = spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "part int, next_part int")
    pairs = pairs.join(heads.select("part", "tail"), "part").join(heads.select(F.col("part").alias("next_part"), "head"), "next_part")
    shared = {r["part"]: (r["next_part"], r["shared"]) for r in pairs.select("part", "tail", "head", "next_part").mapInArrow(_edges, "part int, next_part int, shared int").collect()}
    discard(heads)
    before = {q: s for q, s in shared.values()}
    rows = spark.createDataFrame([(p, before.get(p, -1), shared[p][1] if p in shared else -1) for p in numbers], "part int, edge_before int, edge_after int")
    whole = chunked.join(F.broadcast(rows), "part").select(  # three integers per partition
        *cols, "part", "chunk", F.coalesce("before", "edge_before").alias("before"), F.coalesce("after", "edge_after").alias("after")
    )
    nodes = store(whole.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "key").mapInArrow(_trees(WIDTH), _NODES_SQL))
    discard(chunked)
    merged = nodes.where("path is not null").groupBy("path").agg(
        F.first("parent_path", ignorenulls=True).alias("parent_path"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = store(merged)
    salts = 16  # a shared node may have very many children: its row meets them under several keys
    above = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("path is null and parent_path is null").select(*out)
    edge = nodes.where("path is null and parent_path is not null").drop("path").unionByName(merged.select(*[c for c in merged.columns if c != "path"], F.lit(None).cast("long").alias("parent_conv_id")))
    edge = edge.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(salts)).cast("int"))
    edge = edge.join(above, ["parent_path", "salt"], "left").drop("parent_conv_id").withColumnRenamed("above", "parent_conv_id").select(*out)
    result = inner.union(edge)
    return result.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))


def turn_sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (id in hex, code points).

    By turn, null first; equal turns go by role, then by the SHA-256 of the text. Null role or text is empty;
    rows without a conversation id belong to none. The row of a conversation holds 36 bytes a turn."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    name = F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH)
    rows = rows.select("conv_id", F.struct("turn", "role", F.sha2("text", 256).alias("h"), name.alias("id"), F.char_length("text").alias("len")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["len"].alias("len")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, key, lens) of the conversations as the query rebuilds them: the first h turns of
    the group's first conversation (c - c % group), then the own turns after the first h; h = crc32(c) % most."""
    own = store(turn_sequences(conversations))
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    # at most 2 * group - 1 conversations meet one base
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").withColumn("h", h)
    head = F.expr("case when head is null or h = 0 then array() else slice(head, 1, h) end")
    tail = F.expr("case when size(turns) > h then slice(turns, h + 1, size(turns) - h) else array() end")
    turns = both.select("conv_id", F.concat(head.cast("array<struct<id:string,len:int>>"), tail.cast("array<struct<id:string,len:int>>")).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["len"]).alias("lens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all conversations, rebuilt by the contract's rule.

    An empty table has no node, not even the root; repeated rows are repeated turns; further columns are ignored."""
    prepare(spark)
    return trie_nodes(rebuilt(read_table(spark, sf_dir, "conversations")))


SQL = """
WITH own AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, sha256(x)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (
  SELECT conv_id, CAST(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c:
      [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b:
      CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS INTEGER) AS h FROM own),
seqs AS (
  SELECT own.conv_id, list_concat(coalesce(base.t, [])[1 : h], own.t[h + 1 :]) AS t
  FROM own JOIN h USING (conv_id) LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 100),
prefixes AS (SELECT conv_id, d, t[1 : d] AS p, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children USING (d, p)),
below AS (
  SELECT a AS d, p[1 : a] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].x) END) AS saved
  FROM (SELECT d, p, k, n, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM full_nodes f JOIN below USING (d, p) LEFT JOIN nodes parent ON parent.d = f.d - 1 AND parent.p = f.p[1 : f.d - 1]
"""
