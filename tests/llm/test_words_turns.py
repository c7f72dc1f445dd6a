"""Benchmark passages, conversation tries and spelling groups against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import radix_trie, spelling_groups, wu_manber
from tablewise.llm.common import prepare

# --- benchmark passages ---------------------------------------------------------

DOCS = "doc_id long, text string, n_words long, spans string, items string, digest string, more string, item_id long"
ITEMS = "item_id long, text string, words string, item string, seq int, doc_id long"


def plain_words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_passages(docs, items, window):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        m = min(window, len(w))
        for s in range(len(w) - m + 1) if w else ():
            wins.setdefault(tuple(w[s : s + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for m in {len(k) for k in wins}:
            for s in range(len(w) - m + 1):
                found = wins.get(tuple(w[s : s + m]))
                if found:
                    hit.update(range(s, s + m))
                    names |= found
        out.append((doc, len(w), len(hit), sorted(names)))
    return Counter((d, n, h, tuple(x)) for d, n, h, x in out)


def spark_passages(spark, docs, items, window, **more):
    prepare(spark)
    d = spark.createDataFrame([(i, t, -1, "s", "i", "d", "m", 7) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "w", "i", 3, 9) for i, t in items], ITEMS)
    got = wu_manber.find_passages(d, b, window, **more).collect()
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert spans == wu_manber.merged(spans)
    return Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(r["items"])) for r in got)


def random_passages(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)
    words = ["a", "b", "Ça", "été", "x1", "日本", "ZZ", "9"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ", "]) for _ in range(n))
    items = [(k if k % 5 else 3, text(rng.choice([0, 1, 2, 3, 5, 9, 30]))) for k in range(n_items)]
    docs = [(k, text(rng.randrange(0, 40)) + (rng.choice(items)[1] if rng.random() < 0.4 else "") + text(5)) for k in range(n_docs)]
    return docs, items


@pytest.mark.parametrize("window,more", [(4, {}), (3, {"block_bytes": 40, "piece_words": 2}), (10, {"piece_words": 1})])
def test_passages_equal_brute_force(spark, window, more):
    docs, items = random_passages(window)
    items = [x for x in items if len(plain_words(x[1])) != 1] if window == 3 else items
    edge = [(None, "a b Ça été x1"), (5, None), (5, ""), (6, " .. "), (7, "a b c " * 20_000), (8, docs[3][1]), (8, docs[3][1])]
    items = [*items, (None, "x1 9 zz 日本"), (21, None), (22, ""), (23, "!!"), (24, "a b c " * 50), (24, "b Ça a b x1")]
    assert spark_passages(spark, docs + edge, items, window, **more) == plain_passages(docs + edge, items, window)


def test_passages_empty_tables(spark):
    assert not spark_passages(spark, [], [(1, "a b")], 4)
    assert spark_passages(spark, [(1, "a b c")], [], 4) == {(1, 3, 0, ()): 1}
    assert spark_passages(spark, [(1, "a b c")], [(1, None), (2, "..")], 4) == {(1, 3, 0, ()): 1}


def test_shift_table_skips_and_direct_comparison_decides():
    p = wu_manber.Patterns(10)
    words = [b"w%d" % k for k in range(10)]
    p.add(words, 0)
    looked = []

    class Seen(dict):
        def get(self, key, default=None):
            looked.append(key)
            return dict.get(self, key, default)

    p.shift = Seen(p.shift)
    assert p.search([b"other"] * 900) == []
    assert len(looked) == 99  # one block in nine words, from the tenth on
    near = [*words[:4], b"zz", *words[5:]]  # same first and last block
    assert p.search(near) == [] and p.search(words) == [(0, 0)]


# --- conversation trie ------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, key string, depth int, path string, n long, part int, salt int"


def plain_rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(k[2], k[4]) for k in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        out[c] = base[:h] + v[h:]
    return out


def plain_trie(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for a in range(len(p) + 1):
            leaves[p[:a]] += not kids[p]
            saved[p[:a]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "k", 1, "p", 2, 3, 4) for r in rows], TURNS)


def random_turns(seed, convs=230, alike=40):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "Äö😀 x", "more " * rng.randrange(3)])))
    rows += [(1000 + c, t, "user", "same") for c in range(alike) for t in range(4)]  # copies
    rows += [(2000 + c, t, "user", "grows") for c in range(30) for t in range(c + 1)]  # each a prefix of the next
    rows += [(None, 1, "user", "nobody"), (-250, 0, "user", "minus"), (-250, 0, "user", "minus"), (3005, 0, None, None), (3005, 0, None, "tie")]
    return rows


@pytest.mark.parametrize("rows,parts", [(20_000, None), (1, 5), (3, 2), (7, 40)])
def test_trie_equals_brute_force_however_it_is_cut(spark, rows, parts):
    table = random_turns(3)
    got = radix_trie.trie_nodes(radix_trie.rebuilt(turns_frame(spark, table)), chunk_rows=rows, parts=parts)
    assert got.columns == COLS
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(plain_rebuilt(table))


def test_trie_of_empty_and_turnless(spark):
    empty = radix_trie.trie_nodes(radix_trie.rebuilt(turns_frame(spark, [])))
    assert empty.count() == 0 and empty.columns == COLS
    # the first turns of an absent conversation are none: short ones are left without turns
    table = [(c, 0, "user", "x") for c in range(501, 520)]
    seqs = plain_rebuilt(table)
    assert any(not s for s in seqs.values())
    got = radix_trie.trie_nodes(radix_trie.rebuilt(turns_frame(spark, table)))
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(seqs)


def test_radix_tree_layouts():
    rng = random.Random(1)
    keys = sorted({bytes(rng.randrange(256) for _ in range(2 * rng.randrange(0, 5))) for _ in range(4000)} | {bytes([a, b]) for a in (0, 255) for b in range(256)})
    tree = radix_trie.RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    kinds, todo = Counter(), [tree.root]
    while todo:
        node = todo.pop()
        kinds[type(node).__name__] += 1
        kids = [k for _, k in node.children()]
        assert [b for b, _ in node.children()] == sorted(b for b, _ in node.children()) and all(node.get(b) is k for b, k in node.children())
        todo += kids
    assert set(kinds) == {"Node4", "Node16", "Node48", "Node256"}
    nodes = list(tree.aligned(2))
    paths = []
    for parent, depth, some, end in nodes:
        path = keys[some][: 2 * depth]
        paths.append(path)
        assert parent < 0 or paths[parent] == path[:-2]
        assert (end >= 0) == (path in set(keys)) if depth < 2 else end < 0 or keys[end] == path
    assert sorted(paths) == sorted({k[: 2 * d] for k in keys for d in range(len(k) // 2 + 1)})


def test_long_conversations(spark):
    n = 4000
    table = [(100, t, "user", "a") for t in range(n)] + [(101, t, "user", "a") for t in range(n - 1)]
    got = {r["depth"]: r for r in radix_trie.trie_nodes(radix_trie.rebuilt(turns_frame(spark, table)), chunk_rows=1, parts=2).collect()}
    assert len(got) == n + 1
    assert all(got[d]["n_convs"] == 2 and got[d]["saved_tokens"] == n - max(d, 1) for d in range(n))
    assert got[n]["n_children"] == 0 and got[n]["n_convs"] == 1 and got[0]["n_leaves"] == 1


# --- spelling groups --------------------------------------------------------------

WORDS = "doc_id long, text string, word string, n long, form string, root string, best string, blocks int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spellings(counts, ratio=5):
    words = sorted(counts)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        top = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def plain_counts(docs, every=199):
    counts = Counter()
    for doc, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spellings_of_documents_equal_brute_force(spark):
    prepare(spark)
    rng = random.Random(2)
    stems = ["Straßen", "étroite", "ABCDEFG", "Àéîõü÷x", "abcdefgh", "ÿÿÿÿÿÿ"]
    docs = [(k if k % 50 else None, " ".join(rng.choice(stems) + rng.choice(["", "s", "n", "日", "-x"]) for _ in range(60))) for k in range(250)]
    docs += [(9, None), (9, ""), (10, "…"), (11, "abcdefgh " * 40_000), (12, "x" * 50_000)] * 2
    frame = spark.createDataFrame([(i, t, "w", 1, "f", "r", "b", 2) for i, t in docs], WORDS)
    words = spelling_groups.vocabulary(frame, every=7)
    got = spelling_groups.group_spellings(words)
    assert sorted(map(tuple, got.collect())) == plain_spellings(plain_counts(docs, 7))
    assert words.count() > 30
    assert spelling_groups.group_spellings(spelling_groups.vocabulary(frame.limit(0))).count() == 0


@pytest.mark.parametrize("max_list", [4096, 5])
def test_spellings_in_lists_of_any_size(spark, max_list):
    prepare(spark)
    rng = random.Random(max_list)
    counts = {}
    while len(counts) < 600:
        w = "".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8])))
        counts[w] = rng.choice([5, 5, 25, 30, 125, 700, 4000])
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling_groups.group_spellings(frame, max_list=max_list)
    assert sorted(map(tuple, got.collect())) == plain_spellings(counts)


def test_near_pairs_for_any_shared_prefix():
    rng = random.Random(4)
    for shared in (0, 1, 3):
        head = "xyz"[:shared]
        pool = sorted({head + "".join(rng.choice("ab𝒳") for _ in range(rng.choice([3, 4]))) for _ in range(60)})
        size = shared + 3
        queries, targets = [w for w in pool if len(w) == size], pool
        q, t = spelling_groups.near_pairs(queries, targets, shared)
        assert sorted(zip(q.tolist(), t.tolist(), strict=True)) == [(i, j) for i, a in enumerate(queries) for j, b in enumerate(targets) if one_edit(a, b)]


def test_a_root_follows_all_forms(spark):
    prepare(spark)
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125}
    got = {r["word"]: r["root"] for r in spelling_groups.group_spellings(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"bbbbbb"}
    assert spelling_groups.group_spellings(spark.createDataFrame([], "word string, n long").select("word", F.col("n"))).count() == 0
