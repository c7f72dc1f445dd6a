"""Secret formats: length law, held-out recall, precision, and plain versions of search, tree and sample."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewise.llm import secret_grammar as G
from tests.conftest import SF001
from tests.llm.test_documents import docs

HEX, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def word(rng, symbols, n):
    return "".join(rng.choice(list(symbols), n))


FORMATS = {
    "hex": lambda r: word(r, HEX, 40),
    "access": lambda r: "AKIA" + word(r, UPPER, 16),
    "assign": lambda r: "sk_" + word(r, G.SYMBOLS[:62], 24),
}


@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.read.parquet(SF001 + "/documents.parquet").select("text").collect()
    return [t for (t,) in rows if t and not G.base_spans(t, G._runs(t))]


@pytest.fixture(scope="module")
def pairs(clean):
    return sum(G.pair_counts(t, []) for t in clean).reshape(G.WIDTH, G.WIDTH)


@pytest.mark.parametrize("kind", FORMATS)
@pytest.mark.parametrize("n", [130, 1000])
def test_held_out_values_are_found_without_labels(kind, n, clean, pairs):
    rng = np.random.default_rng(n)
    make = FORMATS[kind]
    models = G.Grammars({kind: [G.infer(v) for v in G.families([make(rng) for _ in range(n)])]}, pairs)
    held = [make(rng) for _ in range(200)]
    assert np.mean([models.accepts(v) for v in held]) >= 0.9
    # the length is part of the format
    assert not any(models.accepts(v + word(rng, HEX, 24)) or models.accepts(v * 5) for v in held)
    assert not any(models.accepts(v[: len(v) // 3]) for v in held)
    # in a text, found at its place whatever stands around it
    for v in held[:20]:
        text = f"é siehe {v}. Ende"
        assert any(text[s:e] == v or k < 3 for s, k, e in G.find(text, models))
    assert not [t for t in clean if any(k == 3 for _, k, _ in G.find(t, models))]


def test_two_formats_of_one_kind_stay_apart(pairs):
    rng = np.random.default_rng(5)
    values = [word(rng, HEX, 40) for _ in range(200)] + [word(rng, UPPER, 24) for _ in range(200)]
    models = G.Grammars({"assign": [G.infer(v) for v in G.families(values)]}, pairs)
    assert models.accepts(word(rng, HEX, 40)) and models.accepts(word(rng, UPPER, 24))
    assert not models.accepts(word(rng, UPPER, 40)) and not models.accepts(word(rng, HEX, 10))


def test_candidates_equal_a_plain_search(clean, pairs):
    """The bound that passes over the text first loses nothing."""
    rng = np.random.default_rng(6)
    models = G.Grammars({k: [G.infer([f(rng) for _ in range(130)])] for k, f in FORMATS.items()}, pairs)
    texts = [f"x={word(rng, HEX, 40)}, /a/{FORMATS['assign'](rng)}.txt token={word(rng, HEX, 20)}... ü{FORMATS['access'](rng)[:18]}" for _ in range(40)]
    found = 0
    for text in [*texts, *clean, "", "........" * 50, "=" * 20]:
        base = G.base_spans(text, G._runs(text))
        want = []
        for keys in (r"[A-Za-z0-9+/_.=-]+", r"[A-Za-z0-9+_-]+"):
            hidden = "".join(" " if any(s <= i < e for s, _, e, _ in base) else c for i, c in enumerate(text))
            for m in re.finditer(keys, hidden):
                v = m[0].rstrip(".")
                s, e = m.start(), m.start() + len(v)
                if len(v) >= 8 and models.accepts(v) and not any(b < e and s < t for b, t in want):
                    want.append((s, e))
        got = sorted((s, e) for s, k, e in G.find(text, models) if k == 3)
        assert got == sorted(want)
        found += len(got)
    assert found >= 40


def test_pair_counts_equal_a_plain_count():
    text = "abc de7 19 é-b password=abcdefgh x"
    want = {}
    hidden = text.replace("password=abcdefgh", " " * 17)
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", hidden):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            continue
        at = [0, *(G.SYMBOLS.index(c) + 1 for c in v), 0]
        for a, b in zip(at, at[1:]):
            want[a, b] = want.get((a, b), 0) + 1
    got = G.pair_counts(text, G.base_spans(text, G._runs(text))).reshape(G.WIDTH, G.WIDTH)
    assert {(int(a), int(b)): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == want
    assert G.pair_counts("", []).sum() == 0


def test_states_of_a_fixed_format_are_those_of_the_tree():
    """Nothing merges across depths of a format with one length: plain frequencies per depth."""
    rng = np.random.default_rng(7)
    values = ["ab" + word(rng, "0123456789", 6) for _ in range(200)]
    model = G.infer(values, few=60)
    assert len(model.moves) == 9
    total = sum(map(len, values))
    state = 0
    for d in range(8):
        stop = 0.5 / 201
        for ch in set("".join(values)):
            share = sum(v.count(ch) for v in values) / total
            n = sum(v[d] == ch for v in values)
            assert math.isclose(model.moves[state][ch][0], math.log((1 - stop) * (n + 12 * share) / 212))
        assert model.ends[state] == math.log(stop)
        state = model.usual[state]
    assert model.ends[state] == math.log(200.5 / 201)


def test_a_loop_is_learned_where_lengths_vary():
    rng = np.random.default_rng(8)
    model = G.infer([word(rng, "ab", int(n)) for n in rng.geometric(0.1, 400)])
    assert len(model.moves) <= 4  # merged into few states with loops
    assert G.infer([]).ends and len(G.infer(["x" * 1000] * 40).moves) <= G.DEPTH + 2


def test_training_sample_is_the_smallest_hashes(spark):
    values = [("hex", f"v{i:05d}") for i in range(3000)] + [("access", "a"), ("access", "b")]
    table = spark.createDataFrame(values, "kind string, value string").repartition(7)
    got = sorted(map(tuple, G.training_sample(table, 50).collect()))
    signed = {v: xxhash.xxh64_intdigest(v, 42) for _, v in values}
    low = sorted((h - 2**64 if h >= 2**63 else h, v) for v, h in signed.items() if v.startswith("v"))[:50]
    assert got == sorted([("hex", v) for _, v in low] + [("access", "a"), ("access", "b")])


def test_very_long_and_short_labels(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"token={word(rng, HEX, 5000)} und secret: {word(rng, UPPER, 9)}", "de", "s") for i in range(40)]
    d = docs(spark, [*rows, (None, None, None, None), (99, "nichts hier", "de", "s")])
    models = G.learn(d, train_length=100)
    assert len(models["assign"]) == 1 and models["assign"][0].shortest == 9  # the longest were not learned from
    out = G.scan(d, models)
    assert out.count() == 42 and out.agg(F.sum("n_assign")).first()[0] == 80
