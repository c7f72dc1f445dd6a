"""Document operators against plain Python, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewise.llm import bestfit_swap, hyper_shards, lang_rank, mix_weights, secret_grammar, simhash_blocks, suffix_dedup
from tablewise.llm.common import components, prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, component_id string, score string, row string"


def docs(spark, rows):
    """Documents with further columns whose names clash with what the operators add."""
    prepare(spark)
    return spark.createDataFrame([(i, t, la, s, len(t or ""), -1, "x", "y", "z", "w") for i, t, la, s in rows], SCHEMA)


EDGE = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n ", "fr", "b"),
    (6, "1234 5678 ...", "fr", ""),
    (None, "nulle part ailleurs", "fr", None),
    (8, "x" * 50_000 + " " + "mot " * 30_000, "fr", "c"),
    (9, "ÉTÉ Straße İstanbul \u00a0 \u2028 日本語 \x1c <|endoftext|> ﬁ", None, "c"),
]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- mixing -------------------------------------------------------------------


def fair_targets(sizes, weights, most=3):
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        share = (total - sum(capped.values())) / sum(weights[s] for s in free) if free else 0
        new = {s: most * sizes[s] for s in free if weights[s] * share > most * sizes[s]}
        if not new:
            return {s: capped.get(s, weights[s] * share) for s in sizes}
        capped |= new


def test_mix_targets_and_budget(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], p=[0.05, 0.35, 0.3, 0.2, 0.1], size=600).tolist())]
    out = mix_weights.mix(docs(spark, rows)).toPandas()
    assert len(out) == 600
    keys = ["a", "b", "c", "d", None]
    sizes = {k: sum(len(t.split()) for _, t, _, s in rows if s == k) for k in keys}
    want = fair_targets(sizes, dict(zip(keys, [5, 2, 1, 5, 2], strict=True)))
    for k in keys:
        part = out[out.source.isna()] if k is None else out[out.source == k]
        assert set(part.source_size) == {sizes[k]}
        assert part.target.iloc[0] == pytest.approx(want[k])
        assert abs(part.taken.sum() - want[k]) <= 20  # half the longest document
    assert (out.taken <= 3 * out["size"]).all() and (out.taken == out["size"] * out.copies).all()
    again = mix_weights.mix(docs(spark, rows[::-1]).repartition(7)).toPandas()
    assert dict(zip(out.doc_id, out.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_nested_and_edges(spark):
    rows = [(i, "a b c", "en", "s" + str(i % 2)) for i in range(200)]
    small = mix_weights.mix(docs(spark, rows), weights=(1.0, 9.0)).toPandas()
    large = mix_weights.mix(docs(spark, rows), weights=(2.0, 9.0)).toPandas()
    s, big = (dict(zip(x.doc_id, x.copies, strict=True)) for x in (small, large))
    assert all(s[i] <= big[i] for i in s if i % 2 == 0)  # a larger budget takes a superset
    edge = mix_weights.mix(docs(spark, EDGE)).toPandas()
    assert len(edge) == len(EDGE) and edge[edge.doc_id == 3]["size"].tolist() == [0]
    assert edge[edge.doc_id == 2].copies.nunique() == 1
    assert mix_weights.mix(docs(spark, EDGE).limit(0)).count() == 0
    kept = mix_weights.mixed_documents(docs(spark, EDGE))
    assert kept.columns == docs(spark, EDGE).columns and kept.count() == edge.copies.sum()


# --- language -----------------------------------------------------------------


def test_language_counts_and_edges(spark):
    codes, counts = lang_rank.gram_counts("Ab a")
    plain = {}
    for w in ("_ab_", "_a_"):
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g != "_":
                    plain[g] = plain.get(g, 0) + 1
    # the blank between two words is one character
    got = {}
    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
        s = "".join("_" if x == 1 else chr(x) for x in ((c >> 42), (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
        got[s] = n
    assert got == plain
    rows = [(i, t, la, "s") for i, (t, la) in enumerate([("the cat and the hat sat on that mat", "en"), ("le chat et le chapeau sont sur la table", "fr")] * 20)]
    out = lang_rank.language_id(docs(spark, rows + [(100 + (i or 0), t, None, s) for i, t, _, s in EDGE])).toPandas()
    assert len(out) == len(rows) + len(EDGE)
    assert (out[out.doc_id < 40].lang_pred == out[out.doc_id < 40].lang).all()
    assert set(out[out.doc_id.isin([103, 104, 105, 106])].lang_pred) == {"und"}
    assert out.score.between(0, 1).all()
    assert lang_rank.language_id(docs(spark, rows).limit(0)).count() == 0


def test_language_pieces_agree(monkeypatch):
    text = "Der schnelle braune Fuchs, springt -- über den  faulen Hund. " * 40
    whole = lang_rank.gram_counts(text)
    monkeypatch.setattr(lang_rank, "_PIECE", 17)
    parts = lang_rank.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_held_out_accuracy(spark):
    from tests.conftest import SF01

    table = spark.read.parquet(SF01 + "/documents.parquet")
    out = lang_rank.query(spark, SF01).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95


# --- SimHash ------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("max_run", [4096, 3])
def test_simhash_against_all_pairs(spark, max_run):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"], 60)) for _ in range(25)]
    texts = [" ".join(b.split()[: 60 - int(rng.integers(0, 5))]) for b in base for _ in range(4)]
    rows = [(i + 10, t, "en", "s") for i, t in enumerate(texts)] + [r for r in EDGE if r[0] is not None]
    out = simhash_blocks.near_duplicates(docs(spark, rows), max_run=max_run).toPandas()
    fp = {i: plain_fingerprint(t) for i, t, _, _ in rows}
    assert {i: f % (1 << 64) for i, f in zip(out.doc_id, out.fp, strict=True)} == fp and len(out) == len(rows)
    parent = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert {i: c for i, c in zip(out.doc_id, out.component_id, strict=True)} == {i: find(parent, i) for i in fp}


def test_simhash_edges_and_stage(spark):
    edge = docs(spark, EDGE)
    out = simhash_blocks.near_duplicates(edge)
    assert out.count() == len(EDGE) and out.where("fp = 0").select("component_id").distinct().count() == 1
    assert simhash_blocks.near_duplicates(edge.limit(0)).count() == 0
    kept = simhash_blocks.stage(spark, edge, "")
    assert kept.columns == edge.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [1, 3, 6, 8, 9]


def test_simhash_stage_with_repeated_ids(spark):
    rng = np.random.default_rng(21)
    a, b, c, d = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(4))
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (2, c, "en", "s"), (2, a, "en", "s"), (3, c, "en", "s"), (4, d, "en", "s"), (4, d, "en", "s"), (4, b, "en", "s")]
    found = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash_blocks.near_duplicates(docs(spark, rows)).collect()}
    assert found == {(i, plain_fingerprint(t)): {a: 1, b: 2, c: 2, d: 4}[t] for i, t, _, _ in rows}
    kept = simhash_blocks.stage(spark, docs(spark, rows), "")
    assert sorted(tuple(r) for r in kept.select("doc_id", "text").collect()) == sorted([(1, a), (2, b), (2, c), (4, d)])


def test_components_of_a_chain(spark):
    prepare(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    out = dict(components(edges).collect())
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- secrets ------------------------------------------------------------------


def plain_spans(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets_base_and_learned(spark):
    rng = np.random.default_rng(3)
    hexed = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    keys = ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)) for _ in range(60)]
    rows = [(i, f"é {h} und {k}, Token = '{h[:12]}' PASSWORD:kurz api_key=\"{k}", "de", "s") for i, (h, k) in enumerate(zip(hexed, keys, strict=True))]
    rows += [(200, "lose " + hexed[0][:28] + " ende", "de", "s"), (201, "Donaudampfschifffahrtsgesellschaftskapitaen 123", "de", "s")]
    rows += [(300 + (i or 0), t, la, s) for i, t, la, s in EDGE]
    d = docs(spark, rows)
    models = secret_grammar.learn(d)
    out = secret_grammar.scan(d, models).toPandas()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _, _ in rows}
    for i, b, n in zip(out.doc_id, out.base_spans, out.n_hex, strict=True):
        want = plain_spans(text[i])
        assert b == ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want) and n == sum(k == 2 for _, k, _ in want)
    spans = dict(zip(out.doc_id, out.spans, strict=True))
    assert spans[200] == "format:5:33" and spans[201] == ""  # a shorter digest is found by its format, a word is not
    masked = dict(secret_grammar.mask(d, models).select("doc_id", "text").collect())
    assert masked[200] == "lose [SECRET] ende" and masked[303] is None and masked[201] == text[201]
    staged = secret_grammar.stage(spark, d, "")
    assert staged.columns == d.columns and staged.where("n_chars <> length(text)").count() == 0


def test_secrets_without_labels(spark):
    d = docs(spark, EDGE)
    assert secret_grammar.learn(d) == {} and secret_grammar.scan(d, {}).where("spans <> ''").count() == 0
    assert secret_grammar.scan(d.limit(0), {}).count() == 0


def test_automaton_prefers_its_format():
    rng = np.random.default_rng(4)
    model = secret_grammar.infer(["ab" + "".join(rng.choice(list("0123456789"), 12)) for _ in range(200)])
    assert len(model.moves) < 50
    assert model.score("ab123456789012") > model.cut - 0.5 > model.score("zzzzzzzzzzzzzz")


# --- packing ------------------------------------------------------------------


def plain_pieces(rows, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bestfit_swap.default_vocabulary())
    out = []
    for i, t, _, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def test_packing_round_trip(spark):
    out = bestfit_swap.pack_documents(docs(spark, EDGE), bestfit_swap.default_vocabulary()).toPandas()
    got = [(None if i != i else int(i), p, s, n, c) for i, p, s, n, c in zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32, strict=True)]
    assert sorted(got, key=repr) == plain_pieces(EDGE)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert bestfit_swap.pack_documents(docs(spark, EDGE).limit(0), bestfit_swap.default_vocabulary()).count() == 0


def test_forgotten_words_are_encoded_again():
    rng = np.random.default_rng(8)
    path = bestfit_swap.default_vocabulary()
    small = bestfit_swap.WordIds(path, room=40)
    words = ["Wort", "it's", "don't", "naïve", "x9y", "straße.", "(a,b)", "...", "İ", "<|endoftext|>", "\u00a0", "12345", "''", "a'"]
    words += ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(300)]
    for _ in range(12):
        texts = [None, "", " \n", *(rng.choice([" ", "  ", "\n"]).join(rng.choice(words, 50)) for _ in range(8))]
        got = [x.tolist() for x in small.column(bestfit_swap.pa.array(texts, bestfit_swap.pa.string()))]
        assert got == [[*small.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert len(small.words) <= 40 + 400 and small.words.older


def fewest_bins(lengths, capacity):
    """The optimum by trying everything: pieces in order, each into every bin with another room or a new one."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[k]}:
            i = rooms.index(r)
            go(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_packing_against_all_packings_of_ten_pieces():
    rng = np.random.default_rng(6)
    over = 0
    for _ in range(40):
        lengths = rng.integers(5, 60, 10)
        bins = bestfit_swap.local_search(lengths, bestfit_swap.best_fit(lengths, 100), 100)
        assert sorted(i for b in bins for i in b) == list(range(10)) and all(lengths[b].sum() <= 100 for b in bins)
        least = fewest_bins(sorted(lengths.tolist(), reverse=True), 100)
        assert least <= len(bins) <= least + 1
        over += len(bins) - least
    assert over <= 4


def test_local_search_improves_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1000, 2000, 900)
    first = bestfit_swap.best_fit(lengths, 4096)
    better = bestfit_swap.local_search(lengths, first, 4096)
    assert len(better) < len(first)
    assert sorted(i for b in better for i in b) == list(range(900)) and all(lengths[b].sum() <= 4096 for b in better)


def test_packing_over_many_groups(spark):
    prepare(spark)
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    out = bestfit_swap.pack(pieces, 1000, group_rows=200).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert len(out) == 3000 and fill.max() <= 1000
    one = len(bestfit_swap.local_search(out.length.to_numpy(), bestfit_swap.best_fit(out.length.to_numpy(), 1000), 1000))
    assert len(fill) <= 1.03 * one  # 15 groups of 200 pieces lose little against one group


def test_exchange_tries_every_pair():
    # the only exchange that gains: the two shortest of the giving bin's 72 pieces (21 + 22) for the 42 of a bin with room for 1
    lengths = np.array([40] * 70 + [21, 22] + [42, 5957] + [5980] * 150)
    bins = [list(range(72)), [72, 73], *([i] for i in range(74, 224))]
    better = bestfit_swap.local_search(lengths, bins, 6000)
    assert sorted(i for b in better for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 6000 for b in better)
    assert {70, 71, 73} in [set(b) for b in better]


def test_packing_goes_on_while_bins_fall(spark):
    prepare(spark)
    rng = np.random.default_rng(9)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.choice([340, 510, 520, 480, 330], 1200))], "doc_id long, length long")
    one = bestfit_swap.pack(pieces, 1000, group_rows=30, refill=0.0).select("sequence_id").distinct().count()  # a single round
    out = bestfit_swap.pack(pieces, 1000, group_rows=30, refill=1.0).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert len(out) == 1200 and fill.max() <= 1000 and sorted(out.doc_id) == list(range(1200))
    assert len(fill) < one  # more than a quarter of the pieces are in underfull bins, and still fewer bins come out


# --- repeated strings ---------------------------------------------------------


def plain_removal(rows, window):
    texts = [(t or "").encode() for _, t, _, _ in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "max_run"), [(400, 20_000), (400, 2), (700, 20_000)])
def test_repeats_against_brute_force(spark, window, max_run):
    rng = np.random.default_rng(7)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdeé "), 6)) for _ in range(n))

    shared, rows = [words(120) for _ in range(3)], []
    for i in range(24):
        s = shared[i % 3]
        cut = int(rng.integers(0, 300))
        rows.append((i, words(40) + s[cut : len(s) - int(rng.integers(0, 200))] + words(30) + (s[:450] if i % 5 == 0 else ""), "en", "s"))
    rows += [(50, shared[0][:399], "en", "s"), (51, "ab" * 900, "en", "s"), (52, "q" * 1500, "en", "s"), (53, words(2000) + "q" * 700, "en", "s"), (54, words(50) * 3, "en", "s")]
    rows += [(i and i + 60, (t or "")[:3000] if t else t, la, s) for i, t, la, s in EDGE] + [(80, rows[0][1], "en", "s")]
    out = suffix_dedup.remove_repeats(docs(spark, rows), window=window, max_run=max_run)
    out = out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_removal(rows, window)


def test_texts_of_equal_hash_are_told_apart(spark, monkeypatch):
    rng = np.random.default_rng(13)
    real = suffix_dedup._text_id
    monkeypatch.setattr(suffix_dedup, "_text_id", lambda salt: real(salt) if salt else F.pmod(F.xxhash64("raw"), F.lit(5)))
    text = ["".join(rng.choice(list("abcdef "), 900)) for _ in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*text, text[3], "xy" + text[4][:500]])]
    out = suffix_dedup.remove_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_removal(rows, 400)


def test_repeats_edges(spark, monkeypatch):
    assert suffix_dedup.remove_repeats(docs(spark, EDGE).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, EDGE), window=200)
    text = np.random.default_rng(0).integers(97, 103, 20_000).astype(np.uint8).tobytes() + b"z" * 500
    whole = suffix_dedup.anchors(text)
    assert np.diff(whole).max() <= suffix_dedup.RUN
    monkeypatch.setattr(suffix_dedup, "_PIECE", 333)
    assert (suffix_dedup.anchors(text) == whole).all()


def test_repeats_of_zero_bytes(spark):
    rng = np.random.default_rng(11)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdeé "), 6)) for _ in range(n))

    assert len(suffix_dedup.anchors(bytes(1000))) == 993
    shared = words(40) + "\0" * 70 + words(8) + "\0" * 8 + words(50)
    broken = "".join(words(9) + "\0" * int(n) for n in rng.integers(8, 60, 12))
    rows = [(i, words(20) + s[int(rng.integers(0, 90)) : len(s) - int(rng.integers(0, 90))] + words(20), "en", "s") for i, s in enumerate([shared, broken] * 6)]
    rows += [(50, "\0" * 1500, "en", "s"), (51, words(60) + "\0" * 450 + words(10), "en", "s"), (52, "\0" * 399 + words(80), "en", "s"), (53, words(30) + "\0" * 20 + words(60), "en", "s")]
    for _, t, _, _ in rows:
        assert np.diff(suffix_dedup.anchors(t.encode())).max() <= suffix_dedup.RUN
    out = suffix_dedup.remove_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_removal(rows, 400)


# --- sharding -----------------------------------------------------------------


def test_shards_exact_and_uniform(spark):
    prepare(spark)
    df = spark.range(4003).select("id", F.lit("a").alias("shard"), F.lit(5).alias("slot"))
    out = hyper_shards.shuffle_shards(df, ["id"], 8, seed=3, rows_per_part=300).toPandas()
    assert sorted(out.id) == list(range(4003))
    counts = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and len(counts) == 8
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    again = hyper_shards.shuffle_shards(df.repartition(5), ["id"], 8, seed=3, rows_per_part=300).toPandas()
    assert dict(zip(out.id, zip(out["shard"], out.slot, strict=True), strict=True)) == dict(zip(again.id, zip(again["shard"], again.slot, strict=True), strict=True))
    expected = 4003 / 64  # ids of each eighth of the table in each shard
    table = out.assign(part=out.id * 8 // 4003).groupby(["part", "shard"]).size()
    assert ((table - expected) ** 2 / expected).sum() < 100  # 49 degrees of freedom


def test_shards_edges(spark):
    d = docs(spark, EDGE)
    out = hyper_shards.shuffle_shards(d, ["doc_id", "text"], 3)
    assert out.count() == len(EDGE) and set(out.columns) == set(d.columns) | {"slot"}
    assert hyper_shards.shuffle_shards(d.limit(0), ["doc_id"], 3).count() == 0
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [3, 3, 4]


def test_shard_files_keep_slot_order(spark, tmp_dir):
    prepare(spark)
    out = hyper_shards.shuffle_shards(spark.range(500), ["id"], 4)
    hyper_shards.write_shards(out, tmp_dir + "/s", files_per_shard=2)
    back = spark.read.parquet(tmp_dir + "/s")
    assert back.count() == 500 and back.select("shard").distinct().count() == 4


def test_hypergeometric_large_totals():
    rng = np.random.default_rng(1)
    draws = [hyper_shards.hypergeometric(rng, 3 * 10**9, 9 * 10**9, 4000) for _ in range(400)]
    assert abs(np.mean(draws) - 1000) < 6 and 20 < np.std(draws) < 35
    m = hyper_shards.communication_matrix([5, 0, 9, 7], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 7] and sorted(m.sum(axis=0).tolist()) == [5, 5, 5, 6]
