"""The corpus pipeline against its stages in plain Python."""

import re

import numpy as np

from tests.conftest import SF001
from tests.llm.test_documents import plain_fingerprint, plain_pieces


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline as P
    from tablewise.llm import lang_rank, mix_weights, secret_grammar
    from tablewise.llm.common import store

    docs = spark.read.parquet(SF001 + "/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    # 1 every document has letters of a learned language
    d1 = store(P.STAGES[0][1](spark, docs, SF001))
    assert d1.columns == docs.columns and d1.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t, _, _ in rows)
    judged = {r[0]: r[1] for r in lang_rank.language_id(docs).select("doc_id", "lang_pred").collect()}
    assert np.mean([judged[i] == la for i, _, la, _ in rows]) > 0.95
    # 2 one document per component
    fp = {i: plain_fingerprint(t) for i, t, _, _ in rows}
    group = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if bin(fp[i] ^ fp[j]).count("1") <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    d2 = store(P.STAGES[1][1](spark, d1, SF001))
    kept = sorted(i for i, g in group.items() if i == g)
    assert sorted(r[0] for r in d2.select("doc_id").collect()) == kept
    # 3 all stay, no base match is left
    d3 = store(P.STAGES[2][1](spark, d2, SF001))
    texts = dict(d3.select("doc_id", "text").collect())
    assert sorted(texts) == kept and not any(secret_grammar.base_spans(t, secret_grammar._runs(t)) for t in texts.values())
    clean = {i: t for i, t, _, _ in rows}
    models = secret_grammar.learn(d2)
    assert all(texts[i] == clean[i] for i in kept if not secret_grammar.find(clean[i], models))
    # 4 copies as the mix says
    copies = dict(mix_weights.mix(d3).select("doc_id", "copies").collect())
    d4 = store(P.STAGES[3][1](spark, d3, SF001))
    got = {r[0]: r[1] for r in d4.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c} and d4.columns == docs.columns
    # 5 pieces are the tokenizer's, sequences are gapless
    out = P.run(spark, SF001).toPandas()
    want = plain_pieces([(i, texts[i], None, None) for i, c in got.items() for _ in range(c)])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out[cols].astype(int).to_numpy().tolist())) == sorted(map(tuple, want))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_dir):
    import corpus_pipeline as P

    spark.read.parquet(SF001 + "/documents.parquet").limit(0).write.parquet(tmp_dir + "/documents.parquet")
    assert P.run(spark, tmp_dir).count() == 0


def test_registered(spark):
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
