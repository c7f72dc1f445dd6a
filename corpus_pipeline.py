"""Corpus pipeline: language ID, SimHash near-dedup, secret masking, mixing, packing.

Every stage takes the documents its predecessor kept and decides over all of them; its
result is written as Parquet in the shared checkpoint folder and read again as the next
stage's documents.  Stages 1 to 4 return the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewise.llm import bestfit_swap, lang_rank, mix_weights, secret_grammar, simhash_blocks
from tablewise.llm.common import discard, prepare, read_table, store

STAGES = [
    ("language_id", lang_rank.stage),
    ("simhash_near_dedup", simhash_blocks.stage),
    ("secret_masking", secret_grammar.stage),
    ("source_mix", mix_weights.stage),
    ("packing", bestfit_swap.stage),
]

#: Profiles, XXH64 fingerprints, automata and a tokenizer are not SQL; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _name, stage in STAGES:
        out = store(stage(spark, docs, sf_dir))
        discard(before)
        docs = before = out
    return docs
