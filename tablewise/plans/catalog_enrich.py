"""Registered queries: enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tablewise.operators import enrich as E
from tablewise.plans import fixtures as fx
from tablewise.plans.registry import _with, query


def text_length_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model call: characters per text."""
    return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "n_chars": pdf["text"].str.len().astype("int64")})


def failing_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fails for any chunk holding a first turn: forces the whole-table fallback."""
    if (pdf["turn"] == 0).any():
        raise RuntimeError("ERROR: upstream refused the batch")
    return pdf


@query("e01_batch_enrichment", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars, TRUE AS _ok FROM conversations")
def q_e01(spark, sf):
    conv = fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return E.enrich_batches(conv, text_length_batch, "conv_id bigint, turn bigint, n_chars bigint", batch_size=30)


@query("e03_enrich_fallback", "SELECT conv_id, turn, role FROM conversations")
def q_e03(spark, sf):
    conv = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out, enhanced, _msg = E.enrich_or_fallback(conv, failing_batch, max_rows=None)
    assert not enhanced
    return out


_REPLY_SQL = """
rep AS (SELECT event_id, 'Sure, here is the result:' || chr(10) || '```json' || chr(10) || '[' || props || ']' || chr(10) || '```' AS reply
        FROM events)
"""


@query(
    "e02_parse_reply",
    _with(_REPLY_SQL)
    + "SELECT event_id, CAST(json_extract(regexp_extract(reply, '(\\[[\\s\\S]*\\])', 1), '$[0].k') AS BIGINT) AS k FROM rep",
)
def q_e02(spark, sf):
    ev = fx.table(spark, sf, "events")
    rep = ev.select("event_id", F.concat(F.lit("Sure, here is the result:\n```json\n["), "props", F.lit("]\n```")).alias("reply"))
    return E.parse_reply(rep, "reply", "k bigint", keep=["event_id"])


@query(
    "e04_standardize_text",
    "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS source FROM documents",
)
def q_e04(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text", "source")
    out = E.standardize_columns(d, ["text"], case="lower")
    return E.standardize_columns(out, ["source"])


@query(
    "e05_group_impute_mean",
    _with(fx.DIRTY_EVENTS_SQL,
          "g AS (SELECT event_type, avg(value) AS gv FROM dirty_ev WHERE event_type IS NOT NULL GROUP BY 1)")
    + """SELECT d.event_id, d.event_type,
               ROUND(coalesce(d.value, g.gv, (SELECT avg(value) FROM dirty_ev)), 6) AS value
         FROM dirty_ev d LEFT JOIN g ON d.event_type = g.event_type""",
)
def q_e05(spark, sf):
    out = E.impute_by_group(fx.dirty_events(spark, sf), "value", "event_type")
    return out.select("event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "e05_group_impute_mode",
    _with(fx.DIRTY_EVENTS_SQL,
          """g AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS gm FROM
                  (SELECT user_id, event_type, count(*) AS n FROM dirty_ev WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""",
          "m AS (SELECT event_type AS m FROM dirty_ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
    + "SELECT d.event_id, d.user_id, coalesce(d.event_type, g.gm, (SELECT m FROM m)) AS event_type FROM dirty_ev d LEFT JOIN g ON d.user_id = g.user_id",
)
def q_e05m(spark, sf):
    out = E.impute_by_group(fx.dirty_events(spark, sf), "event_type", "user_id", stat="mode")
    return out.select("event_id", "user_id", "event_type")


@query(
    "e06_anomaly_flags",
    _with("b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)")
    + "SELECT event_id, value, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE) AS value_outlier FROM events, b",
)
def q_e06(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "value")
    return E.anomaly_flags(ev, ["value"])


@query(
    "e07_latin1_safe",
    "SELECT doc_id, regexp_replace(replace(replace(replace(translate(text, 'aeou', '’—€ł'), '’', ''''), '—', '-'), '€', 'EUR'),"
    " '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents",
)
def q_e07(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.translate("text", "aeou", "’—€ł").alias("text"))
    return E.latin1_columns(d, ["text"])
