"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annforest, chat, chunkbpe, convrepair, decontaminate, mainhtml, merkle, pii, quality, simjoin, tokenbits, toxicity, warc
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_decontaminate", decontaminate.ORACLE)
def op1(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op2_ngram_jaccard_join", simjoin.ORACLE)
def op2(spark, sf_dir):
    return simjoin.jaccard_components(documents(spark, sf_dir), width=4, num=85, den=100)


@query("op7_token_bit_packing")
def op7(spark, sf_dir):
    return tokenbits.token_table(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query("op9_chunk_bpe")
def op9(spark, sf_dir):
    return chunkbpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query("op6_quality_rff")
def op6(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op8_toxicity_nnpu")
def op8(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op3_warc_derivatives")
def op3(spark, sf_dir):
    made = warc.derivatives(warc.responses(documents(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "block_length", F.sha2("record", 256).alias("record_sha256")
    )


@query("op4_hash_prefix_forest")
def op4(spark, sf_dir):
    return annforest.nearest(documents(spark, sf_dir, "embeddings"))


@query("op5_pii_boosted_candidates")
def op5(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


_CHATS = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
   UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(i, r)),
 f AS (SELECT *, length('### ' || role || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10)) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id
"""


@query("op10_chat_formatting", _CHATS)
def op10(spark, sf_dir):
    turns = chat.canonical_turns(documents(spark, sf_dir, "conversations"))
    own = chat.canonical_turns(chat.planted(spark))
    return chat.read_back(chat.format_turns(turns.union(own)))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir))


#: Exact for the given pages, whose article is marked as such.
_ARTICLES = r"""
WITH a AS (SELECT page_id, url, replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<br>', ' ') AS x FROM pages),
 b AS (SELECT page_id, url, list_transform(string_split_regex(x, '<[^>]*>'), lambda y: regexp_replace(replace(replace(replace(replace(
   y, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g')) AS x FROM a),
 c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(x, lambda y: trim(regexp_replace(y, '[\s\pZ]+', ' ', 'g'))), lambda y: y <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""


@query("op12_tag_path_text", _ARTICLES)
def op12(spark, sf_dir):
    return mainhtml.extract(documents(spark, sf_dir, "pages"))


@query("op13_conversation_repair", convrepair.ORACLE)
def op13(spark, sf_dir):
    return convrepair.repair(documents(spark, sf_dir, "conversations"))
