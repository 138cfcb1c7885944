"""The registered query of each operator, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_profiles, nn_descent, quality_fm
from .chunk_dedup import substring_repeats
from .common import table
from .conversation_repair import damaged, repair, summaries
from .line_blocks import extract_main_text
from .line_dedup import drop_lines
from .nra_search import search
from .prefix_hashes import fingerprints
from .sentencepiece_codec import encode_documents
from .simhash_tiles import near_duplicates
from .string_tiling import contaminated
from .token_counts import LIMIT, token_prefixes

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


@query("op2_quality_fm")
def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_fm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


@query("op3_simhash_tiles")
def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_language_profiles")
def op4_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_profiles.identify(docs, language_profiles.learn(docs))
    return told.select("doc_id", language_profiles.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_sentencepiece_codec")
def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_nn_descent")
def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_chunk_dedup")
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats(table(spark, sf_dir, "documents"))


@query("op8_string_tiling")
def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
with lines as (
    select doc_id, u.i as i, u.line as line, translate(trim(u.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
         (select unnest(range(len(ls))) as i, unnest(ls) as line) u
),
common as (select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
told as (select l.doc_id, l.i, l.line, c.k is not null and l.doc_id <> c.keeper as gone from lines l left join common c on c.k = l.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from told group by doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_line_blocks")
def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return summaries(repair(damaged(turns)), turns)


OP12_SQL = r"""
with term_lists as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
    from documents where text is not null
),
docs as (select doc_id, ts, len(ts)::bigint as n from term_lists where len(ts) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as all_terms from docs),
tfs as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(ts) as term from docs) u group by all),
wanted as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tfs, total group by term, n_docs),
scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // all_terms))))::bigint as score
    from wanted join tfs using (term) join weights using (term), total group by item_id, doc_id
)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0) r where rank <= 10
"""


@query("op12_nra_search", OP12_SQL)
def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_prefix_hashes")
def op13_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
