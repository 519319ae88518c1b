"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bagminhash, bm25, crf, gru, hilbert, jaccard, jpeg, pieces, quality, resample, suffixes, variants
from barloom.llm.common import documents


def op1_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score(documents(spark, sf_dir))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda span: span.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


def op7_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg.media(documents(spark, sf_dir))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), F.transform("pixel_sums", lambda v: v.cast("string"))).alias("feature"),
        F.sha2("tensor", 256).alias("tensor_sha256"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count(documents(spark, sf_dir))


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(documents(spark, sf_dir))


def op11_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.weigh(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))


_QUERIES = [op1_gru_scoring, op2_bagminhash, op3_bm25_decontamination, op4_suffix_array, op5_crf_pii, op6_sentencepiece, op7_empirical_bayes_quality, op8_progressive_jpeg, op9_token_counts, op10_hilbert_sharding, op11_combination_join, op12_importance_resampling, op13_spelling_variants]


def queries() -> dict:
    import corpus_pipeline

    return {q.__name__: q for q in _QUERIES} | {"pipeline": corpus_pipeline.run}


#: All pairs of sets that share a shingle, and the least doc_id that each reaches. Texts of equal sets are one first.
_COMBINATION_JOIN = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') as w from documents
), sets as (
    select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end)) as s
    from docs
), texts as (
    select row_number() over () as k, s, len(s) as n, min(doc_id) as least from sets where len(s) > 0 group by s
), words as (
    select k, n, unnest(s) as g from texts
), links as (
    select a.k as x, b.k as y from words a join words b on a.g = b.g and a.k <> b.k and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    group by a.k, b.k, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(k, other) as (
    select k, k from texts union select reached.k, links.y from reached join links on links.x = reached.other
), components as (
    select reached.k, min(texts.least) as component_id from reached join texts on texts.k = reached.other group by reached.k
)
select sets.doc_id, len(sets.s) as n_shingles, coalesce(component_id, doc_id) as component_id
from sets left join texts on texts.s = sets.s left join components on components.k = texts.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_combination_join": _COMBINATION_JOIN}
