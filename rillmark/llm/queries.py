"""The operators of this package as registered queries, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.deploy import ship_package
from rillmark.llm.entropy_mix import mix_documents
from rillmark.llm import sql, zstd_toxicity
from rillmark.llm.jsd_quality import judge, references
from rillmark.llm.kk_shards import shard_documents
from rillmark.llm.langid import held_out, identify_languages, learn
from rillmark.llm.line_chunks import remove_repeated_chunks
from rillmark.llm.partenum import jaccard_components
from rillmark.llm.qgram_leaks import leaked_passages
from rillmark.llm.suffix_dedup import remove_repeats
from rillmark.llm.url_templates import judge_urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jsd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judged = judge(docs, references(docs))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = zstd_toxicity.learn(docs.where(~held_out()), _read(spark, sf_dir, "labels"))
    scored = zstd_toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_chunks(_read(spark, sf_dir, "documents"), runs=True)


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), percent=85, shingle=4)


def op9_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_read(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jsd_quality": op1_jsd_quality,
    "op2_kk_shards": op2_kk_shards,
    "op3_zstd_toxicity": op3_zstd_toxicity,
    "op4_line_chunks": op4_line_chunks,
    "op5_url_templates": op5_url_templates,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_word_first_langid": op7_word_first_langid,
    "op8_partenum_jaccard": op8_partenum_jaccard,
    "op9_qgram_leaks": op9_qgram_leaks,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op1_jsd_quality": sql.jsd_quality(),
    "op5_url_templates": sql.url_templates(),
    "op6_entropy_mix": sql.entropy_mix(),
    "op8_partenum_jaccard": sql.jaccard_components(),
    "op10_suffix_dedup": sql.suffix_dedup(),
}
