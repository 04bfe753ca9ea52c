"""The queries of the corpus operators: each applies its operator to the whole of its table.

``queries`` and ``oracle_sql`` are what ``__spark_entry__`` adds to its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm_language, toxicity_pu
from .exact_topk import top_k
from .fixity import fixity_audit
from .importance import importance_digest
from .jaccard_join import jaccard_classes
from .line_block import extract_main_text
from .metric_join import near_vectors
from .packing import pack_documents
from .pareto_mix import mix_digest
from .point_in_time import labelled_features
from .sql import ORACLES
from .substring_dedup import substring_dedup_digest
from .tiff import text_media


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """Pages as a second archive might hold them: every 97th with a NUL after its end, every 211th empty."""
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).when(F.col("page_id") % 211 == 7, F.lit("")).otherwise(F.col("html"))
    return pages.withColumn("html", html)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity_audit(pages, damaged_replica(pages))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=80)


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity_pu.score_toxicity(docs, toxicity_pu.learn(docs, labels, modulus=5, remainder=0))
    held_out = toxicity_pu.is_held_out(F.col("doc_id"), 5, 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.98)


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = ppm_language.identify_language(docs.select("doc_id", "text"), ppm_language.learn(docs.select("doc_id", "text", "lang"), modulus=4, remainder=2))
    return named.select("doc_id", ppm_language.is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_line_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_copies=2.0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, capacity=2048, end_id=0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=10, modulus=100, scale=1024)


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    return labelled_features(documents, table(spark, sf_dir, "labels").select("doc_id"), fresh_seconds=60)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_fixity": op1_warc_fixity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_tiff_media": op4_tiff_media,
        "op5_toxicity_pu": op5_toxicity_pu,
        "op6_metric_join": op6_metric_join,
        "op7_ppm_language": op7_ppm_language,
        "op8_line_block": op8_line_block,
        "op9_pareto_mix": op9_pareto_mix,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_exact_topk": op12_exact_topk,
        "op13_point_in_time": op13_point_in_time,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
