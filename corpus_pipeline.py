"""From documents to packed training sequences: five corpus operators in turn, each over all that the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
driver writes each result as Parquet and reads it back as the next stage's docs; ``run`` does so in the scratch folder.

Defined results of every stage but the last: columns other than doc_id, text, lang, source and n_chars pass by, whatever
their names are; texts of any length are handled whole; an empty table gives no rows of the same columns. What a stage does
with nulls, ties and repeated rows, it says itself.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.jaccard_join import jaccard_dedup
from quire.llm.packing import pack_documents
from quire.llm.pareto_mix import mixed_documents
from quire.llm.ppm_language import identify_language, learn
from quire.llm.shared import Scratch, fresh
from quire.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; only those named ``und`` (null text, or no letter) go.

    Null doc_id, lang or source and repeated rows make no difference; where no document has a lang to learn from, no
    language is known and all documents go. Ties between languages go to the first by name, and the document stays.
    """
    names = tuple(fresh(docs.columns, "lang_pred", "score", "bits_per_byte"))
    named = identify_language(docs, learn(docs), keep=docs.columns, names=names)
    return named.where(F.col(names[0]) != "und").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates.

    Documents without words, and those of null doc_id, stay; rows that share a doc_id stay or go together.
    """
    return jaccard_dedup(docs, size=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; documents of which nothing is left go.

    Null and empty texts go; a null doc_id is neither earlier nor later than another; rows that share a doc_id lose nothing
    to each other. n_chars is that of what is left, as a long.
    """
    kept = substring_dedup(docs, min_words=50)
    return kept.where("text <> ''").withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null source is a source of its own, last in order; documents without words are not taken; of rows that share a doc_id,
    null too, as many are taken as fit, each up to two times.
    """
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_copies=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is packed, as often as it stands there; null text is one piece with the end mark only.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language statistics, automata and tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
