"""Importance resampling towards a target distribution over hashed word runs.

Two passes over texts. The first counts features (runs of 1 to 2 words) in ``BUCKETS`` hash buckets, a vector of a
partition by ``np.bincount``, which ``treeReduce`` adds up; so for the documents and for the target. The second gathers
the gain of each feature's bucket from the broadcast gains (one vector of ``BUCKETS``) and sums them by document with
``np.bincount`` weights. A document's weight is the floored mean of its gains; with the logarithm of a random number (a hash
of its doc_id) added to it, the highest scores are a sample without replacement that leans to the target.

Ranks need no order in one task: scores are whole numbers between two bounds that don't grow with the corpus, so their
histogram (at most some 100,000 numbers) gives each score's first rank, and rows are numbered within one score only.

Defined results: null and empty texts have no features and weight 0; a row of null doc_id has no score, isn't drawn and
isn't among the documents to draw from; of equal scores the smaller doc_id is drawn first, rows that share a doc_id in
order of features and weight (equal ones whichever); a text of any length is one document, a block of its own; an empty
table gives no rows, an empty target none in any bucket; columns of any other names pass by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import LOWER, Scratch, blocks, fresh

BUCKETS = 10_000
#: Words longer than this are hashed one by one.
_LONG = 48
_SPACE = 32
# Characters of words: ASCII letters and digits, and every byte of other characters.
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True


def _crc_table() -> np.ndarray:
    """The CRC-32 register after each byte value (polynomial 0xEDB88320, reflected)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each data[start:end], each going on from the CRC-32 ``before``; byte by byte for all spans at once."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32) if before is None else ~before.astype(np.uint32)
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, _LONG + 1), kind="stable")
    short = order[np.searchsorted(-lengths[order], -_LONG, side="left") :] if len(order) else order
    at, left, run = starts[short], lengths[short], state[short]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # spans with more than k bytes
        run[:n] = _crc_step(run[:n], data[at[:n] + k].astype(np.uint32))
    state[short] = run
    for i in order[: len(order) - len(short)]:
        state[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(~state[i])))
    return ~state


def feature_buckets(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole texts in blocks: first row, end row, words a row, and the row (from the first) and bucket of each feature."""
    for row, end, data, offsets in blocks(column):
        data = LOWER[data]
        solid = np.zeros(len(data) + 1, bool)
        solid[:-1] = _SOLID[data]
        first, last = solid[:-1].copy(), solid[:-1].copy()
        first[1:] &= ~solid[:-2]
        last &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends where its text does
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        words = np.bincount(owner, minlength=end - row)
        single = crc32_of(data, starts, ends)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        spaced = ~_crc_step(~single[pair], np.uint32(_SPACE))
        double = crc32_of(data, starts[pair + 1], ends[pair + 1], spaced)
        yield row, end, words, np.concatenate([owner, owner[pair]]), np.concatenate([single, double]).astype(np.int64) % buckets


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket: a vector of each partition, added up in a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in feature_buckets(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col("text").cast("string")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both with one more feature in each bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with its columns of ``names``: words, features and weight (the floored mean of the gains of features)."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)
    place = docs.columns.index("text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value.astype(np.float64)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, end, words, owner, found in feature_buckets(batch.column(place).cast(pa.string()), buckets):
                n = np.bincount(owner, minlength=end - row)
                total = np.bincount(owner, weights=gain[found], minlength=end - row)  # whole numbers below 2 to the 53
                out[:, row:end] = words, n, total.astype(np.int64) // np.maximum(n, 1)
            yield pa.record_batch([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *names])

    kind = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return docs.mapInArrow(weigh, kind)


def with_scores(frame: DataFrame, weight: str, score: str, seed: int) -> DataFrame:
    """``frame`` with ``score``: the weight and a Gumbel number of the doc_id, both in thousandths and floored."""
    key = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return frame.withColumn(score, F.col(weight) + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def _ranked(spark: SparkSession, scored: DataFrame, n: dict[str, str], least_words: int, percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... of the drawn documents, null of the others. It is read twice."""
    open_ = F.coalesce((F.col(n["words"]) >= least_words) & F.col(n["score"]).isNotNull(), F.lit(False))
    histogram = scored.where(open_).groupBy(n["score"]).agg(F.count("*").alias("n")).collect()  # bounded by the range of scores
    drawn = percent * sum(r["n"] for r in histogram) // 100
    firsts, seen = [], 0
    for r in sorted(histogram, key=lambda r: -r[0]):
        if seen >= drawn:
            break
        firsts.append((r[0], seen))
        seen += r["n"]
    if not firsts:
        return scored.withColumn(n["rank"], F.lit(None).cast("long"))
    table = F.broadcast(spark.createDataFrame(firsts, f"`{n['key']}` long, `{n['first']}` long"))
    high = open_ & (F.col(n["score"]) >= firsts[-1][0])
    place = F.row_number().over(Window.partitionBy(n["score"]).orderBy("doc_id", n["features"], n["weight"])) + F.col(n["first"])
    top = scored.where(high).join(table, F.col(n["score"]) == F.col(n["key"])).withColumn(n["rank"], place.cast("long"))
    top = top.withColumn(n["rank"], F.when(F.col(n["rank"]) <= drawn, F.col(n["rank"]))).drop(n["key"], n["first"])
    return top.unionByName(scored.where(~high).withColumn(n["rank"], F.lit(None).cast("long")))


def importance_ranks(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, texts: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (doc_id, text and any others) with words, features, weight, score and rank, and the names of these columns.

    ``target`` (text) is what the sample should look like. Of documents with at least ``least_words`` words ``percent``
    are drawn, those of the highest scores. Without ``texts``, only doc_id is kept of ``docs``.
    """
    spark = docs.sparkSession
    kinds = ("words", "features", "weight", "score", "rank", "key", "first")
    n = dict(zip(kinds, fresh(docs.columns, *[f"sample_{k}" for k in kinds])))
    gains = bucket_gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    numbers = weighed(docs, gains, (n["words"], n["features"], n["weight"]))
    if not texts:
        numbers = numbers.select("doc_id", n["words"], n["features"], n["weight"])
    scored = Scratch(spark, "importance").cut(with_scores(numbers, n["weight"], n["score"], seed), "scored")
    return _ranked(spark, scored, n, least_words, percent), {k: n[k] for k in kinds[:5]}


def importance_digest(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank."""
    ranked, of = importance_ranks(docs.select("doc_id", "text"), target, texts=False, **parameters)
    return ranked.select("doc_id", F.col(of["features"]).alias("n_features"), *[F.col(of[k]).alias(k) for k in ("weight", "score", "rank")])


def importance_sample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn documents, in the columns of ``docs``."""
    ranked, of = importance_ranks(docs, target, **parameters)
    return ranked.where(F.col(of["rank"]).isNotNull()).select(*docs.columns)
