"""Exact top-k search by inner product: every query against every vector, term at a time.

A vector is a sparse row of whole numbers (a term is a component that isn't zero). Queries are dealt into blocks, vectors
into parts; each block meets each part once, in one task, where the vectors stream by in chunks. A chunk is turned into
posting lists (of each component the rows and weights that have it); a query's terms scatter their weighted postings into
a dense array of scores, one term after the other. Of each array the places at or above the query's k-th score so far are
selected and merged into its best. What a task keeps is a block of queries, a chunk, and k results a query; the results of
parts are merged by query.

Work is queries times vectors, as the search is exhaustive. What is sent is each vector once for every block of queries
and each query once for every part, so larger blocks and parts send less.

Defined results: vectors that are null, or hold null or non-finite components, or one of ``LIMIT`` or more after scaling
(a score of it may not fit a long), take no part, and give no rows as queries; a component that only one of two vectors
has counts as zero in the other; of equal scores the smaller vec_id comes first; rows that share the query's vec_id are
its own and no candidates; repeated rows are candidates each, and equal repeated queries one query (others are queries
of their own, whose ranks each start at 1); a null vec_id is no query, and no candidate; an empty table gives no rows;
other columns than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Queries of a block, vectors of a part, vectors of a chunk.
QUERY_BLOCK, PART_ROWS, CHUNK = 4096, 1 << 20, 8192
#: Scaled components are below this: with up to 32,768 of them a score fits a long.
LIMIT = 1 << 24
_RESULT = "query_id long, query_mark long, vec_id long, score long"


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as an array of int; null if the vector takes no part."""
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT / scale - 1))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(whole, lambda x: x.cast("int")))


def _padded(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of a table, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Of each component: the rows that have it (a slice, where all have) and its weights there."""
    out = []
    for column in np.ascontiguousarray(rows.T):
        at = np.flatnonzero(column)
        out.append((slice(None), column) if len(at) == len(column) else (at, column[at]))
    return out


class Best:
    """The k best (score, vec_id) of each query so far, in order."""

    def __init__(self, k: int, queries: list[tuple[int, int, np.ndarray]]):
        self.k, self.queries = k, queries
        self.terms = [(np.flatnonzero(q), q[q != 0]) for *_, q in queries]
        self.scores = [np.zeros(0, np.int64)] * len(queries)
        self.ids = [np.zeros(0, np.int64)] * len(queries)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """All queries against a chunk of vectors."""
        lists = postings(rows)
        for i, (own, _, _) in enumerate(self.queries):
            dense = np.zeros(len(ids), np.int64)
            for term, weight in zip(*self.terms[i]):
                if term < len(lists):
                    at, weights = lists[term]
                    dense[at] += weight * weights
            self._merge(i, own, ids, dense)

    def _merge(self, i: int, own: int, ids: np.ndarray, dense: np.ndarray) -> None:
        more = self.k + int(np.count_nonzero(ids == own))
        if len(self.scores[i]) == self.k:
            least = self.scores[i][-1]
        elif len(dense) > more:
            least = np.partition(dense, len(dense) - more)[len(dense) - more]
        else:
            least = dense.min()
        at = np.flatnonzero(dense >= least)
        if len(at) > 4 * more:  # ties at the least, or a first chunk that was poor: select among these
            least = np.partition(dense[at], len(at) - more)[len(at) - more]
            at = at[dense[at] >= least]
        at = at[ids[at] != own]
        scores, found = np.concatenate([self.scores[i], dense[at]]), np.concatenate([self.ids[i], ids[at]])
        order = np.lexsort((found, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[order], found[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        queries = np.repeat(np.array([q[0] for q in self.queries], np.int64), n)
        marks = np.repeat(np.array([q[1] for q in self.queries], np.int64), n)
        columns = [queries, marks, np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])]
        return pa.record_batch([pa.array(c) for c in columns], ["query_id", "query_mark", "vec_id", "score"])


def _searched(k: int):
    """Rows sorted by block, part and kind: the queries of a meeting, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, queries, best = None, [], None
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in range(3)], 1)
                ids, marks, rows = part.column(3).to_numpy(), part.column(4).to_numpy(), _padded(part.column(5))
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    if tuple(keys[a, :2]) != meeting:
                        if best is not None:
                            yield best.rows()
                        meeting, queries, best = tuple(keys[a, :2]), [], None
                    if keys[a, 2] == 0:
                        queries += list(zip(ids[a:b].tolist(), marks[a:b].tolist(), rows[a:b]))
                    elif queries:
                        best = best or Best(k, queries)
                        best.meet(ids[a:b], rows[a:b])
        if best is not None:
            yield best.rows()

    return run


def top_k(vectors: DataFrame, k: int = 10, modulus: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: of each query its ``k`` highest inner products.

    ``vectors`` has vec_id and embedding; queries are the rows whose vec_id is divisible by ``modulus``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("terms"))
    rows = Scratch(spark, "top-k").cut(rows.where("vec_id is not null and terms is not null").withColumn("mark", F.xxhash64("terms")), "vectors")
    asked = rows.where(F.col("vec_id") % modulus == 0).distinct()
    n_rows, n_queries = rows.count(), asked.count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    n_parts = max(1, -(-n_rows // PART_ROWS), -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id"), F.col("mark")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(n_parts)).cast("int")  # repeated rows are spread, too
    queries = asked.select(spread(n_blocks, 1).alias("block"), every(n_parts).alias("part"), F.lit(0).alias("kind"), "vec_id", "mark", "terms")
    others = rows.select(every(n_blocks).alias("block"), "vec_id", "mark", "terms", part.alias("part")).select("block", "part", F.lit(1).alias("kind"), "vec_id", "mark", "terms")
    met = queries.unionByName(others).repartition(n_blocks * n_parts, "block", "part").sortWithinPartitions("block", "part", "kind")
    found = met.mapInArrow(_searched(k), _RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
