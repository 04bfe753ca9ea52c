"""What the corpus operators have in common: column names, samples, word hashes over Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Bytes of text that numpy handles at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the len + 1 offsets between them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    if n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in blocks of about ``size`` bytes: first row, end row, bytes, offsets within the bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words ``[^\\x20\\x09-\\x0D]+`` start and end, and the number of words before each text (and at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends where its text does
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from prefix sums; starts and ends ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE, n + 1)[ends] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a block, and the number of words before each text (and at the end)."""
    starts, ends, before = word_bounds(data, offsets)
    return byte_hashes(LOWER[data] if lower else data, starts, ends), before


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; starts and ends ascend."""
    parts = []
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        a = starts[i]
        parts.append(spans_hash(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (also across texts: callers mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return spans_hash(words, at, at + k)


def hash_sample(rows: DataFrame, most: int) -> DataFrame:
    """A row of each of ``most`` doc_ids (all, if there are no more): those with the least hashes.

    Only hashes are ordered, those of some more than ``most`` doc_ids, and one is sent to the driver.
    """
    mark = F.xxhash64(F.lit(5), F.col("doc_id"))
    count = rows.agg(F.approx_count_distinct("doc_id")).first()[0]
    low = rows if count <= 2 * most else rows.where(mark.cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64 * 1.5 * most / count))
    last = low.select(mark.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.where(mark <= last).dropDuplicates(["doc_id"]) if last is not None else rows.where("false")


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b; both long); the component is its least node.

    Alternates large-star and small-star steps until nothing changes, each round written as a table. No node's
    neighbours are gathered: rounds use minima (with partial aggregation) and joins that can be split where skewed.
    Nulls and loops are left out; no edges give no rows.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.cut(e, f"{label}-0")
    last, k = None, 0
    while (mark := e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()) != last and mark[0]:
        last, k = mark, k + 1
        e = scratch.cut(stars(e), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
