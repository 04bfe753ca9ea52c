"""Language identification by prediction by partial matching (PPM, escape method C) over bytes.

For each language, a context tree of order ``ORDER`` counts which bytes follow which contexts in the learning texts. A
byte costs -log2 of its probability in the longest known context; where it has not been seen there, the escape of that
context and then its cost one order lower, down to all 256 bytes alike. Statistics are frozen: while texts are scored,
nothing is learned, so a byte's cost depends on the ``ORDER`` bytes before it only, and all costs can be tabulated: the
code length of a text is then a sum over its bytes. Tables hold only what was learned (single precision; sums are double),
for some languages together, so that they grow with the learning texts and not with the square of anything.

The trees are learned from a bounded sample: of each language the ``LEARN_DOCS`` documents with the least hashes of their
doc_id, of those with at most ``LEARN_CHARS`` characters; a language with fewer of them also learns from its longer texts,
shortest first. It stops before ``LEARN_SUM`` characters, or an equal share of ``LEARN_ALL`` where there are many
languages; where already the first text has more, it is learned from that many of its first characters. So every language
that a text is labelled with is learned. Whole texts are scored.

Defined results: null text and text without a letter are ``und`` with score 0; equal code lengths go to the first
language by name; texts of any length are scored in blocks; repeated rows and null doc_ids are scored like others, and
rows of equal doc_id and length are learned from once; no labelled rows at all: ``und`` for all; an empty table gives no
rows; columns that are kept may have any names but those of the results, which can be chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, blocks

ORDER = 3
LEARN_DOCS = 400
LEARN_CHARS = 20_000
LEARN_SUM = 2_000_000
LEARN_ALL = 64_000_000
#: Languages whose costs stand in one table: a looked-up row serves them all.
TOGETHER = 4


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class _Rows:
    """Numbers of 32-bit keys: an open table with linear probing, at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        slots = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(65 - slots.bit_length())
        self.keys, self.at = np.zeros(slots, np.uint32), np.full(slots, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several keys for one slot, one stays
            lost = self.at[slot] != left
            self.keys[slot[~lost]] = keys[left[~lost]]
            left, slot = left[lost], (slot[lost] + 1) & (slots - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._first(keys)
        out = self.at[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            out[left] = self.at[slot]
            on = (self.keys[slot] != keys[left]) & (out[left] >= 0)
            left, slot = left[on], slot[on]
        return out


class _Tables:
    """Costs in bits under some languages. Keys are the bytes of a context and the next byte, as one number."""

    def __init__(self, texts: list[list[bytes]], order: int):
        self.order, n = order, len(texts)
        self.pairs: list[_Rows] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[_Rows] = []
        self.escapes: list[np.ndarray] = []
        data = [_padded(*_joined(t), order) for t in texts]
        for k in range(order + 1):
            found = [np.unique(_keys(padded, at, k), return_counts=True) for padded, at in data]
            keys = np.unique(np.concatenate([f for f, _ in found]))
            counts = np.zeros((len(keys), n))
            for j, (f, c) in enumerate(found):
                counts[np.searchsorted(keys, f), j] = c
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                here = -np.log2(counts / (total + kinds)[of])
            lower = self._at(keys & np.uint32((1 << 8 * k) - 1), k - 1)
            self.pairs.append(_Rows(keys))
            self.costs.append(np.where(counts > 0, here, escape[of] + lower).astype(np.float32))
            self.contexts.append(_Rows(contexts))
            self.escapes.append(escape.astype(np.float32))

    def _at(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs by the last k bytes and the next one; 8 bits each for k = -1."""
        n = self.costs[0].shape[1] if self.costs else 1
        if k < 0:
            return np.full((len(keys), n), 8.0, np.float32)
        row = self.pairs[k].find(keys)
        out = self.costs[k][row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            own = keys[miss]
            context = self.contexts[k].find(own >> np.uint32(8))
            escape = np.where((context >= 0)[:, None], self.escapes[k][context], np.float32(0))
            out[miss] = escape + self._at(own & np.uint32((1 << 8 * k) - 1), k - 1)
        return out

    def lengths(self, padded: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cost = self._at(_keys(padded, at, self.order), self.order)
        sums = np.zeros((len(at) + 1, cost.shape[1]))
        np.cumsum(cost, axis=0, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``order`` bytes of start context before each, and where the texts' own bytes are."""
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)) * order, np.diff(offsets))
    padded = np.full(len(data) + (len(offsets) - 1) * order, 10, np.uint8)
    padded[at] = data
    return padded, at


def _keys(padded: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    key = padded[at].astype(np.uint32)
    for j in range(1, k + 1):
        key |= padded[at - j].astype(np.uint32) << np.uint32(8 * j)
    return key


class ContextTrees:
    """One tree for each language, as tables of costs in bits."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        if not 0 <= order <= 3:
            raise ValueError("a context and the next byte are four bytes at most")
        self.languages, self.order = sorted(texts), order
        self.tables = [_Tables([texts[x] for x in self.languages[k : k + TOGETHER]], order) for k in range(0, len(self.languages), TOGETHER)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length in bits of each text under each language."""
        if not len(data):
            return np.zeros((len(offsets) - 1, len(self.languages)))
        padded, at = _padded(data, offsets, self.order)
        return np.concatenate([t.lengths(padded, at, offsets) for t in self.tables], axis=1)


def _scores(trees, names: tuple[str, ...]):
    """The last two columns are the text and whether it has a letter; the others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        for batch in batches:
            n = batch.num_columns - 2
            has_letter = np.asarray(batch.column(n + 1))
            for row, end, data, offsets in blocks(batch.column(n), 1 << 19):
                bits = own.lengths(data, offsets)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                share = 1 / np.exp2(-(bits - least[:, None])).sum(axis=1)
                ok = has_letter[row:end]
                size = np.maximum(np.diff(offsets), 1)
                scored = [
                    pa.array([own.languages[b] if k else "und" for b, k in zip(best, ok)], pa.string()),
                    pa.array(np.where(ok, share, 0.0)),
                    pa.array(np.where(ok, least / size, 0.0)),
                ]
                passed = [c[row:end] for c in batch.columns[:n]]
                yield pa.record_batch([*passed, *scored], [*batch.schema.names[:n], *names])

    return run


def learn(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> ContextTrees | None:
    """Trees from text and lang of the documents that are not held out; None if there are none.

    Three passes over the table, however many languages there are: documents by language (an estimate of distinct
    doc_ids), which to learn from (without their texts; map-side, only the least hashes go on), their texts.
    """
    scratch = Scratch(docs.sparkSession, "ppm-language")
    size = F.length("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where(F.col("lang").isNotNull() & (size > 0) & ~is_held_out(F.col("doc_id"), modulus, remainder))
    short = F.col("size") <= LEARN_CHARS
    rows = own.select("lang", "doc_id", size.alias("size"), F.xxhash64(F.lit(5), "doc_id").alias("h"))
    counts = scratch.cut(rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("h"))).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    # Of many documents, four times as many as wanted are candidates.
    share = F.least(F.lit(1.0), F.lit(4.0 * LEARN_DOCS) / F.greatest("n", F.lit(1)))
    candidate = F.when(short, F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)).otherwise(F.col("n") < 2 * LEARN_DOCS)
    found = rows.join(counts, "lang").where(candidate).select("lang", "doc_id", "size", "h").distinct()
    order = Window.partitionBy("lang").orderBy(~short, F.when(~short, F.col("size")), "h", "doc_id", "size")
    ranked = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEARN_DOCS)
    most = max(1, min(LEARN_SUM, LEARN_ALL // languages))
    chosen = ranked.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= most) | (F.col("k") == 1))
    chosen = scratch.cut(chosen.select(F.col("lang").alias("l"), F.col("doc_id").alias("d"), F.col("size").alias("n"), "k"), "chosen")  # at most LEARN_ALL characters
    fit = (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d")) & (size == F.col("n"))
    picked = own.join(F.broadcast(chosen), fit).groupBy("lang", "k").agg(F.min(F.substring("text", 1, most)).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(picked.collect()):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return ContextTrees(texts)


RESULTS = ("lang_pred", "score", "bits_per_byte")


def identify_language(docs: DataFrame, trees: ContextTrees | None, keep: list[str] | None = None, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """doc_id (or the columns ``keep``) with the language, its share in all likelihoods, and bits a byte, called ``names``."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep or ["doc_id"]))
    if trees is None:
        return kept.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.lit(0.0)))))
    text = F.col("text").cast("string")
    plain = docs.select(*(F.col(f"`{c}`") for c in kept.columns), text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    return plain.mapInArrow(_scores(shared, names), schema)
