"""Substring dedup: suffix automata of reference shards, matching statistics of the documents streamed past them.

A word goes when ``min_words`` consecutive words around it also stand in a document with a smaller doc_id.

The reference is the corpus itself, which has no size bound, so no automaton of all of it can be broadcast, and to
stream every document past every shard would be quadratic. A shard is therefore a reference document (a long one is
several, of ``SHARD_WORDS`` words that overlap by a window), its automaton is sent (once for every 256 documents routed to
it) to where these documents are streamed, and routes are found first:

1. Copies with the same word sequence are one class; its smallest doc_id speaks for it.
2. Of every window of ``min_words`` words, the least hashed ``ANCHOR``-word gram is its anchor. Equal windows have
   equal anchors, so windows whose anchor stands in one document only are settled.
3. The remaining windows are hashed; for each, the smallest document that holds it is the reference, and its shard
   there the one to stream past.
4. Every document with such windows is streamed past the automata of its references, a long one shard by shard too: a
   shard of it meets those that hold its own windows and no others. The matching statistics alone decide what goes:
   maximal spans of at least ``min_words`` words.

Defined results: null text is no words; null doc_id is never a reference and loses nothing; repeated rows with one
doc_id are no references of each other; texts of any length are handled in pieces of bounded size; an empty table gives
no rows; columns of any other names pass by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOCK_BYTES, Scratch, blocks, fresh, grams, word_hashes

ANCHOR = 16
DOCS_A_SHARD = 256
#: Words of a reference in one automaton, which takes some hundred bytes a word.
SHARD_WORDS = 50_000
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + BLOCK_BYTES) if len(raw) - at > BLOCK_BYTES else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def words_digest(raw: bytes) -> bytes:
    """SHA-256 of a text's words joined by one space."""
    digest, some = hashlib.sha256(), False
    for words in word_pieces(raw):
        if words:
            digest.update((b" " if some else b"") + b" ".join(words))
            some = True
    return digest.digest()


class SuffixAutomaton:
    """Of one sequence of hashable items; states know the longest of their strings and their suffix link."""

    def __init__(self, items: list):
        self.next: list[dict] = [{}]
        self.length, self.link = [0], [-1]
        last = 0
        nxt, length, link = self.next, self.length, self.link
        for item in items:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and item not in nxt[p]:
                nxt[p][item] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][item]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(item) == q:
                        nxt[p][item] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def matches(self, items: Iterable, least: int) -> list[tuple[int, int]]:
        """The maximal spans [start, end) of items covered by matches of at least ``least`` items, joined where they meet."""
        nxt, length, link = self.next, self.length, self.link
        state = run = 0
        out: list[tuple[int, int]] = []
        for i, item in enumerate(items):
            while state and item not in nxt[state]:
                state = link[state]
                run = length[state]
            if item in nxt[state]:
                state = nxt[state][item]
                run += 1
            else:
                run = 0
            if run >= least:
                start = i + 1 - run
                if out and start <= out[-1][1]:
                    start = min(out.pop()[0], start)
                out.append((start, i + 1))
        return out


def _window_anchors(words: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window that starts at each word, and whether that window lies within one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, span, reach = grams(words, min(ANCHOR, size)), 1, size - min(ANCHOR, size) + 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])[:n]
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    return low, doc[:n] == doc[size - 1 : size - 1 + n]


def _key(digest: bytes) -> int:
    """What stands for a digest beside a doc_id, where rows with different texts may share one."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for row, end, data, offsets in blocks(column):
                words, before = word_hashes(data, offsets)
                low, inside = _window_anchors(words, before, size)
                new = inside.copy()
                new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
                at = np.flatnonzero(new)
                raw = data.tobytes()
                digests = [words_digest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                cuts = np.searchsorted(at, before).astype(np.int32)
                yield pa.record_batch(
                    [
                        ids[row:end],
                        pa.array(np.diff(before)),
                        pa.array(digests, pa.binary()),
                        pa.array([_key(x) for x in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(low[at].view(np.int64))),
                    ],
                    ["doc_id", "n_words", "digest", "key", "anchors"],
                )

    return run


def _windows(size: int, shard_words: int):
    """Of candidate documents: the windows whose anchors stand in other documents too, and the shards that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors = batch.column(0), batch.column(2)
            for row, end, data, offsets in blocks(batch.column(1)):
                words, before = word_hashes(data, offsets)
                low, inside = _window_anchors(words, before, size)
                shared = np.asarray(anchors[row:end].flatten()).view(np.uint64)
                at = np.flatnonzero(inside & np.isin(low, shared))
                doc = np.repeat(np.arange(row, end), np.diff(before))[at] if len(at) else at
                hashes = grams(words, size)[at]
                shard = (at - before[doc - row]) // shard_words
                order = np.lexsort((shard, hashes, doc))  # a window that a shard repeats counts once
                doc, hashes, shard = doc[order], hashes[order], shard[order]
                new = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]) | (shard[1:] != shard[:-1])
                once = np.append(True, new) if len(doc) else np.zeros(0, bool)
                yield pa.record_batch([pa.array(hashes[once].view(np.int64)), ids.take(pa.array(doc[once])), pa.array(shard[once], pa.int32())], ["w", "doc_id", "shard"])

    return run


def _cut_up(size: int, shard_words: int):
    """Texts as shards of ``shard_words`` words and the ``size - 1`` words after them, joined by one space."""
    reach = shard_words + size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id: int, key: int, shard: int, words: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "key": key, "shard": shard, "text": b" ".join(words).decode()}], _SHARDS)

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i) for i in range(3))):
                held, shard = [], 0
                for words in word_pieces(text.as_py().encode()):
                    held += words
                    while len(held) >= reach:
                        yield row(doc_id.as_py(), key.as_py(), shard, held[:reach])
                        held, shard = held[shard_words:], shard + 1
                if len(held) >= size or not shard:
                    yield row(doc_id.as_py(), key.as_py(), shard, held)

    return run


def shards_of(texts: DataFrame, size: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``texts`` (doc_id, key, text) shard by shard; those too short for a second one stay as they are, in the JVM."""
    short = F.octet_length("text") < 2 * shard_words  # a word and a space
    long = texts.where(~short).select("doc_id", "key", "text").mapInArrow(_cut_up(size, shard_words), "doc_id long, key long, shard int, text string")
    return texts.where(short).select("doc_id", "key", F.lit(0).alias("shard"), "text").unionByName(long)


def _streamed(size: int, shard_words: int):
    """Rows sorted by shard, the reference first: its automaton, then the spans that it covers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, automaton = None, None
        for batch in batches:
            out: list[tuple[int, int, list[int], list[int]]] = []
            ref, shard, salt, mine, ids, keys, parts = (batch.column(i).to_pylist() for i in range(7))
            for row, _, data, offsets in blocks(batch.column(7), 1):
                words, place = word_hashes(data, offsets)[0].tolist(), (ref[row], shard[row], salt[row])
                if mine[row]:
                    if held != place:
                        held, automaton = place, SuffixAutomaton(words)
                elif held == place and (spans := automaton.matches(words, size)):
                    start = parts[row] * shard_words
                    out.append((ids[row], keys[row], [start + a for a, _ in spans], [start + b for _, b in spans]))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "key", "starts", "ends"), x)) for x in out], _SPANS)

    return run


_SHARDS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("shard", pa.int32()), ("text", pa.string())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the words of their spans (several lists of starts and ends) taken out, the rest joined by one space."""
    for batch in batches:
        ids, keys, texts, starts, ends = (c.to_pylist() for c in batch.columns)
        removed, kept = [], []
        for text, a, b in zip(texts, starts, ends):
            lost, parts, at, open_ = 0, [], 0, 0
            marks = sorted([(x, 1) for part in a for x in part] + [(x, -1) for part in b for x in part])
            marks = np.array(marks, np.int64).reshape(-1, 2)
            for words in word_pieces((text or "").encode()):
                own = marks[(marks[:, 0] >= at) & (marks[:, 0] < at + len(words))]
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, own[:, 0] - at, own[:, 1])
                gone = np.cumsum(gone[:-1]) + open_
                at, open_ = at + len(words), open_ + int(own[:, 1].sum())
                lost += int((gone > 0).sum())
                if left := [w for w, g in zip(words, (gone > 0).tolist()) if not g]:
                    parts.append(b" ".join(left))
            removed.append(lost)
            kept.append(b" ".join(parts).decode())
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
            ],
            ["doc_id", "key", "n_removed", "kept", "kept_sha256"],
        )


def _same_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only matters where rows with different texts share a doc_id: keeps the text that the profile is of."""
    for batch in batches:
        rows = [
            i
            for i, (text, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            if _key(words_digest((text or "").encode())) == key
        ]
        yield batch.take(pa.array(rows, pa.int64()))


def routed(shards: DataFrame, routes: DataFrame) -> DataFrame:
    """What is sent: ``shards`` to the shards that ``routes`` name, and these once for every ``DOCS_A_SHARD`` of them."""
    asked = routes.groupBy("ref", "ref_shard").agg(F.ceil(F.count("*") / F.lit(DOCS_A_SHARD)).alias("salts"))
    references = (
        shards.join(asked.withColumnsRenamed({"ref": "doc_id", "ref_shard": "shard"}), ["doc_id", "shard"])
        .select(F.col("doc_id").alias("ref"), F.col("shard").alias("ref_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("mine"), "doc_id", "key", "shard", "text")
    )
    streamed = (
        shards.join(routes.join(asked, ["ref", "ref_shard"]), ["doc_id", "shard"])
        .select("ref", "ref_shard", F.expr("pmod(xxhash64(doc_id, shard), salts)").alias("salt"), F.lit(False).alias("mine"), "doc_id", "key", "shard", "text")
    )
    return references.unionByName(streamed)


def repeats(docs: DataFrame, min_words: int = 50, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and what to do with classes of equal word sequences.

    The first has doc_id, n_words, digest (SHA-256 of the words joined by one space), first (the smallest doc_id with
    that digest) and key. The second has, for the classes that lose some words in their first document, doc_id, key,
    n_removed, kept, kept_sha256. Other documents of a class lose all their words if they have ``min_words``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = scratch.cut(docs.mapInArrow(_profiles(min_words), "doc_id long, n_words long, digest binary, key long, anchors array<long>"), "profiles")
    firsts = scratch.cut(profiles.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    marks = (
        profiles.where(f"n_words >= {min_words}")
        .join(firsts, (profiles.digest == firsts.digest) & (F.col("doc_id") == F.col("first")), "left_semi")
        .select(F.explode("anchors").alias("h"), "doc_id", "key")
    )
    both = marks.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    wanted = marks.join(both, "h").groupBy("doc_id", "key").agg(F.collect_set("h").alias("anchors"))
    wanted = scratch.cut(wanted, "wanted")
    found = docs.join(wanted, "doc_id").select("doc_id", "text", "key", "anchors")
    found = scratch.cut(found.mapInArrow(_same_text, found.schema).dropDuplicates(["doc_id", "key"]), "found")
    scratch.drop("wanted")

    windows = scratch.cut(found.select("doc_id", "text", "anchors").mapInArrow(_windows(min_words, SHARD_WORDS), "w long, doc_id long, shard int"), "windows")
    held = windows.groupBy("w").agg(F.min(F.struct("doc_id", "shard")).alias("least"), F.max("doc_id").alias("last"))
    held = held.where("least.doc_id < last").select("w", F.col("least.doc_id").alias("ref"), F.col("least.shard").alias("ref_shard"))
    routes = windows.join(held, "w").where("doc_id > ref").select("doc_id", "shard", "ref", "ref_shard").distinct()
    routes = scratch.cut(routes, "routes")
    scratch.drop("windows")
    spans = (
        routed(shards_of(found, min_words, SHARD_WORDS), routes)
        .repartition("ref", "ref_shard", "salt").sortWithinPartitions("ref", "ref_shard", "salt", F.desc("mine"))
        .mapInArrow(_streamed(min_words, SHARD_WORDS), "doc_id long, key long, starts array<int>, ends array<int>")
        .groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    )
    kept = (
        found.select("doc_id", "key", "text").join(spans, ["doc_id", "key"])
        .select("doc_id", "key", "text", "starts", "ends")
        .mapInArrow(_kept, "doc_id long, key long, n_removed long, kept string, kept_sha256 string")
    )
    kept = scratch.cut(kept, "kept")
    scratch.drop("found", "routes")
    classes = profiles.select("doc_id", "n_words", "digest", "key").join(firsts, "digest", "left")
    return classes, kept


def _with_verdicts(classes: DataFrame, kept: DataFrame, min_words: int) -> DataFrame:
    """classes with ``copy`` (a smaller document has the same words) and the verdicts of first documents."""
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= min_words)
    return classes.withColumn("copy", copy).join(kept, ["doc_id", "key"], "left")


def substring_dedup_digest(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    classes, kept = repeats(docs, min_words)
    empty = hashlib.sha256(b"").hexdigest()
    return _with_verdicts(classes, kept.drop("kept"), min_words).select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def substring_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with the removed words gone from ``text``; texts that lose nothing stay as they are, to the byte.

    A document that loses all its words gets an empty text. Other columns pass unchanged.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    classes, kept = repeats(docs, min_words, scratch)
    row, left = fresh(docs.columns, "changed_id", "kept")
    changed = (
        _with_verdicts(classes, kept.drop("kept_sha256"), min_words)
        .where("copy or n_removed > 0")
        .select(F.col("doc_id").alias(row), F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias(left))
    )
    changed = scratch.cut(changed.groupBy(row).agg(F.min(left).alias(left)), "changed")
    joined = docs.join(changed, docs["doc_id"] == changed[row], "left")
    return joined.select(*[F.coalesce(changed[left], docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns])
