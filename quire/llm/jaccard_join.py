"""N-gram Jaccard join: size-aware, heavy-light.

Two documents link when 100 * intersection >= percent * union of their sets of word shingles. Light sets (few shingles)
meet each other by enumerated subsets of the fixed size that a linking pair of their sizes must share; pairs with a heavy
set meet in inverted lists over prefixes. The boundary is the largest size whose subsets cost no more rows than the
prefix entries and list positions that they replace.

1. Profile: set size, digest of the set, a parity sketch (one bit flipped for each shingle), three least hashes.
   Equal digests are one class, for which its smallest doc_id stands; only classes meet.
2. Near classes that share a least hash are compared with the smallest class that has it. What links becomes one
   cluster, so the pairs within a large group of near copies are never enumerated.
3. Prefixes: shingles are ordered by a counting sketch of fixed size (rare first), whose errors cost time but no link:
   what counts is how far a counter is above the middle one, so that it tells common shingles however full it is. By
   length, position and parity filters (all exact), lists keep pairs of different clusters only. A list longer than
   ``LIST_BLOCK`` is split by set size (only sets of one class of sizes or of the next can link), and what is longer
   still is dealt out as pairs of blocks; a cluster with many members in a list has blocks of its own, which never meet.
4. Surviving pairs are verified on whole sets, a document's own sent once for ``PAIRS`` of them; components of all links
   follow.

Defined results: null text or no words is an empty set, linked with nothing; fewer words than ``size`` are one shingle;
a null doc_id is its own row with a null component; repeated rows are equal sets; texts of any length are one set; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, blocks, components, fresh, grams, mix, spans_hash, word_hashes

#: Counters of the sketch; with its levels in a byte each, this is also the size of what is broadcast.
SKETCH = 1 << 22
_SKETCH_PART = 1 << 16
_PARITY_BITS = 1024
LIST_BLOCK = 512
#: Sizes above this are never light: their subsets outnumber any list.
_LIGHT_MOST = 12


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least intersection of linked sets with a and b members: the least o with 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text of a block, in a row, and where each text's begin (and the end)."""
    words, before = word_hashes(data, offsets, lower=True)
    full = grams(words, size)
    counts = np.diff(before)
    sets = []
    for a, n in zip(before[:-1].tolist(), counts.tolist()):
        if n >= size:
            own = full[a : a + n - size + 1].copy()
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = spans_hash(words[a : a + n], np.array([0]), np.array([n]))
        else:
            own = full[:0]
        sets.append(own)
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return (np.concatenate(sets) if sets else full[:0]), starts


_PROFILE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("parity", pa.list_(pa.int64())), ("leasts", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())]
)
_PROFILE_DDL = "doc_id long, n long, digest binary, parity array<long>, leasts array<long>, part int, counts binary"


def _profiles(size: int):
    """A row for each document; at the end, the task's counters in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, np.int32)
        waiting: list[np.ndarray] = []

        def count_waiting() -> None:
            if waiting:
                counters[:] += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.int32)
                waiting.clear()

        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                flat, starts = shingle_sets(data, offsets, size)
                waiting.append((flat & np.uint64(SKETCH - 1)).astype(np.int64))
                if sum(map(len, waiting)) > SKETCH // 2:
                    count_waiting()
                sizes, count = np.diff(starts), end - row
                doc = np.repeat(np.arange(count), sizes)
                bits = np.bincount(doc * _PARITY_BITS + ((flat >> np.uint64(22)) & np.uint64(_PARITY_BITS - 1)).astype(np.int64), minlength=count * _PARITY_BITS) & 1
                words = _PARITY_BITS // 64
                parity = np.packbits(bits.astype(np.uint8).reshape(count, _PARITY_BITS), axis=1)
                some = np.flatnonzero(sizes)
                leasts = np.zeros((count, 3), np.int64)
                for k, salt in enumerate((0x1B873593, 0x27D4EB2F, 0x165667B1)):
                    if len(some):
                        leasts[some, k] = np.minimum.reduceat(mix(flat ^ np.uint64(salt)), starts[:-1][some]).view(np.int64)
                raw = flat.tobytes()
                yield pa.record_batch(
                    [
                        batch.column(0)[row:end],
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, words * count + 1, words, dtype=np.int32)), pa.array(parity.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * count + 1, 3, dtype=np.int32)), pa.array(leasts.ravel())),
                        pa.nulls(count, pa.int32()),
                        pa.nulls(count, pa.binary()),
                    ],
                    schema=_PROFILE,
                )
        count_waiting()
        parts = [(k, c) for k, c in enumerate(counters.reshape(-1, _SKETCH_PART)) if c.any()]
        yield pa.RecordBatch.from_pylist([{"part": k, "counts": zlib.compress(c.tobytes(), 1)} for k, c in parts], _PROFILE)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: one row with the summed counters of each part, as levels (half powers of two above the middle one)."""
    part, total = None, None

    def out() -> pa.RecordBatch:
        above = np.maximum(total - int(np.median(total)), 0)
        level = np.round(2 * np.log2(above + 1.0)).astype(np.uint8)
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "counts"])

    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != part:
                if total is not None:
                    yield out()
                part, total = k, np.zeros(_SKETCH_PART, np.int64)
            total += np.frombuffer(zlib.decompress(packed), np.int32)
    if total is not None:
        yield out()


def light_boundary(spark: SparkSession, profiles: DataFrame, levels: np.ndarray, percent: int) -> int:
    """The largest set size for which subsets cost no more rows than prefixes, at the measured frequency of shingles."""
    sizes = profiles.where(f"n between 1 and {_LIGHT_MOST}").groupBy("n").count().collect()
    frequency = float(np.mean(2.0 ** (levels[levels > 0] / 2.0))) if (levels > 0).any() else 1.0
    best = 0
    for n in sorted(r["n"] for r in sizes):
        subsets = sum(comb(n, c) for c in subset_sizes(n, percent))
        prefix = n - needed(n, -(-percent * n // 100), percent) + 1
        if subsets > prefix * (1 + frequency):
            break
        best = n
    return best


def subset_sizes(n: int, percent: int) -> list[int]:
    """The sizes of shared subsets that may be needed of a set with n members."""
    return sorted({needed(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)} & set(range(1, n + 1)))


_ENTRY_DDL = "key long, light boolean, doc_id long, n int, pos int"


def _entries(size: int, percent: int, light: int, levels):
    """Subsets of light sets; prefix entries of heavy sets and of those light ones that may link with heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        level = levels.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, data, offsets in blocks(batch.column(1)):
                flat, starts = shingle_sets(data, offsets, size)
                order = (level[(flat & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(flat) >> np.uint64(8))
                keys, docs, ns, poss, lights = [], [], [], [], []
                for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    n = b - a
                    if 0 < n <= light:
                        own = flat[a:b].tolist()
                        for c in subset_sizes(n, percent):
                            chosen = np.array(list(combinations(own, c)), np.uint64)
                            hashed = spans_hash(chosen.ravel(), np.arange(len(chosen)) * c, np.arange(1, len(chosen) + 1) * c)
                            keys.append(hashed)
                            poss.append(np.full(len(hashed), c))
                            lights.append(np.ones(len(hashed), bool))
                            docs.append(np.full(len(hashed), ids[row + k]))
                            ns.append(np.full(len(hashed), n))
                    if n > light or 100 * n >= percent * (light + 1) and n:
                        m = n - int(needed(n, -(-percent * n // 100), percent)) + 1
                        own = order[a:b]
                        first = np.sort(np.partition(own, m - 1)[:m]) if m < n else np.sort(own)
                        keys.append(first)
                        poss.append(np.arange(len(first)))
                        lights.append(np.zeros(len(first), bool))
                        docs.append(np.full(len(first), ids[row + k]))
                        ns.append(np.full(len(first), n))
                if keys:
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate(keys).view(np.int64)),
                            pa.array(np.concatenate(lights)),
                            pa.array(np.concatenate(docs), pa.int64()),
                            pa.array(np.concatenate(ns), pa.int32()),
                            pa.array(np.concatenate(poss), pa.int32()),
                        ],
                        ["key", "light", "doc_id", "n", "pos"],
                    )

    return run


#: A list, a class of sizes in it, and a pair of its blocks.
_LIST = ("key", "light", "sizes", "lo", "hi")


def _dealt(scratch: Scratch, listed: DataFrame, percent: int) -> DataFrame:
    """Entries of lists (with members, cluster and parity) to where pairs of them are compared.

    In a class of sizes, entries of the class below are guests, who don't meet each other there.
    """
    of = ["key", "light", "sizes"]
    rest = ["doc_id", "n", "pos", "cluster", "parity"]
    zero = F.lit(0)
    short = listed.where(f"members <= {LIST_BLOCK}").select("key", "light", zero.alias("sizes"), zero.alias("lo"), zero.alias("hi"), *rest, zero.alias("block"), F.lit(False).alias("guest"))
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent * (1 + 1e-9))))).cast("int")
    long = listed.where(f"members > {LIST_BLOCK}").withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True))))
    long = long.withColumn("sizes", own + F.col("guest").cast("int"))
    held = long.groupBy(*of, "cluster").agg(F.count("*").alias("held"), F.count_if(~F.col("guest")).alias("owners"))
    big, parts = F.col("held") > LIST_BLOCK, lambda n: F.ceil(n / F.lit(LIST_BLOCK)).cast("int")
    blocks = held.groupBy(*of).agg(
        parts(F.coalesce(F.sum(F.when(~big, F.col("held"))), F.lit(0))).alias("small"),
        F.array_sort(F.collect_list(F.when(big, F.struct(F.col("cluster").alias("c"), parts(F.col("held")).alias("parts"))))).alias("big"),
        F.sum("owners").alias("owners"),
    )
    blocks = scratch.cut(blocks.where("owners > 0").drop("owners"), "blocks")
    # All blocks of a list in a row: those of small clusters together, then those of each big one.
    every = """flatten(concat(
        array(transform(filter(sequence(0, small), i -> i < small), i -> named_struct('big', false, 'c', 0L, 'i', i))),
        transform(big, b -> transform(sequence(0, b.parts - 1), i -> named_struct('big', true, 'c', b.c, 'i', i)))))"""
    mine = "filter(big, b -> b.c = cluster)"
    place = f"""if(size({mine}) > 0, named_struct('big', true, 'c', cluster, 'i', cast(pmod(xxhash64(doc_id), {mine}[0].parts) as int)),
        named_struct('big', false, 'c', 0L, 'i', cast(pmod(xxhash64(doc_id), greatest(small, 1)) as int)))"""
    dealt = (
        long.join(blocks, of).withColumn("every", F.expr(every))
        .withColumn("block", F.expr(f"cast(array_position(every, {place}) - 1 as int)"))
        .withColumn("other", F.explode(F.expr("filter(sequence(0, size(every) - 1), j -> not every[j].big or every[j].c <> cluster)")))
        .select(*of, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *rest, "block", "guest")
    )
    return short.unionByName(dealt)


def _list_pairs(percent: int, light: int):
    """Rows sorted by list and block pair: the pairs of a list that pass all filters, once for each task."""

    def within(x: dict[str, np.ndarray], cross: bool) -> Iterator[tuple[int, int]]:
        n, room = x["n"], x["n"] - x["pos"]
        order = np.argsort(n, kind="stable")
        for at, i in enumerate(order[:-1]):
            j = order[at + 1 :]
            j = j[: np.searchsorted(n[j], 100 * n[i] // percent, side="right")]
            j = j[x["cluster"][j] != x["cluster"][i]]
            if x["guest"][i]:
                j = j[~x["guest"][j]]
            if cross:
                j = j[x["block"][j] != x["block"][i]]
            if not len(j):
                continue
            least = needed(n[i], n[j], percent)
            if x["light"][i]:
                ok = least == x["pos"][i]
            else:
                ok = (np.maximum(n[i], n[j]) > light) & (np.minimum(room[i], room[j]) >= least)
            j, least = j[ok], least[ok]
            if len(j):
                apart = np.bitwise_count(x["parity"][j] ^ x["parity"][i]).sum(axis=1)
                for k in j[apart <= n[i] + n[j] - 2 * least]:
                    yield min(x["doc_id"][i], x["doc_id"][k]), max(x["doc_id"][i], x["doc_id"][k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rest: pa.Table | None = None

        def pairs(rows: pa.Table) -> list[tuple[int, int]]:
            c = {name: rows.column(name).to_numpy() for name in (*_LIST, "doc_id", "n", "pos", "cluster", "block", "guest")}
            c["n"], c["pos"] = c["n"].astype(np.int64), c["pos"].astype(np.int64)
            c["parity"] = np.asarray(rows.column("parity").combine_chunks().flatten()).view(np.uint64).reshape(len(rows), -1)
            cut = np.flatnonzero(np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in _LIST])) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
                if b - a > 1:
                    for pair in within({k: v[a:b] for k, v in c.items()}, bool(c["lo"][a] != c["hi"][a])):
                        if pair[0] != pair[1] and pair not in seen:
                            if len(seen) > 2_000_000:
                                seen.clear()
                            seen.add(pair)
                            out.append(pair)
            return out

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([int(a) for a, _ in found], pa.int64()), pa.array([int(b) for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = [rows.column(c)[len(rows) - 1].as_py() for c in _LIST] if len(rows) else None
            if last is None:
                continue
            same = np.ones(len(rows), bool)
            for c, v in zip(_LIST, last):
                same &= rows.column(c).to_numpy() == v
            at = int(np.argmax(same))  # sorted, so the last list is a suffix
            rest = rows.slice(at).combine_chunks()
            yield batch_of(pairs(rows.slice(0, at).combine_chunks()) if at else [])
        if rest is not None:
            yield batch_of(pairs(rest))

    return run


#: Pairs of one document that are verified in one task; its text is sent once for as many.
PAIRS = 256


def _verified(size: int, percent: int):
    """Rows (a, salt, b, text) sorted by a and salt, a's own text (without b) first: the pairs that link, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            left, salt, right = (batch.column(c).to_pylist() for c in range(3))
            found = []
            for row, _, data, offsets in blocks(batch.column(3), 1):
                mine = shingle_sets(data, offsets, size)[0]
                if right[row] is None:
                    held, own = (left[row], salt[row]), mine
                elif held == (left[row], salt[row]):
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append((left[row], right[row]))
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = scratch.cut(docs.mapInArrow(_profiles(size), _PROFILE_DDL), "profiles")
    counted = raw.where("part is not null").select("part", "counts").repartition(SKETCH // _SKETCH_PART, "part").sortWithinPartitions("part")
    levels = np.zeros(SKETCH, np.uint8)
    for r in counted.mapInArrow(_summed, "part int, counts binary").collect():  # at most SKETCH bytes
        levels[r["part"] * _SKETCH_PART : (r["part"] + 1) * _SKETCH_PART] = np.frombuffer(r["counts"], np.uint8)
    shared = spark.sparkContext.broadcast(levels)

    profiles = raw.where("part is null").select("doc_id", "n", "digest", "parity", "leasts")
    light = light_boundary(spark, profiles, levels, percent)
    firsts = scratch.cut(profiles.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    sets = profiles.join(firsts, (profiles.digest == firsts.digest) & (F.col("doc_id") == F.col("first")), "left_semi")
    sets = scratch.cut(sets.dropDuplicates(["doc_id"]).select("doc_id", F.col("n").cast("int").alias("n"), "parity", "leasts"), "sets")
    repeated = profiles.where("n > 0").join(firsts, "digest").where("doc_id > first").select("doc_id")
    repeated = scratch.cut(repeated.union(profiles.where("n = 0").select("doc_id")).distinct(), "repeated")
    texts = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = scratch.cut(pairs.select("a", "b").distinct(), f"{label}-pairs")
        ids = scratch.cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{label}-ids")
        own = scratch.cut(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"{label}-texts")
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS)).alias("salts"))
        heads = own.toDF("a", "text").join(salts, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        rest = pairs.join(salts, "a").select("a", F.expr("pmod(xxhash64(b), salts)").alias("salt"), "b").join(own.toDF("b", "text"), "b").select("a", "salt", "b", "text")
        dealt = heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        out = scratch.cut(dealt.mapInArrow(_verified(size, percent), "a long, b long"), label)
        scratch.drop(f"{label}-pairs", f"{label}-ids", f"{label}-texts")
        return out

    least = F.expr(f"ceil(cast({percent} * (n + m) as double) / {100 + percent})")
    apart = F.expr("aggregate(zip_with(parity, other, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    hashed = sets.select("doc_id", F.posexplode("leasts").alias("k", "h"))
    heads = hashed.groupBy("k", "h").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1").select("k", "h", "a")
    met = scratch.cut(hashed.join(heads, ["k", "h"]).where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "met")
    known = sets.select("doc_id", "n", "parity")
    near = (
        met.join(known.toDF("a", "n", "parity"), "a").join(known.toDF("b", "m", "other"), "b")
        .where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
        .where(apart <= F.col("n") + F.col("m") - 2 * least)
    )
    links = verified(near, "near")
    clusters = scratch.cut(components(scratch, links, "clusters"), "near-clusters").withColumnRenamed("node", "doc_id")

    entries = scratch.cut(texts.mapInArrow(_entries(size, percent, light, shared), _ENTRY_DDL), "entries")
    shared_keys = entries.groupBy("key", "light").agg(F.count("*").alias("members")).where("members > 1")
    listed = entries.join(shared_keys, ["key", "light"]).join(sets.select("doc_id", "parity"), "doc_id").join(clusters, "doc_id", "left")
    listed = scratch.cut(listed.withColumn("cluster", F.coalesce("component", "doc_id")).drop("component"), "listed")
    scratch.drop("entries")
    far = _dealt(scratch, listed, percent).repartition(*_LIST).sortWithinPartitions(*_LIST).mapInArrow(_list_pairs(percent, light), "a long, b long")
    links = links.union(verified(far, "far"))
    joined = scratch.cut(components(scratch, links, "components"), "classes")
    named = profiles.select("doc_id", "n", "digest").join(firsts, "digest", "left").withColumn("first", F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    return named.join(joined, named["first"] == joined["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")).alias("component_id")
    )


def jaccard_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that link, directly or not, with a document of smaller doc_id.

    Rows of one doc_id go or stay together; those of null stay. Columns may have any names.
    """
    (gone_id,) = fresh(docs.columns, "gone_id")
    classes = jaccard_classes(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = Scratch(docs.sparkSession, "jaccard-dedup").cut(classes, "gone")
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
