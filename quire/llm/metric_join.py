"""Embedding near-duplicates: exact metric range join.

Vectors link when their labels are equal and their cosine, in double precision, is at least ``threshold``. Angles are a
metric. Pivots partition each label's vectors into cells (nearest pivot); by the triangle inequality, a vector within
angle r of another of cell c is no farther from c's pivot than from its own pivot plus 2 r, and no farther than their
distance on its own side of the plane between both pivots. It is replicated to the cells for which both hold, of those
with a smaller number than its own: so each pair meets in one cell. Cells then join independently.

Equal vectors of a label are one class with a count (by 128 bits of hashes), so copies cost one row. A cell of more than
``CELL_VALUES`` numbers is dealt out as pairs of blocks, so what a task holds at once is bounded however large the cell
is; of the links within a pair of blocks only a spanning forest leaves the task. Products in single precision choose
candidates, with room for their rounding; their cosines in double precision decide.

Pivots are chosen by farthest-first order from a bounded sample: at most ``SAMPLE`` vectors of each of the ``PIVOTED``
largest labels (others are one cell). How many, from 2 up, is what costs least by the sample: where vectors are so spread
that the inequality excludes nearly nothing, few; where they are clustered, many. Every vector is joined, whatever the
pivots are.

Defined results: a null label, or a vector that is null, zero, or has null or non-finite components, links with nothing
and is its own component; vectors of different length never link; a null vec_id is a row without links and with a null
component; repeated rows link with each other; different vectors of one vec_id share the sum of their links; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, components

SAMPLE = 256
PIVOTED = 64
MOST_PIVOTS = 64
CELL_VALUES = 1 << 20
#: Slack for rounding in angles and in products of single precision; pairs are decided by their cosine alone.
_SLACK, _SINGLE = 1e-6, 1e-4
#: A second's work, for the choice of pivots: products of numbers, and bytes sent to another task.
_PRODUCTS, _BYTES = 4e9, 5e7


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=-1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=-1, keepdims=True))


def farthest_first(vectors: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors that are far from each other, beginning with the first."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(most, len(vectors)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, vectors @ vectors[k])
    return vectors[chosen]


def placed_in(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the cell of each, and to which cells of smaller numbers it is replicated."""
    cosines = np.clip(vectors @ pivots.T, -1, 1)
    angles, home = np.arccos(cosines), cosines.argmax(axis=1)
    rows = np.arange(len(vectors))
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 0))[home]  # between the two pivots
    chord = 2 * np.sin(radius / 2)
    reach = (angles <= angles[rows, home][:, None] + 2 * radius + _SLACK) & (cosines[rows, home][:, None] - cosines <= chord * apart + _SLACK)
    return home, reach & (np.arange(len(pivots)) < home[:, None])


def chosen_pivots(sample: np.ndarray, count: int, radius: float) -> np.ndarray:
    """Pivots out of a sample of unit vectors that stands for ``count``: as many as cost least."""
    ordered, dim = farthest_first(sample, MOST_PIVOTS), sample.shape[1]
    best, least = ordered[:1], float("inf")
    for k in sorted({*(2**j for j in range(1, 30) if 2**j < len(ordered)), len(ordered)}):
        home, reach = placed_in(sample, ordered[:k], radius)
        own = np.bincount(home, minlength=k) * (count / len(sample))
        sent = reach.sum(axis=0) * (count / len(sample))
        blocks = np.ceil((own + sent) * dim / CELL_VALUES)
        cost = (own * (own / 2 + sent)).sum() * dim / _PRODUCTS + ((own + sent) * blocks).sum() * dim * 8 / _BYTES
        if cost < least:
            best, least = ordered[:k], cost
    return best


def _as_matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(rows))
    return np.asarray(part.flatten()).astype(np.float64).reshape(len(rows), -1)


def _cells(pivots, radius: float):
    """Each class once as owner in its cell and once as guest in every smaller one that its neighbours may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pivots.value
        for batch in batches:
            labels, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = {}
            for k, key in enumerate(zip(labels, sizes)):
                own.setdefault(key, []).append(k)
            for key, rows in own.items():
                rows = np.array(rows)
                if key in tables:
                    home, reach = placed_in(unit(_as_matrix(batch.column(3), rows)), tables[key], radius)
                    at, cell = np.nonzero(reach)
                else:
                    home, at, cell = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                every = pa.array(np.concatenate([rows, rows[at]]))
                owner = np.concatenate([np.ones(len(rows), bool), np.zeros(len(at), bool)])
                yield pa.record_batch(
                    [*(batch.column(c).take(every) for c in range(5)), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(owner)],
                    ["label", "size", "first", "vector", "weight", "cell", "owner"],
                )

    return run


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows whose cosine is at least ``threshold``."""
    found = []
    one, other = unit(left), unit(right)
    one_s, other_s = one.astype(np.float32), other.astype(np.float32)
    step = max(1, (1 << 23) // max(len(right), 1))
    for k in range(0, len(left), step):
        near = one_s[k : k + step] @ other_s.T >= np.float32(threshold - _SINGLE)
        for i in np.flatnonzero(near.any(axis=1)) + k:
            j = np.flatnonzero(near[i - k])
            own = left[i]
            cosine = (right[j] @ own) / (np.sqrt((right[j] * right[j]).sum(axis=1)) * np.sqrt(own @ own))
            j = j[cosine >= threshold]
            found.append((np.full(len(j), i), j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _links(threshold: float):
    """Rows sorted by cell and pair of blocks: links of each row within the pair, and links that connect what all of them do."""

    def joined(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, weight, block = (group.column(c).to_numpy() for c in ("first", "weight", "block"))
        owner = group.column("owner").to_numpy()
        vectors = _as_matrix(group.column("vector").combine_chunks(), np.arange(len(group)))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        counts, a, b = np.zeros(len(group), np.int64), first[:0], first[:0]
        step = 4096
        for k in range(0, len(left), step):
            i, j = linked_pairs(vectors[left[k : k + step]], vectors[right], threshold)
            i, j = left[k + i], right[j]
            ok = (owner[i] | owner[j]) & ((i < j) if lo == hi else True)
            i, j = i[ok], j[ok]
            counts += np.bincount(i, weight[j], len(group)).astype(np.int64) + np.bincount(j, weight[i], len(group)).astype(np.int64)
            a, b = _forest(np.concatenate([a, first[i]]), np.concatenate([b, first[j]]))
        some = np.flatnonzero(counts)
        return first[some], counts[some], a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            first, counts, a, b = joined(pa.Table.from_batches(held).combine_chunks())
            kinds = np.concatenate([np.zeros(len(first), bool), np.ones(len(a), bool)])
            return pa.record_batch([pa.array(kinds), pa.array(np.concatenate([first, a])), pa.array(np.concatenate([counts, b]))], ["is_link", "a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(5))))
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or k > start and keys[k] != keys[start]:
                    if k > start:
                        if keys[start] != key and held:
                            yield out()
                            held = []
                        key = keys[start]
                        held.append(batch.slice(start, k - start))
                        start = k
        if held:
            yield out()

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node with its component's least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.maximum(root[x], root[y]), low)
        while ((further := root[root]) != root).any():
            root = further
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric-join")
    radius = float(np.arccos(threshold))
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"), "label")
    finite = F.expr(
        "vec_id is not null and label is not null and vector is not null and size(vector) > 0 and exists(vector, x -> x <> 0)"
        " and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    hashes = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector", F.size("vector"))}
    rows = scratch.cut(plain.withColumns({"ok": F.coalesce(finite, F.lit(False)), "size": F.size("vector"), **hashes}), "rows")
    same = ["label", "size", "h1", "h2"]
    counted = rows.where("ok").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    counted = scratch.cut(counted, "counted")
    firsts = rows.where("ok").select(*same, F.col("vec_id").alias("first"), "vector").join(counted, [*same, "first"])
    classes = scratch.cut(firsts.dropDuplicates([*same, "first"]).select("label", "size", "first", "vector", "weight"), "classes")

    largest = counted.groupBy("label", "size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "size").limit(PIVOTED)
    by_label = Window.partitionBy("label", "size").orderBy("k", "first")
    narrow = classes.select("label", "size", "first", F.xxhash64("first").alias("k")).join(F.broadcast(largest), ["label", "size"])  # at most PIVOTED rows
    sampled = narrow.withColumn("at", F.row_number().over(by_label)).where(F.col("at") <= SAMPLE).select("label", "size", "first", "n")
    sample: dict[tuple, list] = {}
    counts: dict[tuple, int] = {}
    for r in classes.join(F.broadcast(sampled), ["label", "size", "first"]).select("label", "size", "n", "first", "vector").orderBy("first").toLocalIterator():
        sample.setdefault((r["label"], r["size"]), []).append(r["vector"])
        counts[r["label"], r["size"]] = r["n"]
    found = {key: chosen_pivots(unit(np.array(v, np.float64)), counts[key], radius) for key, v in sample.items()}
    pivots = spark.sparkContext.broadcast(found)

    label_type = vectors.schema["label"].dataType.simpleString()
    base = f"label {label_type}, size int, first long, vector {kind}, weight long"
    placed = scratch.cut(classes.mapInArrow(_cells(pivots, radius), f"{base}, cell int, owner boolean"), "placed")
    cells = placed.groupBy("label", "size", "cell").agg(F.count("*").alias("n"), F.count_if("owner").alias("owners")).where("owners > 0")
    blocks = cells.withColumn("of", F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(CELL_VALUES) / F.col("size")))).cast("int")).drop("n", "owners")
    dealt = (
        placed.join(blocks, ["label", "size", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(first, vector), of) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
        .select("label", "size", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "first", "vector", "weight", "block", "owner")
    )
    keys = ("label", "size", "cell", "lo", "hi")
    out = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(threshold), "is_link boolean, a long, b long")
    out = scratch.cut(out, "links")
    scratch.drop("placed", "classes")
    joined = components(scratch, out.where("is_link").select("a", "b"), "components").withColumnRenamed("node", "first")
    others = out.where("not is_link").groupBy(F.col("a").alias("first")).agg(F.sum("b").alias("others"))
    verdicts = (
        counted.join(others, "first", "left").join(joined, "first", "left")
        .select(*[F.col(c).alias(f"v_{c}") for c in same], (F.coalesce("others", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    )
    verdicts = scratch.cut(verdicts, "verdicts")
    fit = rows["ok"]
    for c in same:
        fit = fit & (rows[c] == verdicts[f"v_{c}"])
    return rows.join(verdicts, fit, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
