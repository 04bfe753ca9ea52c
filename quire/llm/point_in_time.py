"""Point-in-time join: for each question the version of its key that was usable and best at its time.

A version is usable from its arrival (not before its event) to its expiry, and of usable ones the latest event wins, then
the earliest arrival, then the largest version_id: a step function of time with a priority. The upper envelope of many such
functions is a list of disjoint intervals with a winner each; two envelopes merge into one by their breakpoints, and an
interval alone is an envelope. Time is cut into chunks of ``CHUNK`` seconds, and envelopes are merged recursively by key
and chunk: in pairs within a task's rows, then by ``FAN`` tasks' envelopes at a time until one is left. Times are whole
seconds, so an envelope of a chunk has at most ``CHUNK`` winners, however many versions there are. A question is resolved
by binary search for the interval that starts last before its time.

No task takes all rows of a key: versions are merged where they are read, envelopes are dealt by key and chunk, and so are
questions, those of a chunk with more than ``SALT_ROWS`` dealt on by salts that each have the chunk's envelope. Nothing is
collected or broadcast.

Defined results: versions of null key, event, arrival, expiry or version_id, and those that expire before they can be used,
are never used; of versions equal in all three ranks that with the greater hash of its other columns wins; a question of
null key or time, or without a usable version, has null in all columns of a winner; repeated questions have a row each;
empty tables give no rows or no winners. The names of the tables' other columns don't matter (see ``latest_usable``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .shared import Scratch

#: Seconds of a chunk; envelopes merged in one group; questions of a chunk in one group.
CHUNK, FAN, SALT_ROWS = 256, 64, 1 << 20
#: Rows after which a task merges what it holds, and held rows after which it sends them on.
_MERGE_ROWS, _SEND_ROWS = 1 << 16, 1 << 20
_OWN = ("key", "chunk", "part", "lo", "hi", "event", "arrival", "version_id", "tie")


def merge_pairs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Envelopes 2i and 2i + 1 merged into i, for all i at once; higher ranks win.

    An envelope is the rows of one ``group``: disjoint intervals [lo, hi) in order, with bounds from 0 to ``span``. Rows are
    in order of group and lo, also those returned.
    """
    width = span + 1
    parent = group >> 1
    points = np.unique(np.concatenate([parent * width + lo, parent * width + hi]))
    owner, at = points // width, points % width
    best = np.full(len(points), -1, np.int64)
    starts = group * width + lo
    for side in (0, 1):
        child = 2 * owner + side
        before = np.searchsorted(starts, child * width + at, side="right") - 1
        inside = (before >= 0) & (group[before] == child) & (hi[before] > at)
        best = np.maximum(best, np.where(inside, rank[before], -1))
    # A winner holds up to the next point of its envelope; the last point of an envelope ends it.
    end = np.append(points[1:], 0) - owner * width
    kept = np.flatnonzero(best >= 0)
    owner, at, end, best = owner[kept], at[kept], end[kept], best[kept]
    if not len(owner):
        return owner, at, end, best
    goes_on = (owner[1:] == owner[:-1]) & (best[1:] == best[:-1]) & (at[1:] == end[:-1])
    first = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], at[first], end[last], best[first]


def upper_envelope(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """The envelope of all intervals of each key (0, 1, 2...): key, lo, hi and rank of its disjoint winner intervals.

    Ranks are distinct. Intervals of a key are leaves of a binary tree, which is merged from below for all keys at once.
    """
    order = np.argsort(key, kind="stable")
    key, lo, hi, rank = key[order], lo[order], hi[order], rank[order]
    counts = np.bincount(key) if len(key) else np.zeros(1, np.int64)
    levels = int(counts.max(initial=1) - 1).bit_length()
    place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
    group = (key << levels) + place
    for _ in range(levels):
        group, lo, hi, rank = merge_pairs(group, lo, hi, rank, span)
    return group, lo, hi, rank


def _merged(rows: pa.Table, span: int) -> pa.Table:
    """The winners of each part, key and chunk of ``rows`` (``_OWN`` and others), clipped to where they win, in order of lo."""
    number = lambda c: rows.column(c).to_numpy()
    chunk = number("chunk")
    columns = [rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64), chunk - chunk.min(), number("part").astype(np.int64)]
    group = np.zeros(len(chunk), np.int64)
    for c in columns:
        group = np.unique(group * (int(c.max()) + 1) + c, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((number("tie"), number("version_id"), -number("arrival"), number("event")))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group, lo, hi, best = upper_envelope(group, number("lo") - chunk * span, number("hi") - chunk * span, rank, span)
    out = rows.take(pa.array(order[best]))
    base = out.column("chunk").to_numpy() * span
    return out.set_column(out.schema.get_field_index("lo"), "lo", pa.array(lo + base)).set_column(out.schema.get_field_index("hi"), "hi", pa.array(hi + base))


def _cut(batch: pa.RecordBatch, span: int) -> pa.Table:
    """Versions (one part) with a row for each chunk that they reach into."""
    table = pa.Table.from_batches([batch])
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    first, n = lo // span, (hi - 1) // span - lo // span + 1
    at = np.repeat(np.arange(len(lo)), n)
    chunk = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    out = table.take(pa.array(at))
    for name, values in (("chunk", chunk), ("lo", np.maximum(lo[at], chunk * span)), ("hi", np.minimum(hi[at], (chunk + 1) * span))):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
    return out


def _first_envelopes(span: int):
    """Of a task's versions, in any order; memory is bounded, as envelopes that grow large are sent on and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = None, []
        for batch in batches:
            if batch.num_rows:
                more.append(_cut(batch, span))
            if sum(t.num_rows for t in more) >= max(_MERGE_ROWS, held.num_rows if held else 0):
                held, more = _merged(pa.concat_tables([*([held] if held else []), *more]), span), []
                if held.num_rows >= _SEND_ROWS:
                    yield from held.to_batches()
                    held = None
        if held or more:
            yield from _merged(pa.concat_tables([*([held] if held else []), *more]), span).to_batches()

    return run


def _next_envelopes(span: int):
    """Of rows sorted by key, chunk and part: one envelope of each, sent on when the next has begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            if held.num_rows < _MERGE_ROWS:
                continue
            held = _merged(held, span)
            last = int(np.searchsorted(_runs(held, "key", "chunk", "part"), 0))  # the last envelope may go on
            yield from held.slice(0, last).to_batches()
            held = held.slice(last)
        if held:
            yield from _merged(held, span).to_batches()

    return run


def _runs(rows: pa.Table, *names: str) -> np.ndarray:
    """Numbers of the runs of equal ``names``, counted back from 0, that of the last run: ..., -2, -1, 0."""
    codes = np.stack([rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in names], 1)
    run = np.append(0, np.cumsum((codes[1:] != codes[:-1]).any(1)))
    return run - run[-1]


def envelopes(versions: DataFrame, chunk_seconds: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The winners of each key at all times: key, chunk, lo, hi, event, arrival, version_id and the payload's columns.

    ``versions`` has key (string), event, arrival, expiry, version_id (longs) and ``payload``, a struct.
    """
    good = versions.where("key is not null and version_id is not null and expiry > greatest(event, arrival)")
    n_parts = good.rdd.getNumPartitions()
    rows = good.select(
        "key", F.lit(0).cast("long").alias("chunk"), F.spark_partition_id().alias("part"), F.greatest("event", "arrival").alias("lo"), F.col("expiry").alias("hi"),
        "event", "arrival", "version_id", F.xxhash64("payload").alias("tie"), "payload",
    ).where("event is not null and arrival is not null")
    kinds = {"key": StringType(), "part": IntegerType()}
    kind = StructType([*(StructField(n, kinds.get(n, LongType())) for n in _OWN), StructField("payload", versions.schema["payload"].dataType)])
    found = rows.mapInArrow(_first_envelopes(chunk_seconds), kind)
    while True:
        n_parts = -(-n_parts // fan)
        found = found.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        found = found.repartition("key", "chunk", "part").sortWithinPartitions("key", "chunk", "part").mapInArrow(_next_envelopes(chunk_seconds), kind)
        if n_parts <= 1:
            return found.drop("part", "tie")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, chunk and salt: an envelope in order of lo, then its questions, each with its winner or null."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        group = _runs(rows, "key", "chunk", "salt")
        group -= group[0]
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        time = rows.column("lo").to_numpy()
        winners, questions = np.flatnonzero(~asks), np.flatnonzero(asks)
        base = time.min()
        width = int(time.max() - base) + 1
        before = np.searchsorted(group[winners] * width + time[winners] - base, group[questions] * width + time[questions] - base, side="right") - 1
        at = winners[np.maximum(before, 0)] if len(winners) else np.zeros(len(questions), np.int64)
        hit = (before >= 0) & (group[at] == group[questions]) & (rows.column("hi").fill_null(0).to_numpy()[at] > time[questions])
        answer = pa.array(at, mask=~hit)
        out = {"ask": rows.column("ask").take(pa.array(questions)), "t": pa.array(time[questions]), "copies": rows.column("copies").take(pa.array(questions))}
        out |= {c: rows.column(c).take(answer) for c in ("event", "arrival", "version_id", "payload")}
        yield from pa.table(out).to_batches()
        held = rows.take(pa.array(winners[group[winners] == group[-1]]))  # its questions may go on in the next batch


def latest_usable(versions: DataFrame, asks: DataFrame, chunk_seconds: int = CHUNK, fan: int = FAN, salt_rows: int = SALT_ROWS) -> DataFrame:
    """ask, t and the winner's event, arrival, version_id and payload, in as many rows as ``asks`` says by ``copies``.

    ``versions`` has key (string), event, arrival, expiry, version_id (longs) and payload (a struct of any columns);
    ``asks`` has ask (long: the question's id), key, t (long) and copies.
    """
    scratch = Scratch(versions.sparkSession, "point-in-time")
    payload = versions.schema["payload"].dataType
    found = envelopes(versions, chunk_seconds, fan)
    asks = scratch.cut(asks.select("ask", "key", "t", "copies"), "asks")
    open_ = asks.where("key is not null and t is not null").withColumn("chunk", F.floor(F.col("t") / chunk_seconds))
    hot = open_.groupBy("key", "chunk").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts")).where("salts > 1")
    hot = scratch.cut(hot, "hot")
    if hot.isEmpty():
        found, open_ = found.withColumn("salt", F.lit(0)), open_.withColumn("salt", F.lit(0))
    else:
        salts, by = F.coalesce("salts", F.lit(1)), ["key", "chunk"]
        found = found.join(hot.hint("merge"), by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        open_ = open_.join(hot.hint("merge"), by, "left").withColumn("salt", F.pmod(F.xxhash64("ask"), salts).cast("int")).drop("salts")
    none = {c: F.lit(None).cast("long") for c in ("event", "arrival", "version_id")} | {"payload": F.lit(None).cast(payload)}
    winners = found.withColumns({"asks": F.lit(False), "ask": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")})
    questions = open_.withColumns(none | {"asks": F.lit(True), "lo": F.col("t"), "hi": F.lit(None).cast("long")}).drop("t")
    dealt = winners.unionByName(questions).repartition("key", "chunk", "salt").sortWithinPartitions("key", "chunk", "salt", "asks", "lo")
    kind = StructType([StructField(n, LongType()) for n in ("ask", "t", "copies", "event", "arrival", "version_id")] + [StructField("payload", payload)])
    answered = dealt.mapInArrow(_resolved, kind)
    closed = asks.where("key is null or t is null").select("ask", "t", "copies").withColumns(none)
    out = answered.unionByName(closed)
    return out.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy", "copies")


def _drawn(doc_id: str, k: int) -> F.Column:
    """The k-th group of eight digits of the doc_id's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(F.col(doc_id).cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def labelled_features(documents: DataFrame, labels: DataFrame, fresh_seconds: int = 60, **parameters) -> DataFrame:
    """For each label, what was known of its document's source at its time: doc_id, t, version_id, age, status, n_chars, lang.

    Times are drawn from the doc_ids' SHA-256. A doc_id that several rows of ``documents`` share is of its first source by
    code point; a label of a document that isn't there has no source.
    """
    event = F.pmod(_drawn("doc_id", 0), F.lit(20000))
    arrival, expiry = event - 60 + F.pmod(_drawn("doc_id", 1), F.lit(300)), event + F.pmod(_drawn("doc_id", 2), F.lit(900))
    versions = documents.select(
        F.col("source").alias("key"), event.alias("event"), arrival.alias("arrival"), expiry.alias("expiry"), F.col("doc_id").cast("long").alias("version_id"),
        F.struct(F.col("n_chars").cast("long").alias("n_chars"), "lang").alias("payload"),
    )
    sources = documents.where("doc_id is not null and source is not null").groupBy("doc_id").agg(F.min("source").alias("key"))
    asked = labels.groupBy("doc_id").agg(F.count("*").alias("copies"))  # a document's labels are one question
    asks = asked.join(sources.hint("merge"), "doc_id", "left").select(F.col("doc_id").cast("long").alias("ask"), "key", F.pmod(_drawn("doc_id", 3), F.lit(20000)).alias("t"), "copies")
    age = F.col("t") - F.col("event")
    status = F.when(age.isNull(), "none").when(age > fresh_seconds, "stale").otherwise("fresh")
    out = latest_usable(versions, asks, **parameters).withColumns({"age": age, "status": status})
    current = lambda c: F.when(F.col("status") == "fresh", F.col(f"payload.{c}")).alias(c)
    return out.select(F.col("ask").alias("doc_id"), "t", "version_id", "age", "status", current("n_chars"), current("lang"))
