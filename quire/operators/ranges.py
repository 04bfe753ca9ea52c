"""Chapters and blocks of documents of any size, range of pages by range of pages.

What a row needs of the rows before it is little: how many events and chapters there were, whether the last event was a
heading, and the last two live rows of the chapter (a block starts by the kind of the row before, which hangs on whether an
image stood before that one). So each range tells these of itself, a prefix over the ranges says what each of them begins
with, and each range is done alone, the same windows over it that ``layout`` has over a document. Numbers of blocks take a
second prefix. No window or exchange of events is by doc_id alone; a task holds some ranges of ``PAGES`` pages.

Events are written once, with what their texts tell (``noted``): metrics, states and sums read numbers alone, and text is
sent twice, to its range and to its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .layout import line_kind, with_facts, with_headings, with_kinds, with_live
from .scans import prefix_states

#: Pages of a range.
PAGES = 32
_BY = ["doc_id", "range"]
_ORDER = ("page_num", "y", "is_image", "arrival_seq")
_TAIL = "array<struct<is_image:int,y:double,chars:int,worded:boolean,font_size:double,x_start:double>>"
_STATE = f"struct<n:bigint,starts:bigint,first_heading:boolean,last_heading:boolean,resets:boolean,tail:{_TAIL}>"


def noted(events: DataFrame) -> DataFrame:
    """``events`` with facts, written once for all who read them."""
    return Scratch(events.sparkSession, "events").cut(with_facts(events), "events")


def _last_two(rows: Column) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - 1, F.lit(1)), F.lit(2))


def _joined(a: Column, b: Column) -> Column:
    """The state of a range that follows another."""
    seam = F.coalesce(a["last_heading"] & b["first_heading"], F.lit(False)).cast("long")
    tail = F.when(b["resets"], b["tail"]).otherwise(_last_two(F.concat(a["tail"], b["tail"])))
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["starts"] + b["starts"] - seam).alias("starts"), F.coalesce(a["first_heading"], b["first_heading"]).alias("first_heading"),
        F.coalesce(b["last_heading"], a["last_heading"]).alias("last_heading"), (a["resets"] | b["resets"]).alias("resets"), tail.alias("tail"),
    ).cast(_STATE)


def _states(flow: DataFrame) -> DataFrame:
    """doc_id, at (the range) and state of each range of rows ``with_live``."""
    order = Window.partitionBy(*_BY).orderBy(*_ORDER)
    rows = flow.withColumn("start", F.col("is_heading") & ~F.coalesce(F.lag("is_heading").over(order), F.lit(False)))
    rows = rows.withColumn("upto", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("headings", F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy(*_BY)))
    place, own = F.struct(*_ORDER), ("is_image", "y", "chars", "worded", "font_size", "x_start")
    tail = F.struct(*_ORDER, *[F.col(c).alias(f"_{c}") for c in own])
    last = F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("upto") == F.col("headings")), tail)))
    found = rows.groupBy(*_BY).agg(
        F.count("*").alias("n"), F.count_if("start").alias("starts"), F.min_by("is_heading", place).alias("first_heading"), F.max_by("is_heading", place).alias("last_heading"),
        (F.max("headings") > 0).alias("resets"), F.transform(_last_two(last), lambda r: F.struct(*[r[f"_{c}"].alias(c) for c in own])).alias("tail"),
    )
    return found.select("doc_id", F.col("range").alias("at"), F.struct("n", "starts", "first_heading", "last_heading", "resets", "tail").cast(_STATE).alias("state"))


def _before(parts: DataFrame, zero: Column, combine) -> DataFrame:
    last = parts.agg(F.max("at")).first()[0] or 0
    return prefix_states(parts, ["doc_id"], zero, combine, last).withColumnRenamed("at", "range")


def range_kinds(events: DataFrame, known: DataFrame, pages: int = PAGES) -> DataFrame:
    """``layout.classified`` without block_ord, of events (``noted`` or not) that need no event_seq: adds range, event_seq,
    chapter_id, live, kind, indented, gapped, after_image, starts and carried (of a chapter that began before the range).

    ``known`` has a row a document: baseline, baseline_font, left_margin, line_gap and consumed_image; page numbers are not
    negative. Documents without events have no rows.
    """
    scratch = Scratch(events.sparkSession, "ranges")
    rows = (events if "chars" in events.columns else noted(events)).withColumn("range", F.floor(F.col("page_num") / pages))
    own = scratch.cut(rows.select(*_BY).distinct().join(known, "doc_id"), "known")
    parts = scratch.cut(_states(with_live(with_headings(rows.join(own, _BY)))), "states")
    zero = F.expr(f"cast(named_struct('n', 0L, 'starts', 0L, 'first_heading', null, 'last_heading', null, 'resets', false, 'tail', array()) as {_STATE})")
    own = scratch.cut(own.join(_before(parts, zero, _joined), _BY), "before")
    met = with_live(with_headings(rows.join(own, _BY)))

    order = Window.partitionBy(*_BY).orderBy(*_ORDER)
    previous = F.coalesce(F.lag("is_heading").over(order), F.col("before.last_heading"), F.lit(False))
    met = met.withColumn("event_seq", F.row_number().over(order) + F.col("before.n")).withColumn("start", (F.col("is_heading") & ~previous).cast("int"))
    met = met.withColumn("chapter_id", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before.starts"))
    met = met.withColumn("carried", F.col("chapter_id") == F.col("before.starts"))
    tail = F.when(F.col("carried"), F.col("before.tail"))
    back = lambda k: F.get(tail, F.size(tail) - k)
    row = back(1)
    kind = line_kind(row["chars"], row["worded"], row["font_size"], row["x_start"], row["is_image"] == 1, F.col("baseline_font"), F.coalesce(back(2)["is_image"] == 1, F.lit(False)))
    found = with_kinds(met, order, F.when(row.isNotNull(), F.struct(row["is_image"], row["y"])), F.when(row.isNotNull(), kind))
    return found.drop("start", "before", "chars", "worded", "chapter_line")


def range_blocks(kinds: DataFrame) -> DataFrame:
    """``layout.blocks`` of ``range_kinds``: doc_id, chapter_id, block_ord, kind, text, image_idx.

    ``kinds`` are made twice: without text for the numbers of blocks, then with it.
    """
    scratch = Scratch(kinds.sparkSession, "range-blocks")
    kinds = kinds.where("live").select(*_BY, "chapter_id", "event_seq", "kind", "starts", "text", "image_idx")
    # Of each range: its last chapter, and the blocks that this begins there.
    sums = kinds.groupBy(*_BY, "chapter_id").agg(F.sum("starts").alias("n"))
    parts = scratch.cut(sums.groupBy("doc_id", F.col("range").alias("at")).agg(F.max(F.struct("chapter_id", "n")).alias("state")), "sums")
    joined = lambda a, b: F.when(a["chapter_id"] == b["chapter_id"], F.struct(b["chapter_id"], (a["n"] + b["n"]).alias("n"))).otherwise(b)
    before = scratch.cut(_before(parts, F.expr("named_struct('chapter_id', -1L, 'n', 0L)"), joined), "sums-before")
    order = Window.partitionBy(*_BY, "chapter_id").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.when(F.col("before.chapter_id") == F.col("chapter_id"), F.col("before.n")).otherwise(0)
    rows = kinds.withColumn("own", F.sum("starts").over(order)).join(before, _BY).withColumn("block_ord", F.col("own") + earlier)
    return rows.groupBy("doc_id", "chapter_id", "block_ord").agg(
        F.max("kind").alias("kind"), F.expr("listagg(text, ' ') within group (order by event_seq)").alias("text"), F.max("image_idx").alias("image_idx")
    )
