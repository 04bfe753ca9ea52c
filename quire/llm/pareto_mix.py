"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words: its share of the budget by weight, at most ``max_copies`` times its size, the excess
reshared by weight among the others. Within a source, a document's expected number of copies grows with its length, as
the power ``LEAN`` of its words (in classes of half an octave), up to ``max_copies``: longer documents hold less
boilerplate a word. The factor is chosen so that the expected words are the target. The whole part of the number is
certain; for the rest, the documents of a source are ranked by Pareto order: the odds of a uniform random number (a hash
of doc_id and seed) over the odds of the document's own inclusion probability. Of the ranking, the documents before the
point where their words reach the target are taken, the last one only if that is nearer: the sample's size is fixed, in
words, and its probabilities are unequal.

The point is found without sorting a source in one task: ranks fall into ``BUCKETS`` equal buckets, whose word sums are
added up by source, and the one that holds the point into as many again; only what falls into the last is ordered.

Defined results: null text is no words; null source is a source of its own, last in order; rows of equal doc_id (null,
too) and length have equal ranks, and where the point falls among them, as many as fit are taken, whichever; documents
and sources without words take nothing; a text of any length is one document; an empty table gives no rows; columns of
any other names pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh

BUCKETS = 4096
#: Copies grow as this power of a document's words.
LEAN = 0.25
#: Rows of equal rank that are numbered in one task.
GROUP = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _levelled(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """``parts`` (weight, cap, budget) with ``level``: what a unit of weight gets, null where all are at their cap.

    Water filling: parts in order of cap / weight are at their cap up to a point; the others get the rest by weight. The
    point is the first part whose cap is not below the level of the rest; levels only fall after it.
    """
    all_of = Window.partitionBy(*(by or [F.lit(0)]))
    before = all_of.orderBy("ratio", F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(F.col("open") > 0, F.col("rest") / F.col("open"))
    return (
        parts.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("rest", rest).withColumn("open", open_)
        .withColumn("level", level).withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(all_of))
        .drop("ratio", "rest", "open")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: float) -> DataFrame:
    """``sizes`` (source, source_size; one row each) with ``target``, in words."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    parts = sizes.withColumn("weight", weight).withColumns(
        {"cap": F.col("source_size") * F.lit(float(max_copies)), "budget": F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))}
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return _levelled(parts, [], "source").select("source", "source_size", target.alias("target"))


def class_rates(narrow: DataFrame, weights: tuple[int, ...], share: float, max_copies: float, lean: float) -> DataFrame:
    """source, class, source_size, target and rate: the expected copies of a document of that source and class.

    ``narrow`` has source, class and size. A source has at most some hundred classes.
    """
    parts = narrow.groupBy("source", "class").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, max_copies)
    parts = parts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    lean_of = F.pow(F.lit(2.0), F.col("class") * F.lit(lean / 2))
    filling = parts.where("part > 0").withColumns({"weight": F.col("part") * lean_of, "cap": F.col("part") * F.lit(float(max_copies)), "budget": F.col("target")})
    levels = _levelled(filling, ["source"], "class").groupBy("source").agg(F.max("level").alias("level")).withColumnRenamed("source", "s")
    rate = F.when(F.col("part") > 0, F.coalesce(F.least(F.lit(float(max_copies)), lean_of * F.col("level")), F.lit(float(max_copies)))).otherwise(0.0)
    return parts.join(levels, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "class", "source_size", "target", rate.alias("rate"))


def _sized(docs: DataFrame, seed: int, names: dict[str, str]) -> DataFrame:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    size = F.col(names["size"])
    # Out of an array, so that words are counted once a row, however often the plan uses their number.
    return docs.withColumn(names["size"], F.explode(F.array(word_count(F.col("text"))))).withColumns({names["class"]: F.floor(2 * F.log2(size + 1)).cast("int"), names["u"]: u})


def _ranked(frame: DataFrame, rates: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds whole copies, the Pareto rank for one more (null if none is open) and its place in [0, 1)."""
    n = names
    rates = rates.select(*[F.col(c).alias(n[f"rate_{c}"]) for c in rates.columns])
    m, u = F.col(n["rate_rate"]), F.col(n["u"])
    p, rank = m - F.floor(m), F.col(n["rank"])
    joined = frame.join(rates, frame["source"].eqNullSafe(F.col(n["rate_source"])) & (F.col(n["class"]) == F.col(n["rate_class"])))
    return (
        joined.drop(n["rate_source"], n["rate_class"])
        .withColumn(n["rank"], F.when((p > 0) & (F.col(n["size"]) > 0), (u / (1 - u)) / (p / (1 - p))))
        .withColumn(n["place"], rank / (1 + rank))  # a monotone map of all ranks
    )


def _points(scratch: Scratch, ranked: DataFrame) -> DataFrame:
    """For each source where the sample ends: the last rank, doc_id and size, the rows n that have them, and how many go in.

    ``ranked`` has source, doc_id, size, rank, place, rate, target.
    """
    by_source, room, size = Window.partitionBy("source"), F.col("room"), F.col("size")
    certain = ranked.groupBy("source").agg(F.sum(F.floor("rate") * size).alias("certain"), F.max("target").alias("target"))
    points = certain.select(F.col("source").alias("s"), (F.col("target") - F.col("certain")).alias("room"))
    rows = ranked.where("rank is not null").select("source", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "size", "rank", "place")
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in (1, 2):
        bucket = F.floor(F.col("place") * F.lit(float(BUCKETS**level)))
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("part"))
        sums = sums.join(points, same).drop("s").withColumn("upto", F.sum("part").over(by_source.orderBy("bucket")))
        # The first bucket that reaches the room; the last, where rounding leaves all of them below it.
        last = F.max("bucket").over(by_source)
        found = sums.withColumn("last", last).where("upto >= room or bucket = last").groupBy("source").agg(F.min(F.struct("bucket", "part", "upto", "room")).alias("at"))
        points = scratch.cut(found.select(F.col("source").alias("s"), F.col("at.bucket").alias("cut"), (F.col("at.room") - F.col("at.upto") + F.col("at.part")).alias("room")), f"cuts-{level}")
        rows = rows.join(points.drop("room"), same & (bucket == F.col("cut"))).drop("s", "cut")
        points = points.drop("cut")
    groups = rows.groupBy("source", "rank", "id", "size").agg(F.count("*").alias("n")).join(points, same).drop("s")
    order = by_source.orderBy("rank", "id", "size")
    groups = groups.withColumn("upto", F.sum(F.col("n") * size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("rank").over(order).isNull())
    taken = F.least(F.col("n"), F.greatest(F.lit(0), F.round((room - F.col("upto") + F.col("n") * size) / size))).cast("long")  # the last if more than half of it fits
    end = F.struct("rank", "id", "size", "n", taken.alias("taken"))
    return scratch.cut(groups.where("upto >= room or last").groupBy("source").agg(F.min(end).alias("end")).select(F.col("source").alias("s"), "end.*"), "points")


def _number(scratch: Scratch, equal: DataFrame, source: str, n: str, taken: str, more: str) -> DataFrame:
    """Rows of equal rank at the end of a sample, with ``more``: whether one goes in.

    They are written with a salt first, so that it doesn't change; salts are filled in turn.
    """
    salt, k, count, s, base = fresh(equal.columns, "salt", "k", "count", "salted_source", "base")
    salted = scratch.cut(equal.withColumn(salt, F.expr(f"pmod(monotonically_increasing_id(), cast(ceil(`{n}` / {GROUP}) as long))")), "equal")
    counts = salted.groupBy(F.col(source).alias(s), F.col(salt).alias(k)).agg(F.count("*").alias(count))
    before = Window.partitionBy(s).orderBy(k).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(count).over(before), F.lit(0))).drop(count)
    joined = salted.join(counts, F.col(source).eqNullSafe(F.col(s)) & (F.col(salt) == F.col(k))).drop(s, k)
    row = F.row_number().over(Window.partitionBy(source, salt).orderBy(F.xxhash64("text") if "text" in equal.columns else F.lit(0)))
    return joined.withColumn(more, row + F.col(base) <= F.col(taken)).drop(salt, base)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0, seed: int = 17, texts: bool = True, lean: float = LEAN
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns, and their names: size (words), source_size, target (words of its source in the
    mix) and copies (long). Names are other than those of ``docs``.

    Without ``texts``, only source and doc_id are kept of ``docs``, and the texts are read once instead of twice.
    """
    scratch = Scratch(docs.sparkSession, "pareto-mix")
    kinds = ("size", "class", "u", "rank", "place", "copies", "more", "rate_source", "rate_class", "rate_source_size", "rate_target", "rate_rate", "s", "id", "end_rank", "end_size", "n", "taken")
    names = dict(zip(kinds, fresh(docs.columns, *[f"mix_{k}" for k in kinds])))
    plain = {k: f"mix_{k}" for k in kinds}
    sized = _sized(docs, seed, names)
    flat = [F.col(names[k]).alias(k) for k in ("size", "class", "u")]
    narrow = scratch.cut(sized.select("source", F.col("doc_id").cast("long").alias("doc_id"), *flat), "narrow")
    rates = scratch.cut(class_rates(narrow, weights, share, max_copies, lean), "rates")
    own = narrow.withColumnsRenamed({k: plain[k] for k in ("size", "class", "u")})
    slim = _ranked(own, rates, plain).select(
        "source", "doc_id", *[F.col(plain[k]).alias(k) for k in ("size", "rank", "place")], F.col(plain["rate_rate"]).alias("rate"), F.col(plain["rate_target"]).alias("target")
    )
    points = _points(scratch, slim)
    if not texts:
        sized, names = own, plain
    ranked = _ranked(sized, rates, names)
    ends = points.select(F.col("s").alias(names["s"]), *[F.col(c).alias(names[k]) for c, k in (("rank", "end_rank"), ("id", "id"), ("size", "end_size"), ("n", "n"), ("taken", "taken"))])
    joined = ranked.join(ends, ranked["source"].eqNullSafe(F.col(names["s"])), "left").drop(names["s"])
    place = F.struct(F.col(names["rank"]).alias("a"), F.coalesce(ranked["doc_id"].cast("long"), F.lit(0).cast("long")).alias("b"), F.col(names["size"]).alias("c"))
    end = F.struct(F.col(names["end_rank"]).alias("a"), F.col(names["id"]).alias("b"), F.col(names["end_size"]).alias("c"))
    at_end = F.col(names["rank"]).isNotNull() & (place == end)
    single = F.when(F.col(names["rank"]).isNull(), False).otherwise((place < end) | (place == end) & (F.col(names["taken"]) >= F.col(names["n"])))
    split = F.coalesce(at_end & (F.col(names["taken"]) > 0) & (F.col(names["taken"]) < F.col(names["n"])), F.lit(False))
    if points.where("taken > 0 and taken < n").limit(1).count():  # some rows of equal rank are taken, others not
        whole = joined.where(~split).withColumn(names["more"], single)
        joined = whole.unionByName(_number(scratch, joined.where(split), "source", names["n"], names["taken"], names["more"]))
    else:
        joined = joined.withColumn(names["more"], single)
    copies = F.floor(names["rate_rate"]).cast("long") + F.coalesce(F.col(names["more"]), F.lit(False)).cast("long")
    out = {"size": names["size"], "source_size": names["rate_source_size"], "target": names["rate_target"], "copies": names["copies"]}
    base = docs.columns if texts else ["source", "doc_id"]
    return joined.withColumn(names["copies"], copies).select(*base, *out.values()), out


def mix_digest(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    mixed, of = mix_sources(docs.select("doc_id", "source", "text"), texts=False, **parameters)
    return mixed.select(
        "doc_id", F.col(of["size"]).alias("size"), F.col(of["source_size"]).alias("source_size"), F.col(of["target"]).alias("target"), (F.col(of["size"]) * F.col(of["copies"])).alias("taken")
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the same columns."""
    mixed, of = mix_sources(docs, **parameters)
    (copy,) = fresh(mixed.columns, "mix_copy")
    return mixed.where(F.col(of["copies"]) > 0).withColumn(copy, F.explode(F.expr(f"sequence(1L, `{of['copies']}`)"))).select(*docs.columns)
