"""Where images stand: the transformation in effect at each drawing operator of a content stream of any length.

Operators save the transformation (q), restore it (Q) and change it (cm). Restores without a save are found by the running
depth of saves, as those that reach a new low below zero, and do nothing. Of the others any stretch is a number of restores
to before it, then a factor for each save that is still open (the first changes what was there): such stretches combine
associatively. Streams are cut into parts of ``PART`` operators, each folded inside the JVM, and prefix states of the parts
give each what is in effect where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .glyphs import image_y
from .scans import prefix_states

PART = 256
_AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
_STRETCH = f"struct<pops:int,factors:array<{_AFFINE}>>"
_UNIT = f"cast(named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', 1D, 'e', 0D, 'f', 0D) as {_AFFINE})"


def then(x: Column, y: Column) -> Column:
    """The affine matrix of a change ``x`` within which another, ``y``, is made."""
    return F.struct(
        (y["a"] * x["a"] + y["b"] * x["c"]).alias("a"), (y["a"] * x["b"] + y["b"] * x["d"]).alias("b"),
        (y["c"] * x["a"] + y["d"] * x["c"]).alias("c"), (y["c"] * x["b"] + y["d"] * x["d"]).alias("d"),
        (y["e"] * x["a"] + y["f"] * x["c"] + x["e"]).alias("e"), (y["e"] * x["b"] + y["f"] * x["d"] + x["f"]).alias("f"),
    ).cast(_AFFINE)


def _followed(x: Column, y: Column) -> Column:
    """A stretch and the one after it, as one."""
    open_ = F.size(x["factors"]) - 1
    left = open_ - y["pops"]  # saves of x that are open when the first factor of y comes
    top = F.array(then(F.get(x["factors"], left), F.get(y["factors"], F.lit(0))))
    inside = F.concat(F.slice(x["factors"], F.lit(1), F.greatest(left, F.lit(0))), top, F.slice(y["factors"], F.lit(2), F.size(y["factors"]) - 1))
    return F.when(left >= 0, F.struct(x["pops"].alias("pops"), inside.alias("factors")).cast(_STRETCH)).otherwise(F.struct((x["pops"] - left).alias("pops"), y["factors"].alias("factors")).cast(_STRETCH))


def _parts(operators: DataFrame, by: list[str], part: int) -> DataFrame:
    return operators.withColumn("at", F.floor(F.col("k") / part))


def matched(operators: DataFrame, by: list[str], part: int = PART, last: int | None = None) -> DataFrame:
    """``operators`` (``by``, k, op) without the restores that have no save, and with at, the part."""
    rows = _parts(operators, by, part).withColumn("step", F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0).cast("long"))
    order = Window.partitionBy(*by, "at").orderBy("k")
    rows = rows.withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.struct(F.max_by("sum", "k").alias("sum"), F.least(F.min("sum"), F.lit(0).cast("long")).alias("low"))
    parts = rows.groupBy(*by, "at").agg(state.alias("state"))
    joined = lambda a, b: F.struct((a["sum"] + b["sum"]).alias("sum"), F.least(a["low"], a["sum"] + b["low"]).alias("low"))
    before = prefix_states(parts, by, F.expr("named_struct('sum', 0L, 'low', 0L)"), joined, last_part(operators, part) if last is None else last)
    rows = rows.join(before, [*by, "at"])
    depth = F.col("before.sum") + F.col("sum")
    low = F.least("before.low", F.coalesce(F.min(depth).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return rows.withColumn("lost", (F.col("op") == "Q") & (depth < low)).where("not lost").drop("step", "sum", "before", "lost")


def last_part(operators: DataFrame, part: int = PART) -> int:
    return (operators.agg(F.max("k")).first()[0] or 0) // part


def drawn_places(operators: DataFrame, by: list[str], height: Column, part: int = PART) -> DataFrame:
    """``by``, k, saves (open ones), matrix and y (of the upper edge, from the top of a page ``height`` high) of each Do.

    ``operators`` has ``by``, k (the order, from 0), op and, of cm, a to f (doubles). Other operators, and rows of null op,
    do nothing.
    """
    last = last_part(operators, part)
    unit, at = F.expr(_UNIT), F.struct("a", "b", "c", "d", "e", "f").cast(_AFFINE)
    known = matched(operators.where("op in ('q', 'Q', 'cm', 'Do')"), by, part, last)
    factors = F.when(F.col("op") == "q", F.array(unit, unit)).when(F.col("op") == "cm", F.array(at)).otherwise(F.array(unit))
    own = F.struct((F.col("op") == "Q").cast("int").alias("pops"), factors.alias("factors")).cast(_STRETCH)
    items = F.array_sort(F.collect_list(F.struct("k", (F.col("op") == "Do").alias("draws"), own.alias("own"))))
    parts = known.groupBy(*by, "at").agg(items.alias("items"))
    zero = F.struct(F.lit(0).alias("pops"), F.array(unit).alias("factors")).cast(_STRETCH)
    states = parts.select(*by, "at", F.reduce("items", zero, lambda s, x: _followed(s, x["own"])).alias("state"))
    met = parts.join(prefix_states(states, by, zero, _followed, last), [*by, "at"])
    kind = f"array<struct<k:bigint,saves:int,matrix:{_AFFINE}>>"

    def step(s: Column, x: Column) -> Column:
        matrix = F.reduce(s["now"]["factors"], unit, then)
        place = F.array(F.struct(x["k"].cast("long").alias("k"), (F.size(s["now"]["factors"]) - 1).alias("saves"), matrix.alias("matrix"))).cast(kind)
        return F.struct(_followed(s["now"], x["own"]).alias("now"), F.when(x["draws"], F.concat(s["places"], place)).otherwise(s["places"]).alias("places"))

    places = F.reduce("items", F.struct(F.col("before").alias("now"), F.array().cast(kind).alias("places")), step, lambda s: s["places"])
    found = met.select(*by, F.inline(places))
    plain = [F.when(F.col(f"matrix.{c}") == 0, 0.0).otherwise(F.col(f"matrix.{c}")).alias(c) for c in "abcdef"]  # no negative zeros
    found = found.withColumn("matrix", F.struct(*plain))
    return found.withColumn("y", image_y(height, F.col("matrix.d"), F.col("matrix.f")))
