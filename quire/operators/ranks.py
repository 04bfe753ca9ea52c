"""Nearest-rank selection without gathering or sorting a group: exact, by counts of digits.

The value of a rank is found digit by digit: values are keyed by whole numbers of the same order, counts by group and
leading digit say which digit the rank falls on, and only values with that digit go on to the next. What is exchanged is
counts, of which a group has at most ``2 ** DIGIT`` a round. Groups of any size take as many rounds as keys have digits.

Groups of at most ``HELD`` distinct values need no rounds: their counts are summed in order in one window. So there are few
groups with rounds, and tables of a row a group, which grow with the documents, meet nothing that could be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .layout import SMALLEST, d

#: Bits of a digit; keys have 64.
DIGIT = 16
#: Distinct values of a group that a window takes.
HELD = 4096
_MANTISSA = 1 << 52


def order_key(value: Column) -> Column:
    """A long of the same order as the double ``value`` (its bits, those of negatives turned round); NaN is the greatest.

    Made by arithmetic that is exact: the exponent is that of a power of two next to the logarithm.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size))
    exponent = near - (size < F.pow(F.lit(2.0), near)).cast("long") + (size >= F.pow(F.lit(2.0), near) * 2).cast("long")
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(_MANTISSA))).cast("long")
    normal = (exponent + 1023) * F.lit(_MANTISSA) + fraction
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    infinite = F.lit(2047 * _MANTISSA)
    bits = F.when(size == float("inf"), infinite).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def nearest_ranks(values: DataFrame, by: list[str], rank: str, value: str = "value", held: int = HELD) -> DataFrame:
    """``by``, n (values of the group) and ``value`` at the rank that the SQL ``rank`` makes of n (from 0, in order).

    ``values`` has ``by`` (nulls are a group as well) and ``value`` (double); null values don't count, and groups without
    others have no row. Equal values are counted where they are read; a row of each is written and read again. Groups of
    more than ``held`` distinct values are taken digit by digit.
    """
    scratch = Scratch(values.sparkSession, "ranks")
    counted = scratch.cut(values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k")), "counted")
    place = F.expr(rank).cast("long")
    large = counted.groupBy(*by).agg(F.sum("k").alias("n"), F.count("*").alias("m")).where(F.col("m") > held).withColumn("place", place).drop("m")
    large = scratch.cut(large, "large")
    if large.isEmpty():
        return _by_window(counted, by, place, value)
    other = lambda frame, *more: frame.select(*[F.col(c).alias(f"_{c}") for c in by], *more)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    small = counted.join(other(large), same, "left_anti")
    left = counted = counted.join(other(large), same, "left_semi").withColumn("key", order_key(F.col(value)))
    wanted = other(large, "n", "place")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        counts = left.groupBy(*by, F.shiftright("key", shift).alias("digit")).agg(F.sum("k").alias("k"), F.min(value).alias("low"))
        upto = F.sum("k").over(Window.partitionBy(*by).orderBy("digit"))
        met = counts.join(wanted, same).withColumn("upto", upto).where("upto > place and upto - k <= place")
        found = scratch.cut(met.select(*by, "n", (F.col("place") - F.col("upto") + F.col("k")).alias("place"), "digit", "low"), f"found-{shift}")
        wanted = other(found, "n", "place")
        left = counted.join(other(found, F.col("digit").alias("_digit")), [*same, F.shiftright("key", shift) == F.col("_digit")], "left_semi")
    return _by_window(small, by, place, value).unionByName(found.select(*by, "n", F.col("low").alias(value)))


def _by_window(counted: DataFrame, by: list[str], place: Column, value: str) -> DataFrame:
    """``nearest_ranks`` of groups whose counts fit a window."""
    of = Window.partitionBy(*by)
    rows = counted.withColumn("upto", F.sum("k").over(of.orderBy(value))).withColumn("n", F.sum("k").over(of))
    return rows.withColumn("place", place).where("upto > place and upto - k <= place").select(*by, "n", value)


def line_values(events: DataFrame) -> DataFrame:
    """doc_id, metric and value of what metrics are taken from: body_font and left_margin of each text line, line_gap to the
    one above on its page, and baseline of each line, blank ones too. ``events`` need not be ordered; of those
    that are ``ranges.noted`` no text is read."""
    blank = F.col("chars") == 0 if "chars" in events.columns else F.regexp_replace("text", r"(?U)^\s+|\s+$", "") == ""
    lines = events.where("is_image = 0").withColumn("blank", blank)
    above = F.lag("y").over(Window.partitionBy("doc_id", "page_num", "blank").orderBy("y", "arrival_seq"))
    gap = F.col("y") - above
    text = lambda v: F.when(~F.col("blank"), v)
    parts = {"body_font": text(F.col("font_size")), "left_margin": text(F.col("x_start")), "line_gap": text(F.when(gap > 0, gap)), "baseline": F.col("font_size")}
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in parts.items()])
    return lines.withColumn("pairs", pairs).select("doc_id", F.inline("pairs")).where("value is not null")


#: Ranks of the metrics among n values, from 0: halves are rounded away from zero.
METRIC_RANK = "case metric when 'left_margin' then round((n - 1) * 0.10D) when 'baseline' then floor(n / 2) else round((n - 1) * 0.5D) end"


def rank_metrics(docs: DataFrame, events: DataFrame) -> DataFrame:
    """The metrics of ``layout.profile_of`` (baseline_font, left_margin, line_gap, baseline) of documents of any size."""
    found = nearest_ranks(line_values(events), ["doc_id", "metric"], METRIC_RANK)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = found.groupBy("doc_id").agg(*[of(m).alias(f"_{m}") for m in ("body_font", "left_margin", "line_gap", "baseline")])
    least = lambda m: F.when(F.col(m).isNotNull(), F.greatest(F.col(m), F.lit(SMALLEST)))
    font, gap = least("_body_font"), least("_line_gap")
    out = {"baseline_font": F.coalesce(font, d(1)), "left_margin": F.coalesce("_left_margin", d(0)), "line_gap": F.coalesce(gap, font, d(1)), "baseline": F.coalesce("_baseline", d(1))}
    return docs.select("doc_id").join(wide, "doc_id", "left").select("doc_id", *[c.alias(n) for n, c in out.items()])
