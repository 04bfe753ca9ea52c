"""From positioned glyphs to lines of text, and positions of images.

``glyphs``: doc_id, page_num, k (order on the page), x, y, width (in ems), font_size, ch, word_start, page_width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utrim

# Breaks of a line, in font sizes.
JUMP, STEP = 1.5, 0.5


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """Lines by page: doc_id, page_num, line_ord, text, y, font_size, x_start (a share of the page width)."""
    order = Window.partitionBy("doc_id", "page_num").orderBy("k")
    down = F.abs(F.col("y") - F.lag("y").over(order))
    left = F.col("x") < F.lag(F.col("x") + F.col("width") * F.col("font_size")).over(order)
    breaks = F.col("word_start") & ((down > F.lit(JUMP) * F.col("font_size")) | (left & (down > F.lit(STEP) * F.col("font_size"))))
    marked = glyphs.withColumn("b", F.coalesce(breaks, F.lit(False)).cast("int"))
    marked = marked.withColumn("line_id", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    width = F.max("page_width")
    lines = marked.groupBy("doc_id", "page_num", "line_id").agg(
        utrim(F.expr("listagg(ch, '') within group (order by k)")).alias("text"),
        F.min_by("y", "k").alias("y"),
        F.max("font_size").alias("font"),
        F.min("x").alias("x"),
        F.when(width > 0, width).otherwise(F.lit(1.0)).alias("page_width"),
    )
    numbered = lines.where("text <> ''").withColumn("line_ord", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("line_id")))
    share = F.least(F.greatest(F.col("x") / F.col("page_width"), F.lit(0.0)), F.lit(1.0))
    return numbered.select("doc_id", "page_num", "line_ord", "text", "y", F.when(F.col("font") > 0, F.col("font")).otherwise(F.lit(1.0)).alias("font_size"), share.alias("x_start"))


def image_y(height: Column, d: Column, f: Column) -> Column:
    """Distance of an image's upper edge from the page's top, by its matrix [a b c d e f] and the page height."""
    return F.least(height - f, height - d - f)
