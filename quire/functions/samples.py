"""Samples of images as columns: arithmetic that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cmyk_to_rgb(inks: Column) -> Column:
    """Components 0 to 255 of pixels with four inks each, to those of pixels with three colours each.

    Single precision, truncated, as the parser's; an incomplete last pixel is left out. Null gives null.
    """
    left = lambda ink: F.lit(1).cast("float") - (ink / 255).cast("float")
    colour = lambda c, at, k: F.floor(F.lit(255).cast("float") * left(c[at + k]) * left(c[at + 3])).cast("int")
    pixels = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 4, F.lit(4)), lambda at: F.array(*[colour(c, at, k) for k in range(3)]))
    found = lambda c: F.when(F.size(c) >= 4, F.flatten(pixels(c))).when(c.isNotNull(), F.array().cast("array<int>"))
    return F.transform(F.array(inks), found)[0]  # inks are found once, not once for each pixel
