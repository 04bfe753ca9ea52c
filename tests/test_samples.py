"""Samples as columns against the parser's own."""

import random

from pyspark.sql import functions as F
from quire.functions.samples import cmyk_to_rgb
from quire.sources import raster


def test_cmyk_columns(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randrange(256) for _ in range(n)]) for n in (0, 1, 3, 4, 5, 8, 403, 20_000)] + [(-1, None)]
    found = spark.createDataFrame(rows, "n int, inks array<int>").select("n", cmyk_to_rgb(F.col("inks")).alias("rgb")).collect()
    assert {r["n"]: r["rgb"] for r in found} == {n: None if v is None else list(raster.cmyk_to_rgb(bytes(v))) for n, v in rows}
