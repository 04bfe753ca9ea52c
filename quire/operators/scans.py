"""Prefix states of sequences of any length: what all earlier parts of a sequence come to, for each part.

A sequence is cut into parts, each with a state of bounded size; states combine associatively (sums, last values, products
of matrices). Groups of ``FAN`` parts are folded inside the JVM, the groups' own states are the parts of the next level,
until a level is one group; then each group hands its parts what came before it. A task never holds more than a group of a
sequence, and no exchange is by the sequence alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64


def prefix_states(parts: DataFrame, by: list[str], zero: Column, combine: Callable[[Column, Column], Column], last: int, fan: int = FAN) -> DataFrame:
    """``by``, at and before: the combined state of all parts of the sequence with a smaller ``at``; ``zero`` of none.

    ``parts`` has ``by``, at (long, from 0 to ``last``, any of them absent) and state, one row each. ``combine`` takes the
    state so far and the next; both, and ``zero``, have one type.
    """
    item = F.struct("at", "state")
    groups = parts.groupBy(*by, F.floor(F.col("at") / fan).alias("group")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    if last < fan:
        groups = groups.withColumn("before", zero)
    else:
        totals = groups.select(*by, F.col("group").alias("at"), F.reduce("items", zero, lambda s, x: combine(s, x["state"])).alias("state"))
        carried = prefix_states(totals, by, zero, combine, last // fan, fan).withColumnRenamed("at", "group")
        groups = groups.join(carried, [*by, "group"])
    kind = f"array<struct<at:bigint,before:{dict(groups.dtypes)['before']}>>"
    start = F.struct(F.col("before").alias("state"), F.array().cast(kind).alias("done"))
    step = lambda s, x: F.struct(combine(s["state"], x["state"]).alias("state"), F.concat(s["done"], F.array(F.struct(x["at"], s["state"])).cast(kind)).alias("done"))
    return groups.select(*by, F.inline(F.reduce("items", start, step, lambda s: s["done"])))
