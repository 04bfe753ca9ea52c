"""Values that nodes of a tree inherit from their nearest ancestor that has one, by pointer jumping.

A node without a value asks its parent; if that has none either, it asks in the next round where the parent asked in this
one, so the distance doubles: a chain of n nodes takes about log2(n) rounds, of one join each. Only nodes that still ask are
written again. Where no node gets an answer in a round, those that ask go round in a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def inherited(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``by``, id, value, origin (the node that has it), steps (between them) and found: own, inherited, none or cycle.

    ``nodes`` has ``by`` (the tree), id (unique there), parent (null of a root) and value (null: inherits). A parent that is
    no node ends the way as a root does. Nodes whose way comes into a cycle without a value are ``cycle``; null ids have no
    row.
    """
    scratch = Scratch(nodes.sparkSession, "trees")
    has = F.col("value").isNotNull()
    start = nodes.where("id is not null").select(
        *by, "id", F.when(~has, F.col("parent")).alias("jump"), "value", F.when(has, F.col("id")).alias("origin"), F.when(has | F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")
    )
    settled, asking = [scratch.cut(start, "start").where("jump is null")], scratch.cut(start, "start-asking").where("jump is not null")
    k = 0
    while not asking.isEmpty():
        k += 1
        known = asking
        for table in settled:
            known = known.unionByName(table)
        other = known.select(*[F.col(c).alias(f"_{c}") for c in (*by, "id", "jump", "value", "origin", "steps")])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("jump") == F.col("_id")]
        met = asking.join(other, same, "left").select(
            *by, "id", F.col("_jump").alias("jump"), F.col("_value").alias("value"), F.col("_origin").alias("origin"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
        met = scratch.cut(met, f"round-{k}")
        answered = met.where("jump is null")
        if answered.isEmpty():
            break
        settled.append(answered)
        asking = met.where("jump is not null")
    out = asking
    for table in settled:
        out = out.unionByName(table)
    found = F.when(F.col("jump").isNotNull(), "cycle").when(F.col("value").isNull(), "none").when(F.col("origin") == F.col("id"), "own").otherwise("inherited")
    return out.select(*by, "id", "value", "origin", F.when(F.col("value").isNotNull(), F.col("steps")).alias("steps"), found.alias("found"))
