"""Merkle fixity audit of WARC archives.

Pages become WARC response records, in files of ``records_per_file`` consecutive page_ids; a record's slot in its file is
its page_id's place there, so that a lost record moves no other. Records are hashed; ordered ranges of ``fanout`` slots
of a file are hashed to nodes, these to nodes above, up to one root per file, and files' roots likewise up to the root of
the archive. A node also holds the length of its range, which gives the offsets of the ranges below it. An audit compares
the roots of two replicas and descends into the children of mismatching nodes only, down to the records that are corrupt,
missing or added.

Records of one page_id share a slot. Equal ones are one leaf with a number of copies; where a slot has many, a trie over
the digits of their digests stands below it, as deep as the fullest slot needs. So every level is one aggregation with
small groups, whatever page_ids repeat; descending is a join of the mismatching nodes with the next level, which is
written once for each replica.

Defined results: null url or html is empty; null page_ids are a file of their own, with file_no null and slots by digest;
repeated rows are copies, of which as many must be in both replicas; texts of any length are hashed whole; equal archives,
and empty ones, give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

FANOUT = 16
RECORDS_PER_FILE = 1024
_KEYS = ["f", "s", "p"]


def warc_record(url: Column, html: Column) -> Column:
    """A WARC response record as text (its UTF-8 form is what is stored); lengths are those of the UTF-8 form."""
    html = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def record_leaves(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """One row per distinct record: file_no, record_no (its slot), page_id, digest (SHA-256 of the record), length, copies."""
    record = warc_record(F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    by_digest = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long")
    placed = hashed.select(
        F.floor(F.col("page_id") / records_per_file).cast("long").alias("file_no"),
        F.pmod(F.coalesce("page_id", by_digest), F.lit(records_per_file)).cast("long").alias("record_no"),
        "page_id",
        "digest",
        "length",
    )
    return placed.groupBy("file_no", "record_no", "page_id", "digest", "length").agg(F.count("*").alias("copies"))


def _height(n: int, fanout: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _parents(digits: int, heights: tuple[int, int], fanout: int) -> list[dict[str, Column]]:
    """For each level from the leaves up, the place of a node's parent: shorter prefixes, ranges of slots, ranges of files.

    A place is (f, s, p): file or range of files, slot or range of slots, first digits of digests.
    """
    keep = {c: F.col(c) for c in _KEYS}
    tries = [keep | {"p": F.substring("p", 1, k)} for k in range(digits - 1, -1, -1)]
    slots = [keep | {"s": F.floor(F.col("s") / fanout).cast("long")}] * heights[0]
    files = [keep | {"f": F.floor(F.col("f") / fanout).cast("long")}] * heights[1]
    return tries + slots + files


def merkle_levels(scratch: Scratch, leaves: DataFrame, label: str, parents: list[dict[str, Column]]) -> list[DataFrame]:
    """Levels of nodes (f, s, p, digest, length), from groups of leaves up to the roots.

    A node's digest covers its children's places and digests in order.
    """

    def above(rows: DataFrame, place: dict[str, Column], child: Column, name: str) -> DataFrame:
        grouped = rows.select(child.alias("child"), "length", *[place[c].alias(c) for c in _KEYS]).groupBy(*_KEYS)
        return scratch.cut(grouped.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("child")), "\n"), 256).alias("digest"), F.sum("length").alias("length")), f"{label}-{name}")

    record = F.concat_ws(":", "digest", F.col("copies").cast("string"))
    levels = [above(leaves.withColumn("length", F.col("length") * F.col("copies")), {c: F.col(c) for c in _KEYS}, record, "leaves")]
    for k, place in enumerate(parents):
        child = F.concat_ws(":", F.col("f").cast("string"), F.col("s").cast("string"), "p", "digest")
        levels.append(above(levels[-1], place, child, f"nodes-{k}"))
    return levels


def _differing(diff: DataFrame) -> DataFrame:
    """Surplus records of either replica; where one page_id has one in each, it is a changed record, in one row."""
    sides = {"gone": F.col("surplus") > 0, "new": F.col("surplus") < 0}
    counts = [F.sum(F.when(test, F.abs("surplus")).otherwise(0)).alias(side) for side, test in sides.items()]
    firsts = [F.max(F.when(sides["gone"], F.col(c))).alias(c) for c in ("offset", "length", "digest")]
    place = ["file_no", "record_no", "page_id"]
    changed = diff.where("page_id is not null").groupBy(*place).agg(*counts, *firsts, F.max(F.when(sides["new"], F.col("digest"))).alias("other_digest")).where("gone = 1 and new = 1")
    rest = diff.join(changed.select(F.col("page_id").alias("id")), F.col("page_id") == F.col("id"), "left_anti")
    columns = [*place, "offset", "length"]
    single = rest.select(*columns, F.when(sides["gone"], F.col("digest")).alias("digest"), F.when(sides["new"], F.col("digest")).alias("other_digest"), F.abs("surplus").alias("copies"))
    return changed.select(*columns, "digest", "other_digest", F.lit(1).cast("long").alias("copies")).unionByName(single)


def fixity_audit(one: DataFrame, other: DataFrame, records_per_file: int = RECORDS_PER_FILE, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas (columns page_id, url, html).

    Rows: file_no, record_no (slot), page_id, offset and length in the replica that has it (``one``, if both do), digest in
    ``one``, other_digest, copies. A record that one replica lacks has a null digest there.
    """
    spark = one.sparkSession
    scratch = Scratch(spark, "fixity")
    leaves = [scratch.cut(record_leaves(pages, records_per_file), f"{name}-records") for pages, name in ((one, "one"), (other, "other"))]
    both = leaves[0].select("file_no", "record_no").union(leaves[1].select("file_no", "record_no"))
    last = both.agg(F.count("*").alias("n"), F.coalesce(F.min("file_no"), F.lit(0)).alias("a"), F.coalesce(F.max("file_no"), F.lit(0)).alias("b")).first()
    fullest = [x.groupBy("file_no", "record_no").count().agg(F.max("count")).first()[0] or 0 for x in leaves]
    digits = _height(-(-max(fullest) // fanout), 16)
    heights = (_height(records_per_file, fanout), _height(max(abs(last["a"]), last["b"] + 1) + 1, fanout))
    parents = _parents(digits, heights, fanout)
    # Null page_ids stand in the file after the last.
    place = {"f": F.coalesce("file_no", F.lit(last["b"] + 1)), "s": F.col("record_no"), "p": F.substring("digest", 1, digits)}
    leaves = [x.withColumns(place) for x in leaves]
    trees = [merkle_levels(scratch, x, name, parents) for x, name in zip(leaves, ("one", "other"))]

    def children(rows: DataFrame, parent: dict[str, Column], suspects: DataFrame, side: str, order: list[str], length: Column) -> DataFrame:
        """Rows below mismatching nodes, with the offset in their file."""
        up = rows.withColumns({f"_{c}": parent[c] for c in _KEYS})
        found = up.join(suspects.select(*[F.col(c).alias(f"_{c}") for c in _KEYS], F.col(side).alias("base")), [f"_{c}" for c in _KEYS])
        before = Window.partitionBy(*[f"_{c}" for c in _KEYS]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return found.withColumn("offset", F.col("base") + F.coalesce(F.sum(length).over(before), F.lit(0))).drop("base", *[f"_{c}" for c in _KEYS])

    suspects: DataFrame | None = None
    in_files = len(parents) - heights[1]  # levels from here up are files and ranges of files: their offset is 0
    for depth in range(len(parents), -1, -1):
        sides = [tree[depth] for tree in trees]
        if suspects is None:
            sides = [x.withColumn("offset", F.lit(0).cast("long")) for x in sides]
        else:
            sides = [children(x, parents[depth], suspects, side, _KEYS, F.col("length")) for x, side in zip(sides, ("mine", "theirs"))]
            if depth >= in_files:
                sides = [x.withColumn("offset", F.lit(0).cast("long")) for x in sides]
        mine, theirs = (x.select(*_KEYS, F.col("digest").alias(f"{n}_digest"), F.col("offset").alias(n)) for x, n in zip(sides, ("mine", "theirs")))
        differing = mine.join(theirs, _KEYS, "full_outer").where("not (mine_digest <=> theirs_digest)")
        suspects = scratch.cut(differing.select(*_KEYS, "mine", "theirs"), f"suspects-{depth}")
    same = {c: F.col(c) for c in _KEYS}
    mine, theirs = (children(x, same, suspects, side, ["digest"], F.col("length") * F.col("copies")) for x, side in zip(leaves, ("mine", "theirs")))
    keys = ["f", "record_no", "page_id", "digest"]
    named = theirs.select(*[F.col(c).alias(f"t_{c}") for c in keys], *[F.col(c).alias(f"their_{c}") for c in ("offset", "length", "copies", "file_no")])
    met = mine.join(named, [F.col(c).eqNullSafe(F.col(f"t_{c}")) if c == "page_id" else F.col(c) == F.col(f"t_{c}") for c in keys], "full_outer")
    surplus = F.coalesce("copies", F.lit(0)) - F.coalesce("their_copies", F.lit(0))
    columns = [F.coalesce("file_no", "their_file_no").alias("file_no"), *[F.coalesce(c, f"t_{c}").alias(c) for c in keys[1:]], *[F.coalesce(c, f"their_{c}").alias(c) for c in ("offset", "length")]]
    return _differing(scratch.cut(met.select(*columns, surplus.alias("surplus")).where("surplus <> 0"), "differing"))
