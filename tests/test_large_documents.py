"""Operators that hold for documents of any size: prefix states, rank selection, ranges of pages."""

import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from quire.operators import covers as C
from quire.operators import layout as L
from quire.operators.matrices import drawn_places
from quire.operators.ranges import range_blocks, range_kinds
from quire.operators.ranks import nearest_ranks, order_key, rank_metrics
from quire.operators.scans import prefix_states
from quire.operators.trees import inherited
from quire.scratch import Scratch

EVENTS = "doc_id long, page_num int, arrival_seq int, y double, is_image int, text string, font_size double, x_start double, image_idx int"


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_prefix_states_keep_order(spark, fan):
    """Of a state whose order counts, with parts that are absent, two sequences and a null key's none."""
    rng = random.Random(fan)
    parts = {(k, at): chr(97 + rng.randrange(26)) for k in (1, 2) for at in range(0, 150) if rng.random() < 0.4}
    df = spark.createDataFrame([(k, at, c) for (k, at), c in parts.items()], "k long, at long, state string")
    found = {(r["k"], r["at"]): r["before"] for r in prefix_states(df, ["k"], F.lit(""), F.concat, 149, fan).collect()}
    assert found == {(k, at): "".join(c for (j, b), c in sorted(parts.items()) if j == k and b < at) for k, at in parts}


def test_order_keys(spark):
    """Keys have the order of the values, down to neighbours, the smallest numbers, infinities and NaN."""
    rng = random.Random(8)
    values = [0.0, 1.0, 2.0, 0.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, 1e-310, 3.0, 8.0]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)] + [2.0**k for k in range(-1074, 1024, 7)]
    values += [math.nextafter(v, s) for v in values for s in (-math.inf, math.inf)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", order_key(F.col("v")))
    rows = df.collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [(r["v"], r["k"]) for r in rows] == [(r["v"], bits(r["v"])) for r in rows]
    assert spark.range(1).select(order_key(F.lit(float("nan"))) > order_key(F.lit(math.inf))).first()[0]


def test_nearest_ranks(spark):
    rng = random.Random(9)
    rows = [("many", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(rng.randrange(-2, 3))) for _ in range(500)]
    rows += [("one", -7.5), ("none", None), (None, 3.0), (None, 1.0), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    for q in (0.0, 0.1, 0.5, 1.0):
        found = {r["g"]: (r["n"], r["value"]) for r in nearest_ranks(df, ["g"], f"round((n - 1) * {q}D)").collect()}
        expected = {}
        for g in ("many", "ties", "one", None):
            values = sorted(v for k, v in rows if k == g and v is not None)
            expected[g] = (len(values), values[math.floor((len(values) - 1) * q + 0.5)])
        assert found == expected
    assert nearest_ranks(df.where("false"), ["g"], "0").collect() == []


def test_nearest_ranks_of_large_groups(spark):
    """Groups beyond what a window takes, beside small ones: the same values, digit by digit."""
    rng = random.Random(4)
    rows = [("many", rng.gauss(0, 1)) for _ in range(900)] + [(None, rng.choice((-1, 1)) * math.exp(rng.uniform(-300, 300))) for _ in range(700)] + [("few", float(k % 3)) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, value double")
    for q in (0.0, 0.5, 1.0):
        found = [nearest_ranks(df, ["g"], f"round((n - 1) * {q}D)", held=held).collect() for held in (8, 4096)]
        assert sorted(found[0], key=str) == sorted(found[1], key=str) and len(found[0]) == 3


def test_ranks_broadcast_no_table_of_all_groups(spark, monkeypatch):
    """A table of a row a group is small as a file however many groups there are; it must not go through the driver."""
    plans, cut = [], Scratch.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "cut", lambda self, df, label: (plans.append(plan(df)), cut(self, df, label))[1])
    df = spark.range(20000).selectExpr("id % 5000 as g", "cast(id as double) as value")
    found = nearest_ranks(df, ["g"], "0")
    assert not [p for p in [*plans, plan(found)] if "Broadcast" in p]
    assert found.count() == 5000 and found.where("n = 4 and value = g").count() == 5000


def walked(nodes):
    """(value, origin, steps, found) of each node, by walking up."""
    out = {}
    for key in nodes:
        at, steps, seen = key, 0, set()
        while True:
            parent, value = nodes[at]
            up = None if parent is None else (key[0], parent)
            if value is not None:
                out[key] = (value, at[1], steps, "inherited" if steps else "own")
            elif up not in nodes:
                out[key] = (None, None, None, "none")
            elif up in seen:
                out[key] = (None, None, None, "cycle")
            else:
                at, steps = up, steps + 1
                seen.add(up)
                continue
            break
    return out


def test_inherited_values(spark):
    """Chains, stars, absent parents, cycles with and without a value, a node that is its own parent, two trees."""
    rng = random.Random(11)
    nodes = {("chain", k): (k - 1 if k else None, "top" if k == 0 else None) for k in range(300)} | {("lost", k): (k - 1, None) for k in range(100)}
    nodes |= {("round", k): ((k + 1) % 20, None) for k in range(20)} | {("round", 30 + k): (29 + k if k else 3, None) for k in range(9)} | {("round", 50): (50, None)}
    nodes |= {("ring", k): ((k + 1) % 9, 5 if k == 4 else None) for k in range(9)} | {("star", k): (0 if k else None, None) for k in range(40)}
    nodes |= {("wild", k): (rng.choice((None, *range(80))), rng.choice((None, None, None, k))) for k in range(80)}
    df = spark.createDataFrame([(t, k, p, None if v is None else str(v)) for (t, k), (p, v) in nodes.items()] + [("chain", None, 3, "x")], "tree string, id long, parent long, value string")
    found = {(r["tree"], r["id"]): (r["value"], r["origin"], r["steps"], r["found"]) for r in inherited(df, ["tree"]).collect()}
    assert found == {k: (None if v is None else str(v), *rest) for k, (v, *rest) in walked(nodes).items()}
    assert inherited(df.where("false"), ["tree"]).collect() == []


def stacked(ops):
    """(k, saves, matrix) of each Do, by a stack."""
    out, saved, now = [], [], (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for k, op, m in ops:
        if op == "q":
            saved.append(now)
        elif op == "Q" and saved:
            now = saved.pop()
        elif op == "cm":
            (a, b, c, d, e, f), (p, q, r, s, t, u) = m, now
            now = (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)
        elif op == "Do":
            out.append((k, len(saved), now))
    return out


@pytest.mark.parametrize("part", [1, 4, 256])
def test_places_of_a_stack(spark, part):
    """Restores without saves, deep saves, streams longer than a part, operators that do nothing."""
    rng = random.Random(part)
    streams = {}
    for s, weights in enumerate(((2, 2, 3, 2, 1), (4, 1, 2, 1, 0), (1, 5, 2, 2, 0), (0, 1, 1, 1, 0), (0, 0, 0, 3, 0))):
        streams[s] = [(k, rng.choices(("q", "Q", "cm", "Do", "BT"), weights)[0], tuple(float(rng.choice((-1, 0, 1))) for _ in range(4)) + (rng.randrange(-9, 9) * 1.0, rng.randrange(9) * 1.0)) for k in range(rng.choice((40, 150)))]
    df = spark.createDataFrame([(s, k, op, *m) for s, ops in streams.items() for k, op, m in ops] + [(9, 0, None, *[0.0] * 6)], "s long, k long, op string, a double, b double, c double, d double, e double, f double")
    found = sorted((r["s"], r["k"], r["saves"], tuple(r["matrix"]), r["y"]) for r in drawn_places(df, ["s"], F.lit(100.0), part).collect())
    expected = [(s, k, n, m, min(100 - m[5], 100 - m[3] - m[5])) for s, ops in streams.items() for k, n, m in stacked(ops)]
    assert found == sorted(expected)
    assert drawn_places(df.where("false"), ["s"], F.lit(1.0)).collect() == []


def book(rng, doc, n):
    """Events on pages that are few or many lines long: headings in runs, images, captions, blanks, indents and gaps."""
    out, page, y = [], rng.randrange(3), 60.0
    for k in range(n):
        if rng.random() < 0.12:
            page, y = page + rng.choice((1, 1, 1, 5)), 60.0
        y += rng.choice((0.0, 19.5, 19.5, 40.0))
        if rng.random() < 0.2:
            out.append((doc, page, k, y, 1, None, None, None, k))
        else:
            text = rng.choice(("Chapter 1", "Chapter 2", "words that go on", "words", "  ", "x" * 70, "» »"))
            out.append((doc, page, k, y, 0, text, rng.choice((15.0, 15.0, 12.0, 17.0)), rng.choice((0.126, 0.155, 0.62)), None))
    return out


def test_ranges_are_as_whole_documents(spark):
    """Chapters, kinds, blocks, metrics and covers by ranges of one or three pages are those of windows over documents."""
    rng = random.Random(10)
    rows = [r for doc, n in enumerate((400, 150, 1, 2, 60)) for r in book(rng, doc, n)]
    images = spark.createDataFrame([(r[0], r[8], f"i{r[8]}.png", "image/png", rng.randint(200, 900), rng.randint(300, 1400)) for r in rows if r[4]], "doc_id long, image_idx int, filename string, mime string, width int, height int")
    docs, events = spark.range(6).toDF("doc_id"), spark.createDataFrame(rows, EVENTS)
    whole = L.profile(docs, events, images)
    metrics = ["doc_id", "baseline_font", "left_margin", "line_gap", "baseline"]
    assert sorted(rank_metrics(docs, events).select(*metrics).collect()) == sorted(whole.select(*metrics).collect())
    covers = C.select_covers(whole).select("doc_id", "consumed_image").where("consumed_image is not null")
    assert sorted(C.consumed_images(events, images).collect()) == sorted(covers.collect()) != []

    known = C.with_cover(whole).withColumn("consumed_image", F.col("cover.consumed_image")).select(*metrics, "consumed_image").persist()
    marked = L.classified(L.chapter_events(known.join(L.ordered(events), "doc_id")))
    columns = ["doc_id", "event_seq", "chapter_id", "is_heading", "live", "kind", "indented", "gapped", "after_image"]
    blocks = sorted(map(tuple, L.blocks(marked).collect()), key=repr)
    for pages in (1, 3):
        kinds = range_kinds(events, known, pages)
        assert sorted(map(tuple, kinds.select(*columns).collect()), key=repr) == sorted(map(tuple, marked.select(*columns).collect()), key=repr)
        assert sorted(map(tuple, range_blocks(kinds).collect()), key=repr) == blocks
    plan = range_blocks(range_kinds(events, known, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(doc_id" in plan  # each window has the range beside it
    assert all(", range" in w for w in re.findall(r"windowspecdefinition\(doc_id#\d+L?([^)]{0,12})", plan))


def test_ranges_read_texts_once(spark, monkeypatch):
    """What texts tell is written with the events, and no later table or plan searches texts; states and sums read none."""
    rng = random.Random(5)
    plans, cut = {}, Scratch.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "cut", lambda self, df, label: (plans.__setitem__(label, plan(df)), cut(self, df, label))[1])
    events = spark.createDataFrame(book(rng, 1, 60), EVENTS)
    known = spark.createDataFrame([(1, 15.0, 0.126, 19.5, 15.0, None)], "doc_id long, baseline_font double, left_margin double, line_gap double, baseline double, consumed_image int")
    found = range_blocks(range_kinds(events, known, 1))
    assert [label for label, p in plans.items() if "text#" in p] == ["events"] and {"states", "sums"} <= set(plans)
    assert not re.search("(?i)regexp|rlike", plan(found)) and found.count() > 10
