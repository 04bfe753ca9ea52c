"""Importance resampling, exact top-k search and the point-in-time join against plain statements, on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import exact_topk, point_in_time
from quire.llm.exact_topk import top_k
from quire.llm.importance import bucket_gains, crc32_of, feature_counts, importance_digest, importance_ranks, importance_sample
from quire.llm.point_in_time import labelled_features, latest_usable, upper_envelope

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def drawn(docs, target):
    """(doc_id, n_features, weight, score, rank) of each document, by plain counting and one sort."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    rows = []
    for k, text in docs:
        words, own = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([k, len(own), weight, score, None, len(words)])
    open_ = sorted((r for r in rows if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(open_[: 25 * len(open_) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_spans_have_the_known_checksum():
    rng = random.Random(4)
    data = np.array([rng.randrange(256) for _ in range(3000)], np.uint8)
    starts = np.array(sorted(rng.randrange(2800) for _ in range(300)))
    ends = np.minimum(starts + [rng.choice((0, 1, 5, 47, 48, 49, 50, 200)) for _ in starts], 3000)
    plain = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert crc32_of(data, starts, ends).tolist() == plain
    assert crc32_of(data, starts[1:], ends[1:], np.array(plain[:-1], np.uint32)).tolist() == [zlib.crc32(data[a:b].tobytes(), p) for a, b, p in zip(starts[1:], ends[1:], plain)]
    assert crc32_of(data, starts[:0], ends[:0]).tolist() == []


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["Alpha", "beta", "é1", "x" * 60, "Ωmega", "the", "of", "a", "_", "{b}", "z9"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.choice((0, 3, 19, 20, 21, 60)))) for k in range(200)]
    docs += [(5, text(40)), (5, text(40)), docs[7], docs[7], (None, text(30)), (None, None), (1000, None), (1001, ""), (1002, "\x00 -- \x7f"), (1003, text(60_000))]
    return docs, [text(30) for _ in range(10)] + [None, ""]


def test_importance_against_a_plain_sort(spark, corpus):
    docs, target = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    expected = by_repr(drawn(docs, target))
    assert by_repr(importance_digest(df, aim).collect()) == expected
    # Columns of the operator's own names pass by; a sample has the columns of the table.
    odd = df.selectExpr("*", "'a' as sample_rank", "1 as Sample_score", "doc_id as rank")
    ranked, names = importance_ranks(odd, aim)
    kept = ranked.select("doc_id", *[names[k] for k in ("features", "weight", "score", "rank")], "sample_rank", "Sample_score")
    assert by_repr(r[:5] for r in kept.collect()) == expected and {r[5:] for r in kept.collect()} == {("a", 1)}
    sample = importance_sample(odd, aim)
    assert sample.columns == odd.columns
    assert sorted(r["doc_id"] for r in sample.collect()) == sorted(r[0] for r in expected if r[4])


def test_importance_of_empty_tables(spark, corpus):
    docs, target = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    df = spark.createDataFrame(docs, none.schema)
    assert importance_digest(none, df.select("text")).collect() == []
    assert by_repr(importance_digest(df, none.select("text")).collect()) == by_repr(drawn(docs, []))
    assert feature_counts(none).sum() == 0 and set(bucket_gains(np.zeros(4, np.int64), np.zeros(4, np.int64)).tolist()) == {0}
    short = df.where("doc_id < 0 or text = ''")
    assert {r["rank"] for r in importance_digest(short, df.select("text")).collect()} == {None}


def nearest(rows, k, modulus, scale):
    """Each distinct query against all rows, by one sort."""
    whole = []
    for v, e in rows:
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            whole.append((v, tuple(math.floor(scale * x) for x in e)))
    out = []
    for q, mine in {r for r in whole if r[0] % modulus == 0}:
        found = sorted((-sum(a * b for a, b in zip(mine, e)), v) for v, e in whole if v != q)[:k]
        out += [(q, i, v, -s) for i, (s, v) in enumerate(found, 1)]
    return by_repr(out)


@pytest.mark.parametrize("block, part, chunk", [(4096, 1 << 20, 8192), (3, 50, 16), (1, 7, 5)])
def test_top_k_against_one_sort(spark, monkeypatch, block, part, chunk):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(exact_topk, "PART_ROWS", part)
    monkeypatch.setattr(exact_topk, "CHUNK", chunk)
    rng = random.Random(block)
    vector = lambda: [float(np.float32(rng.choice((0.0, 0.0, 1.0, -1.0, rng.gauss(0, 1))))) for _ in range(6)]
    rows = [(k, vector()) for k in range(300)] + [(300, [1.0] * 6), (301, [1.0] * 6), (301, [1.0] * 6), (302, [2.0, 1.0]), (303, [0.5] * 9), (304, []), (305, [0.0] * 6)]
    rows += [(0, rows[0][1]), (10, vector()), (310, None), (320, [1.0, None]), (330, [1.0, float("nan")]), (340, [float("inf")]), (None, [1.0] * 6), (350, rows[299][1]), (-20, vector())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    assert by_repr(top_k(df, k=4, modulus=10, scale=16).collect()) == nearest(rows, 4, 10, 16)
    few = df.where("vec_id in (0, 1, 2, 10)")
    assert by_repr(top_k(few, k=10, modulus=10, scale=16).collect()) == nearest([r for r in rows if r[0] in (0, 1, 2, 10)], 10, 10, 16)
    assert top_k(df.where("false"), k=4).collect() == []


def test_components_beyond_a_long_score_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1e30]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert by_repr(top_k(df, k=3, modulus=2, scale=1).collect()) == [(0, 1, 2, 3), (2, 1, 0, 3)]


def test_envelopes_second_by_second():
    rng = random.Random(6)
    for _ in range(60):
        n, span = rng.randint(0, 30), rng.choice((4, 16, 50))
        key, lo = (np.array([rng.randrange(m) for _ in range(n)], np.int64) for m in (3, span))
        hi = np.array([rng.randint(a + 1, span) for a in lo], np.int64)
        rank = np.array(rng.sample(range(n), n), np.int64)
        found = list(zip(*upper_envelope(key, lo, hi, rank, span)))
        for k in range(3):
            for t in range(span):
                best = max((r for a, b, c, r in zip(key, lo, hi, rank) if a == k and b <= t < c), default=None)
                assert [r for a, b, c, r in found if a == k and b <= t < c] == ([] if best is None else [best])
        assert all(b < c for _, b, c, _ in found) and all(p[0] < q[0] or p[2] <= q[1] for p, q in zip(found, found[1:]))


def winner(versions, key, t):
    usable = [v for v in versions if None not in v[:5] and v[0] == key and v[1] <= t and v[2] <= t < v[3]]
    return max(usable, key=lambda v: (v[1], -v[2], v[4]), default=None)


@pytest.mark.parametrize("chunk, fan, salt, batch", [(256, 64, 1 << 20, 1 << 16), (7, 2, 5, 20), (50, 3, 40, 1)])
def test_latest_usable_against_all_versions(spark, monkeypatch, chunk, fan, salt, batch):
    monkeypatch.setattr(point_in_time, "_MERGE_ROWS", batch)
    monkeypatch.setattr(point_in_time, "_SEND_ROWS", 30 * batch)
    rng = random.Random(chunk)
    versions = []
    for k in range(600):
        event = rng.randrange(-100, 400)
        versions.append((rng.choice(("a", "a", "b", "é")), event, event - 20 + rng.randrange(60), event + rng.randrange(120), k, f"p{k}"))
    versions += [versions[0], versions[1], (None, 0, 0, 50, 900, "n"), ("a", None, 0, 50, 901, "n"), ("a", 0, None, 50, 902, "n"), ("a", 0, 0, None, 903, "n"), ("a", 0, 0, 400, None, "n"), ("a", 9, 9, 9, 904, None), ("b", 300, 300, 2000, 905, None)]
    asks = [(k, rng.choice(("a", "a", "a", "b", "é", "none", None)), rng.choice((None, *range(-120, 500))), rng.choice((1, 1, 3))) for k in range(400)]
    vdf = spark.createDataFrame(versions, "key string, event long, arrival long, expiry long, version_id long, p string").repartition(7)
    vdf = vdf.selectExpr("key", "event", "arrival", "expiry", "version_id", "struct(p, version_id as event) as payload", "1 as chunk")
    adf = spark.createDataFrame(asks, "ask long, key string, t long, copies long").selectExpr("*", "2 as salt")
    got = by_repr((r["ask"], r["t"], r["version_id"], r["event"], r["payload"] and r["payload"]["p"]) for r in latest_usable(vdf, adf, chunk, fan, salt).collect())
    plain = []
    for ask, key, t, copies in asks:
        v = winner(versions, key, t) if key is not None and t is not None else None
        plain += [(ask, t, v and v[4], v[1] if v else None, v and v[5])] * copies
    assert got == by_repr(plain)
    assert latest_usable(vdf, adf.where("false")).collect() == []
    assert {r["version_id"] for r in latest_usable(vdf.where("false"), adf).collect()} == {None}


def test_labels_of_documents(spark):
    part = lambda k, i: int(hashlib.sha256(str(k).encode()).hexdigest()[8 * i : 8 * i + 8], 16)
    docs = [(k, None if k % 50 == 3 else f"s{k % 3}", k, "en" if k % 4 else None) for k in range(3000)] + [(7, "s0", 7, "en"), (None, "s1", 1, "en")]
    labels = [(k,) for k in range(0, 3000, 3)] + [(6,)] * 3 + [(5000,), (None,)]
    versions = [(s, part(k, 0) % 20000, part(k, 0) % 20000 - 60 + part(k, 1) % 300, part(k, 0) % 20000 + part(k, 2) % 900, k, n, lang) for k, s, n, lang in docs if k is not None]
    sources = {k: s for k, s, *_ in reversed(docs) if k is not None}
    sources[7] = "s0"
    plain = []
    for (k,) in labels:
        t = None if k is None else part(k, 3) % 20000
        v = winner([x[:5] + (x,) for x in versions], sources[k], t) if sources.get(k) else None
        age = v and t - v[1]
        fresh = v and age <= 60
        plain.append((k, t, v and v[4], age, "none" if not v else "fresh" if fresh else "stale", v[5][5] if fresh else None, v[5][6] if fresh else None))
    df = spark.createDataFrame(docs, "doc_id long, source string, n_chars int, lang string")
    found = labelled_features(df, spark.createDataFrame(labels, "doc_id long"))
    assert found.columns == ["doc_id", "t", "version_id", "age", "status", "n_chars", "lang"]
    assert by_repr(found.collect()) == by_repr(plain)
    assert {r[4] for r in plain} == {"none", "fresh", "stale"}


def test_long_words_and_slices():
    """Sliced columns and words longer than those hashed together."""
    from quire.llm.importance import feature_buckets

    texts = ["skip", "x" * 5000 + " y " + "x" * 49, None, "q"]
    column = pa.array(texts).slice(1)
    rows = [(row, end, words.tolist(), owner.tolist(), found.tolist()) for row, end, words, owner, found in feature_buckets(column)]
    assert sum((w for _, _, w, _, _ in rows), []) == [3, 0, 1]
    assert sorted(b for *_, found in rows for b in found) == sorted(zlib.crc32(f.encode()) % 10_000 for t in texts[1:] for f in features(t)[1])
