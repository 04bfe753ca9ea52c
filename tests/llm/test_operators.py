"""Corpus operators against brute force, exact round trips, and odd tables: nulls, empty and repeated rows, extra columns."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from quire.llm import jaccard_join, line_block, metric_join, pareto_mix
from quire.llm import substring_dedup as substring_module
from quire.llm.fixity import fixity_audit
from quire.llm.jaccard_join import jaccard_classes, jaccard_dedup
from quire.llm.line_block import extract_main_text, main_text
from quire.llm.metric_join import near_vectors
from quire.llm.packing import pack_documents, plan_sequences
from quire.llm.pareto_mix import mix_digest, mixed_documents
from quire.llm.ppm_language import ContextTrees, identify_language, learn
from quire.llm.queries import damaged_replica
from quire.llm.substring_dedup import SuffixAutomaton, substring_dedup, substring_dedup_digest
from quire.llm.tiff import lzw_decode, lzw_encode, packbits_decode, packbits_encode, read_pages, text_media, text_tiff, tiff_pages, write_tiff
from quire.llm.toxicity_pu import score_toxicity, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, anchors string"
ODD = [(1, None, None, None, None, "x"), (None, "a b", "en", None, 3, None), (2, "", "en", "s", 0, "x"), (3, "a b c", None, "s", 5, "x"), (3, "a b c", None, "s", 5, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, key = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((6, 60, 200)))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((key, rng.choice((" ", "\n", "\t ")).join(own)))
            key += rng.randint(1, 4)
    for k in range(80):
        n = rng.randint(0, 14)
        rows.append((key + k, " ".join(words[:n]) if k % 2 else " ".join(words[1:n])))
    rng.shuffle(rows)
    return rows


def test_automaton():
    rng = random.Random(1)
    for _ in range(50):
        ref, doc = ([rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(2))
        held = {tuple(ref[i : i + 4]) for i in range(len(ref) - 3)}
        want = {i + j for i in range(len(doc) - 3) if tuple(doc[i : i + 4]) in held for j in range(4)}
        assert {i for a, b in SuffixAutomaton(ref).matches(doc, 4) for i in range(a, b)} == want


def test_substring_dedup(spark, odd):
    rows = near_copies()
    first = {}
    for key, text in sorted(rows):
        words = WORD.findall(text)
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), key)
    want = []
    for key, text in rows:
        words = WORD.findall(text)
        gone = {i + j for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < key for j in range(50)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substring_dedup_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(r["n_words"] for r in substring_dedup_digest(odd).collect()) == [0, 0, 2, 3, 3]
    assert substring_dedup(odd).columns == odd.columns and substring_dedup_digest(odd.limit(0)).count() == 0


def test_substrings_of_long_references(spark, monkeypatch):
    """Matches that cross the shards of a long reference, in several pieces of a long document; columns of any names."""
    monkeypatch.setattr(substring_module, "SHARD_WORDS", 70)
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1, words), (2, new(30) + words[100:900] + new(10) + words[40:89] + new(3) + words[850:1000]), (5, words[2990:] + words[:2000]), (4, words[1500:1560])]
    df = spark.createDataFrame([(k, " ".join(w), k, "x") for k, w in rows], "doc_id long, text string, _kept long, changed_id string")
    first = {}
    for key, w in sorted(rows):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), key)
    want = {}
    for key, w in rows:
        gone = {i + j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < key for j in range(50)}
        want[key] = [x for i, x in enumerate(w) if i not in gone]
    assert {r["doc_id"]: r["text"].split() for r in substring_dedup(df).collect()} == want
    assert substring_dedup(df).columns == df.columns


def test_bytes_sent_of_long_texts(spark, monkeypatch):
    """Near copies of 40,000 words, 20 shards: what is sent is about both texts, not both once for every shard."""
    monkeypatch.setattr(substring_module, "SHARD_WORDS", 2000)
    sent, routed = [], substring_module.routed

    def counted(shards, routes):
        out = routed(shards, routes)
        sent.extend(out.selectExpr("sum(octet_length(text))", "count(*)").first())
        return out

    monkeypatch.setattr(substring_module, "routed", counted)
    words = [f"word{k}" for k in range(40_000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:7000], "new", *words[7000:]])}
    found = substring_dedup_digest(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {1: 0, 2: 40_000}
    assert {r["doc_id"]: r["kept_sha256"] for r in found}[2] == hashlib.sha256(b"new").hexdigest()
    # 20 shards of the reference; those of the other, of which all but the first few cross a border of the reference's
    size = sum(len(t) for t in texts.values())
    assert size < sent[0] < 2 * size and sent[1] <= 20 + 2 * 21


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(substring_module, "BLOCK_BYTES", 50)
    raw = ("é a\tbb  ccc\n" * 40 + "x" * 300 + " end ").encode()
    assert sum(substring_module.word_pieces(raw), []) == raw.split()
    assert substring_module.words_digest(raw) == hashlib.sha256(b" ".join(raw.split())).digest() and substring_module.words_digest(b" ") == hashlib.sha256(b"").digest()


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(spark, odd, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rows = near_copies(block)
    sets = {}
    for key, text in rows:
        w = WORD.findall(text)
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    component = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(df).collect())) == sorted((k, len(s), component[k]) for k, s in sets.items())
    if block == 512:
        assert sorted(r["doc_id"] for r in jaccard_dedup(df).collect()) == sorted(k for k in sets if component[k] == k)
        assert sorted((r["n_shingles"], r["component_id"] or -1) for r in jaccard_classes(odd).collect()) == [(0, 1), (0, 2), (1, -1), (1, 3), (1, 3)]
        assert jaccard_classes(odd.limit(0)).count() == 0


def test_tiff(spark, odd):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (37, 50, 3)).astype(np.uint8), np.zeros((70, 33), np.uint8), rng.integers(0, 256, (100, 120)).astype(np.uint8)]
    for compression in (1, 5, 8, 32773):
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                for order in "<>":
                    back = [p for _, p in read_pages(write_tiff(pages, compression, predictor, 16, tile, order))]
                    assert all((a.reshape(b.shape) == b).all() for a, b in zip(pages, back, strict=True))
    huge = bytearray(write_tiff(pages[1:]))
    at = huge.index(struct.pack("<HHII", 256, 4, 1, 33)) + 8
    huge[at : at + 4], huge[at + 12 : at + 16] = struct.pack("<I", 4_000_000_000), struct.pack("<I", 2_000_000_000)
    files = spark.createDataFrame([(1, write_tiff(pages)), (2, b"II*\0junk"), (3, None), (4, bytes(huge)), (1, b"")], "id long, file binary")
    got = sorted((r["file_id"], r["page"], r["error"] is None) for r in tiff_pages(files, "id", "file").collect())
    assert got == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False), (4, 0, False), (4, 1, True)]
    assert tiff_pages(files.limit(0), "id", "file").count() == 0 and text_media(odd.limit(0)).count() == 0
    long = "long é " * 400_000  # several pages
    (r,) = text_media(spark.createDataFrame([(9, long)], "doc_id long, text string")).collect()
    raw, file = long.encode(), text_tiff(long.encode())
    padded = raw + b"\xff" * (-len(raw) % 576)
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["pages"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), -(-len(padded) // (576 * 4096)))
    assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert r["feature"] == f"pages={r['pages']};rows={len(padded) // 576};mean={sum(padded) / len(padded):.6f};high={sum(b >= 128 for b in padded) / len(padded):.6f}"
    for r, text in zip(text_media(odd).collect(), [x[1] for x in ODD]):
        raw = (text or "").encode()
        padded = raw.ljust(576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), 576, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_tiff_codecs():
    """The worked example of each published format, and round trips across code widths and table resets."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert packbits_encode(plain) == packed and packbits_decode(packed, len(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(format(c, "09b") for c in codes)
    stored = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stored and lzw_decode(stored, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 127, 128, 129, 254, 255, 510, 766, 1790, 3838, 3839, 3840, 9000, 40000):
        for data in (rng.bytes(size), bytes(size), rng.integers(0, 2, size).astype(np.uint8).tobytes()):
            assert lzw_decode(lzw_encode(data), size) == data and packbits_decode(packbits_encode(data), size) == data


def test_tiff_query_kinds(spark):
    """Equal texts are stored alike, and a corpus has all compressions, in strips and in tiles; clashing columns are not read."""
    texts = [f"text {k} é " * (k % 7 * 300) for k in range(60)]
    df = spark.createDataFrame([(k, t, "x", -1) for k, t in enumerate(texts + texts)], "doc_id long, text string, compression string, n_bytes int")
    got = {r["doc_id"]: r for r in text_media(df).collect()}
    for k, text in enumerate(texts):
        padded = text.encode() + b"\xff" * (max(576, -(-len(text.encode()) // 576) * 576) - len(text.encode()))
        assert got[k]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got[k][1:] == got[k + 60][1:]
        assert not got[k]["tiled"] or len(padded) >= 16 * 576
    assert {(r["compression"], r["tiled"]) for r in got.values()} == {(c, t) for c in ("deflate", "lzw", "packbits") for t in (False, True)}


@pytest.mark.parametrize(("bits", "planes"), [(1, 1), (2, 1), (4, 2), (16, 1), (16, 3)])
def test_tiff_depths(bits, planes):
    """Pages of other depths and of planes, with strips put together by hand."""
    rng = np.random.default_rng(bits)
    want = rng.integers(0, 1 << bits, (5, 7, planes)).astype(np.uint16)
    strips = []
    for p in range(planes):
        text = [format(int(v), f"0{bits}b") for v in want[:, :, p].ravel()]
        lines = ["".join(text[k : k + 7]) for k in range(0, 35, 7)]
        strips.append(b"".join(int(x.ljust(-len(x) % 8 + len(x), "0"), 2).to_bytes((len(x) + 7) // 8, "big") for x in lines))
    data = b"MM\0*" + struct.pack(">I", 8 + sum(map(len, strips)))
    offsets = [8 + sum(map(len, strips[:p])) for p in range(planes)]
    entry = lambda tag, kind, values, at: struct.pack(">HHI", tag, kind, len(values)) + (struct.pack(">I", at) if len(values) > 1 else struct.pack(">H2x" if kind == 3 else ">I", values[0]))
    start = len(data) + sum(map(len, strips)) + 2 + 12 * 9 + 4
    fields = [(256, 3, [7]), (257, 3, [5]), (258, 4, [bits] * planes), (259, 3, [1]), (273, 4, offsets), (277, 3, [planes]), (278, 3, [5]), (279, 4, [len(x) for x in strips]), (284, 3, [2 if planes > 1 else 1])]
    tail, out = b"", struct.pack(">H", 9)
    for tag, kind, values in fields:
        out += entry(tag, kind, values, start + len(tail))
        tail += struct.pack(f">{len(values)}I", *values) if len(values) > 1 else b""
    ((_, got),) = read_pages(data + b"".join(strips) + out + bytes(4) + tail)
    assert (got == want).all()


def test_toxicity(spark, odd):
    rng = np.random.default_rng(2)
    make = lambda toxic: np.unique(np.concatenate([rng.integers(100, 400, 40), rng.integers(0, 5, 2) if toxic else []]).astype(np.int64))
    model = train([make(True) for _ in range(200)], [make(rng.random() < 0.1) for _ in range(2000)], 0.1)
    margins = [np.array([model.bias + model.weights[r].sum() for r in (make(toxic) for _ in range(300))]) for toxic in (True, False)]
    assert (margins[0][:, None] > margins[1][None, :]).mean() > 0.9 and (margins[1] >= 0).mean() < 0.05
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(odd, model).collect()) and score_toxicity(odd, None).count() == 5


def test_toxicity_of_few_positives():
    """With six positives, words that three of them hold have a weight."""
    rng = np.random.default_rng(6)
    make = lambda *own: np.unique(np.concatenate([rng.integers(100, 400, 40), own]).astype(np.int64))
    model = train([make(1 + k % 2) for k in range(6)], [make() for _ in range(400)], 0.1)
    assert model.weights[1] > 0 and model.weights[2] > 0


@pytest.mark.parametrize("cell", [1 << 20, 80])
def test_metric_join(spark, cell, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL_VALUES", cell)
    if cell == 80:  # many cells, and labels that have none
        monkeypatch.setattr(metric_join, "PIVOTED", 1)
        monkeypatch.setattr(metric_join, "chosen_pivots", lambda sample, *_: metric_join.farthest_first(sample, 9))
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(160):
        v = centres[k % 6] + rng.normal(size=8) * rng.choice((0.0, 0.05, 0.15, 0.4))
        rows.append((k, [float(x) for x in v], int(k % 6 % 2)))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, rows[0][1], None), (904, rows[0][1], 0)]
    good = [(k, np.array(v), x) for k, v, x in rows if v is not None and x is not None and np.isfinite(v).all() and np.any(v)]
    near = {k: {j for j, w, y in good if j != k and y == x and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for k, v, x in good}
    component = {k: k for k, _, _ in rows}
    for _ in range(len(rows)):
        component = {k: min([component[k], *(component[j] for j in near.get(k, ()))]) for k in component}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = near_vectors(df)
    assert sorted(map(tuple, found.collect())) == sorted((k, len(near.get(k, ())), component[k], component[k] == k) for k in component)
    assert near_vectors(df.limit(0)).count() == 0


def test_metric_join_of_odd_rows(spark):
    """Null vec_ids, rows that repeat, vectors of other lengths, string labels and columns of other names."""
    rows = [(None, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (4, [2.0, 0.0], "a"), (5, [1.0, 0.0, 0.0], "a"), (6, [1.0, 0.0], None), (7, [1.0, None], "a"), (8, [-1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string").selectExpr("*", "1 as first", "2 as component", "3 as h1")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()), key=str)
    assert got == [(0, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]


def test_replication_reaches_every_neighbour():
    """Each pair within the radius meets in the cell with the smaller number."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = metric_join.unit(centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6)) * rng.choice([0.01, 0.1, 1.0], (600, 1)))
    radius = float(np.arccos(0.98))
    for k in (2, 5, 16):
        home, reach = metric_join.placed_in(vectors, metric_join.farthest_first(vectors, k), radius)
        for i, j in zip(*np.nonzero(vectors @ vectors.T >= 0.98)):
            assert home[i] == home[j] or reach[i, home[j]] or reach[j, home[i]]


def test_language(spark, odd):
    rng = random.Random(5)
    word = lambda kinds: "".join(rng.choice(kinds) for _ in range(rng.randint(1, 4)))
    kinds = {"xx": ["th", "er", "on", "and"], "yy": ["ción", "ue", "ll", "os"]}
    rows = [(k, " ".join(word(kinds[x]) for _ in range(rng.randint(1, 60))), x, "s", 0, "") for k, x in enumerate(["xx", "yy"] * 120)]
    df = spark.createDataFrame(rows, DOCS)
    trees = learn(df)
    found = {r["doc_id"]: r["lang_pred"] for r in identify_language(df, trees).collect()}
    assert sum(found[k] == x for k, _, x, *_ in rows) > 0.97 * len(rows)
    assert sorted(r["lang_pred"] == "und" for r in identify_language(odd, trees).collect()) == [False, False, False, True, True]
    assert identify_language(odd, None).count() == 5
    # Costs of all bytes after one context are those of a probability distribution (but for escapes to seen bytes).
    tree = ContextTrees({"a": [b"abracadabra"]}, 2)
    assert tree.lengths(np.frombuffer(b"abra", np.uint8), np.array([0, 4]))[0, 0] < tree.lengths(np.frombuffer(b"zqxj", np.uint8), np.array([0, 4]))[0, 0]


def plain_ppm(learned, text, order):
    """The code length of a text, byte by byte, from counts in dictionaries."""
    counts = {}
    for t in learned:
        t = bytes([10]) * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1
    bits, t = 0.0, bytes([10]) * order + text
    for i in range(order, len(t)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
            elif own := counts.get(t[i - k : i]):
                total = sum(own.values()) + len(own)
                if t[i] in own:
                    bits -= np.log2(own[t[i]] / total)
                    break
                bits -= np.log2(len(own) / total)
    return bits


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_against_plain_ppm(order):
    rng = random.Random(order)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).encode()
    learned = {f"l{j}": [make(letters) for _ in range(12)] for j, letters in enumerate(("abc ", "bcde é", "xyz", "aaab", "жука ", "c"))}
    texts = [make("abcdexyzé жу!") for _ in range(40)] + [b"", b"\n\n\n\n", bytes(range(256)), b"abc" * 4000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = ContextTrees(learned, order).lengths(data, offsets)
    want = np.array([[plain_ppm(learned[x], t, order) for x in sorted(learned)] for t in texts])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_language_of_odd_tables(spark, odd):
    """Ties go to the first name; result names may be chosen where columns have them; one document repeated is learned once."""
    rows = [(k, "abab", x, None, 0, "") for k, x in enumerate(["b", "a"] * 20)] + [(1000, "abab " * 50, "b", None, 0, "")] * 300
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("anchors", "score")
    trees = learn(df.where("doc_id < 1000"))
    tied = ContextTrees({"b": [b"abab"], "a": [b"abab"]})
    assert {(r["lang_pred"], r["score"]) for r in identify_language(df, tied).collect()} == {("a", 0.5)}
    assert learn(df).languages == ["a", "b"] and learn(df.limit(0)) is None and learn(odd.where("lang is null")) is None
    named = identify_language(df, trees, keep=df.columns, names=("p", "q", "r"))
    assert named.columns == [*df.columns, "p", "q", "r"] and named.count() == 340
    assert identify_language(df.limit(0), trees).count() == 0


def test_language_of_long_texts_only(spark, monkeypatch):
    """A language whose labelled texts are all long is learned, also where one text has more than is learned from."""
    rows = [(k, "the cat and the dog " * 30, "en", "s", 0, "") for k in range(20)] + [(100 + k, "žluťoučký kůň úpěl " * (1200 + k), "cs", "s", 0, "") for k in range(8)]
    df = spark.createDataFrame(rows, DOCS)
    for most in (2_000_000, 5_000):
        monkeypatch.setattr("quire.llm.ppm_language.LEARN_SUM", most)
        trees = learn(df)
        assert trees.languages == ["cs", "en"]
        assert all(r["lang"] == r["lang_pred"] for r in identify_language(df, trees, keep=["lang"]).collect())


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; title</h1><p>One <b>two<br>three<p>Short.<div class="comments"><p>I think so</p></div><!-- x --></article><footer>&copy; me</footer>"""
    assert main_text(page) == "Head & title\n\nOne two three\n\nShort."
    plain = f"<body><div id=header>Site</div><div><p>{'long text ' * 30}</p><p>Tail.</p></div><form><p>Mail</p></form></body>"
    assert main_text(plain) == ("long text " * 30).strip() + "\n\nTail."
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""


def test_main_text_without_article_element():
    """Short blocks stay where they open, close or make up a page."""
    block = lambda n: f"<p>{'x' * n}</p>"
    gap = "<ul class=menu>" + "<li>Go</li>" * 3 + "</ul>"
    for parts in ([20, 15, 22, 18, 300], [300, 250, gap, 40], [*[25] * 30, gap, 120], [9, gap, 200, 7, gap, 8, gap, 150], [3]):
        page = "<body><div>" + "".join(p if p == gap else block(p) for p in parts) + "</div></body>"
        assert [len(t) for t in main_text(page).split("\n\n")] == [p for p in parts if p != gap]


def test_main_text_outside_article_element():
    """A short article element takes nothing from longer text outside; beside a long one, long text outside stays as well."""
    block = lambda n: f"<p>{'x' * n}</p>"
    sizes = lambda page: [len(t) for t in main_text(f"<body>{page}</body>").split("\n\n")]
    outside = "<div>" + "".join(map(block, (20, 300, 8, 400))) + "</div>"
    assert sizes(outside + f"<article>{block(50)}</article>") == [20, 300, 8, 400, 50]
    assert sizes("<div>" + block(25) * 30 + f"</div><article>{block(60)}</article>") == [25] * 30 + [60]
    assert sizes(f"<article>{block(900)}{block(5)}</article>" + outside) == [900, 5, 20, 300, 8, 400]
    assert sizes(f"<p>Site</p><article>{block(900)}{block(5)}</article><p>Tags</p>") == [900, 5]


def test_main_text_keeps_what_is_no_clutter():
    """Within an article, class words drop menus, adverts, forms and comments only; all visible text stays."""
    page = """<article><h2 class="section-header">Heading</h2><p class="discussion">One</p><div class="legal side">Two</div><math><mi>E</mi> = <mi>m</mi> c</math>
    <object><p>Three</p></object><noscript>Four</noscript><xmp>a <b> &amp; c</xmp><p>Five <span class="ad">buy</span> six<label>x</label>.</p><ul class="menu"><li>Go</ul>
    <div class="comments">Me too</div><form>Mail</form><div class=ad>Buy</div><textarea>t</textarea><p hidden>no</p><p>Seven &lt;b&gt; &#233;</article>"""
    assert main_text(page).split("\n\n") == ["Heading", "One", "Two", "E = m c", "Three", "Four", "a <b> &amp; c", "Five six.", "Seven <b> é"]
    assert main_text("<p>a <b <p>b</p> c") == "a b\n\nc" and main_text("x <a href='y>z</a> w") == "x z w" and main_text("1 < 2 <!-- z") == "1 < 2"


def test_main_text_drops_short_text_apart():
    """Where neither element nor name says so: short lines beyond rows of boxes go, long ones stay."""
    gap = "<nav>a</nav><div class=ad>b</div><form>c</form>"
    assert main_text(f"<p>Site</p>{gap}<p>{'x' * 500}</p><p>y</p>{gap}<p>Up</p>{gap}<p>{'z' * 90}</p>") == f"{'x' * 500}\n\ny\n\n{'z' * 90}"
    assert main_text(f"<p>Site</p><article><p>{'x' * 500}</p><p>y</p></article><p>Tags</p>") == f"{'x' * 500}\n\ny"


def test_distribution_against_windows_line_by_line():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 25)
        sizes = np.array([rng.choice((0, 0, 3, 9, 40, 200)) for _ in range(n)])
        inside = np.array([rng.random() < 0.5 if n % 2 else 5 <= k < 15 for k in range(n)])
        if not sizes.any():
            continue
        mine = int(sizes[inside].sum())
        known = mine > 0 and 2 * mine >= sizes.sum()
        group = [0 if known and i else int(s) for s, i in zip(sizes, inside)]
        window = lambda k: sum(group[k : k + 3])
        filled = [window(k) for k in range(n) if window(k)]
        stretches, texts = [], {}  # between places whose window is empty
        for k in range(n):
            stretches.append((stretches[-1] if stretches else 0) + (window(k) == 0))
            texts[stretches[k]] = texts.get(stretches[k], 0) + group[k]
        main = max(texts, key=lambda t: (texts[t], -t))
        want = {k for k in range(n) if inside[k] and sizes[k]}
        for least, only in ((86, None), *([] if known else [(min(86, sum(filled) / len(filled) / 4), main)])):
            for k in range(n):
                if not group[k] or only is not None and stretches[k] != only:
                    continue
                up = k  # back over lines with text, or over what no window finds empty, to a surge
                while window(up) < least and up + 1 < n and group[up + 1]:
                    up += 1
                back = next((j for j in range(k, -1, -1) if not window(j) or group[j] and window(j) >= least), None)
                if window(up) >= least or back is not None and group[back] and window(back) >= least and all(window(j) for j in range(back, k + 1)):
                    want.add(k)
        assert set(np.flatnonzero(line_block.chosen_lines(sizes, inside))) == want


ARTICLE = "<h1>Title</h1><p>" + "word " * 60 + "</p><p>Yes.</p>"
TITLED = "Title\n\n" + ("word " * 60).strip() + "\n\nYes."


def test_articles_in_wrappers_stay():
    """Names that only hold a word of the list, and named elements, forms and roles around an article, are no clutter."""
    for wrapper in (
        '<div class="has-sidebar">', '<div class="content no-sidebar">', '<div class="header-fixed">', '<div class="layout with-nav">', '<div id="search-results">', '<section class="legal">',
        '<form id="aspnetForm">', '<div role="search">', '<div class="notice"><div class="modal">',
    ):
        ends = "".join(f"</{name}>" for name in reversed(re.findall(r"<(\w+)", wrapper)))
        assert main_text(f"<nav>Go</nav>{wrapper}<article>{ARTICLE}</article>{ends}<footer>me</footer>") == TITLED
        assert main_text(f"{wrapper}<article>{ARTICLE}</article><div class='comments'>No</div>{ends}") == TITLED
    for name in ("side-by-side", "entry share", "discussion", "social-history", "legal"):  # no article element
        assert main_text(f'<div class="{name}">{ARTICLE}</div>') == main_text(f'<h1>Title</h1><div class="{name}">{ARTICLE[14:]}</div>') == TITLED
    assert main_text(f"<aside><article>{ARTICLE}</article></aside>") == ""  # clutter by itself is so in any case
    gap = "<nav>a</nav><div class=ad>b</div><form>c</form>"
    assert main_text(f"<article><p>{'x' * 300}</p>{gap}<p>Yes.</p>{gap}<p>{'y' * 300}</p></article>").split("\n\n")[1] == "Yes."


def test_the_distribution_tells_unmarked_menus_and_footers():
    """Pages of nothing but divs: menus, an advert and a footer go by their lengths, in every order of lengths of blocks."""
    rng = random.Random(13)
    for _ in range(50):
        text = [rng.choice((120, 300, 40, 8)) for _ in range(rng.randint(2, 9))] + [200]
        menu = "<div><ul>" + "<li><a>Link</a></li>" * rng.randint(2, 8) + "</ul></div>"
        page = f"<body>{menu}<div>Buy this thing now</div><div><h1>Head</h1>{''.join(f'<p>{"x" * n}</p>' for n in text)}</div><div>(c) me</div></body>"
        assert [len(t) for t in main_text(page).split("\n\n")] == [4, *text]


@pytest.mark.parametrize("page", ["<a " * 60_000, "<b>" * 60_000 + "</i>" * 60_000, '<a ">" ' * 40_000, "<head>" * 40_000, "<textarea>" * 40_000, "<p " + "x" * 200_000 + ">y", "<div>" * 50_000])
def test_main_text_takes_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 3


def test_extracted_pages(spark):
    long = "<article>" + "".join(f"<p>{'word ' * 200}{k}</p>" for k in range(3000)) + "</article>"
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", long, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()), key=str)
    want = "\n\n".join("word " * 200 + str(k) for k in range(3000))
    assert got == [(0, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "v", "", 0), (3, "w", want, len(want))]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_mix(spark, odd):
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randint(1, 120)), None, ("a", "b", "c", None)[k % 4], 0, "") for k in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in mix_digest(df).collect()}
    assert found == {r["doc_id"]: r for r in mix_digest(df.repartition(7)).collect()}
    for source in ("a", "b", "c", None):
        own = [found[k] for k, _, _, s, *_ in rows if s == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60 and all(r["taken"] <= 2 * r["size"] for r in own)
    copies = mixed_documents(df)
    assert copies.columns == df.columns and copies.count() == sum(r["taken"] // max(r["size"], 1) for r in found.values())
    assert mix_digest(odd).count() == 5 and mix_digest(odd.limit(0)).count() == 0 and mixed_documents(odd.limit(0)).count() == 0


def test_mix_probabilities(spark):
    """Over many seeds: documents of one source are taken as often as their own expected copies, longer ones more often."""
    sizes = [1, 3, 10, 40, 160, 640] * 6
    df = spark.createDataFrame([(k, " ".join("w" * n), "ab"[k % 6 > 2]) for k, n in enumerate(sizes)], "doc_id long, text string, source string").cache()
    runs, got = 8, {}
    for seed in range(runs):
        for r in mix_digest(df, seed=seed).collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["taken"] / max(r["size"], 1)
    from quire.llm.pareto_mix import class_rates

    narrow = spark.createDataFrame([("ab"[k % 6 > 2], int(2 * np.log2(n + 1)), n) for k, n in enumerate(sizes)], "source string, class int, size long")
    rate = {(r["source"], r["class"]): r["rate"] for r in class_rates(narrow, (3, 1, 2), 1.5, 2.0, 0.25).collect()}
    for k in range(6):  # six documents of each length
        mean = sum(got[j] for j in range(k, 36, 6)) / (6 * runs)
        assert abs(mean - rate["ab"[k > 2], int(2 * np.log2(sizes[k] + 1))]) < 0.25
    assert len({round(x, 6) for (s, _), x in rate.items() if s == "b"}) > 1


def test_mix_with_one_id_for_half_a_source(spark, monkeypatch):
    """Rows of one doc_id, and of null, are dealt one by one; columns of any names pass."""
    monkeypatch.setattr(pareto_mix, "GROUP", 40)
    rows = [(7 if k < 500 else None if k < 700 else k, f"{k} " + "w " * (k % 2 + 29), "ab"[k % 10 == 9], "x", k, True, "y") for k in range(1000)]
    schema = "doc_id int, text string, source string, target string, mix_size long, cut boolean, last string"
    df = spark.createDataFrame(rows, schema)
    found = mix_digest(df).collect()
    assert len(found) == 1000
    for target in {r["target"] for r in found}:
        assert abs(sum(r["taken"] for r in found if r["target"] == target) - target) <= 16
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    got, own = {}, {r[4]: r for r in rows}
    for r in mixed.collect():
        assert tuple(r) == own[r["mix_size"]]
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert sum(got.values()) == sum(r["taken"] for r in found)


def test_packing(spark, odd):
    rng = random.Random(7)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        plan = plan_sequences(counts, 100)
        got = {}
        for pattern, times in plan:
            assert sum(pattern) <= 100 and times > 0
            for n in pattern:
                got[n] = got.get(n, 0) + times
        assert got == counts
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello, it's a test\x1fof <|endoftext|> marks", "x " * 5000, "ção İx y", "", None]
    rows = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)]
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) <= 2048
    assert pack_documents(odd, path).count() == 5 and pack_documents(odd.limit(0), path).count() == 0


def test_fixity(spark):
    rows = [(k, f"http://x/{k}", "<p>é" * (k % 7)) for k in range(-70, 300)] + [(None, "u", "h")]
    damaged = [(k, u, h + "!" if k in (5, 170) else h) for k, u, h in rows if k != 299] + [(900, "new", None)]
    schema = "page_id long, url string, html string"
    one, other = spark.createDataFrame(rows, schema), spark.createDataFrame(damaged, schema)
    assert sorted(r["page_id"] for r in fixity_audit(one, other, 64, 4).collect()) == [5, 170, 299, 900]
    assert fixity_audit(one, one, 64, 4).count() == 0 and fixity_audit(one.limit(0), one.limit(0)).count() == 0
    assert fixity_audit(one, one.limit(0), 64, 4).count() == 371


def test_fixity_of_one_loss(spark):
    """A record lost in the middle of a file is one row, also among records of one page_id and without one."""
    rows = [(k, "u", "x" * k) for k in range(256)] + [(9, "u", f"again {k}") for k in range(300)] + [(9, "u", "same")] * 50 + [(None, "u", f"null {k}") for k in range(90)]
    schema = "page_id long, url string, html string"
    gone = [rows[5], rows[300], rows[560], rows[-40]]
    left = list(rows)
    for r in gone:
        left.remove(r)
    found = fixity_audit(spark.createDataFrame(rows, schema), spark.createDataFrame(left, schema), 256).collect()
    assert sorted((r["page_id"] or -1, r["copies"], r["other_digest"]) for r in found) == [(-1, 1, None), (5, 1, None), (9, 1, None), (9, 1, None)]
    record = lambda h: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n".encode()
    assert {r["digest"] for r in found} == {hashlib.sha256(record(r[2])).hexdigest() for r in gone}
    own = sorted((k, hashlib.sha256(record(h)).hexdigest(), len(record(h))) for k, _, h in rows if k is not None)
    for r in found:
        if r["page_id"] is not None:
            assert r["offset"] == sum(n for k, x, n in own if (k, x) < (r["page_id"], r["digest"]))


def test_fixity_damages_pages_without_html(spark):
    pages = spark.createDataFrame([(12, "u", None), (13, "u", None), (110, "u", "h")], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in fixity_audit(pages, damaged_replica(pages), 64, 4).collect()) == [13, 110]
