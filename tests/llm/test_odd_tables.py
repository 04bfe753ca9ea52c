"""Nulls, empty tables, very long texts, repeated rows and columns with clashing names, for operators and pipeline stages; and op5 against a plain statement."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.fixity import fixity_audit
from quire.llm.jaccard_join import jaccard_classes, jaccard_dedup
from quire.llm.packing import Ids, Memory, pack_documents, plan_sequences
from quire.llm.pareto_mix import mix_digest
from quire.llm.ppm_language import ContextTrees, identify_language
from quire.llm.substring_dedup import substring_dedup_digest
from quire.llm.toxicity_pu import learn, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 120,000 words, most of it again in a later one, and short ones."""
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(40_000)}" for _ in range(120_000)]
    texts = {1: " ".join(words), 2: "new " + "\n".join(words[:110_000]), 3: " ".join(words[5_000:5_060]), 4: "é " * 3}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_long_texts(spark, long_docs):
    texts, df = long_docs
    found = {r["doc_id"]: r for r in substring_dedup_digest(df).collect()}
    assert {k: (r["n_words"], r["n_removed"]) for k, r in found.items()} == {1: (120_000, 0), 2: (110_001, 110_000), 3: (60, 60), 4: (3, 0)}
    assert found[2]["kept_sha256"] == hashlib.sha256(b"new").hexdigest()
    shingles = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, WORD.findall(t)) for k, t in texts.items())}
    assert sorted(map(tuple, jaccard_classes(df).collect())) == [(k, len(shingles[k]), 1 if k == 2 else k) for k in sorted(texts)]
    assert {r["doc_id"]: r["size"] for r in mix_digest(df.selectExpr("*", "'s' as source")).collect()} == {1: 120_000, 2: 110_001, 3: 60, 4: 3}
    trees = ContextTrees({"a": [b"a1 b2 c3"], "b": ["é é".encode()]})
    assert {r["doc_id"]: r["lang_pred"] for r in identify_language(df, trees).collect()} == {1: "a", 2: "a", 3: "a", 4: "b"}
    pages = df.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    assert sorted(r["page_id"] for r in fixity_audit(pages, pages.withColumn("html", pages["html"].substr(1, 500_000))).collect()) == [1, 2]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    for r in pack_documents(df, TOKENIZER).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())


def test_toxicity_against_a_plain_score(spark):
    """Scores are those of distinct words; held-out labels and null rows teach nothing; any column names pass."""
    rng = random.Random(2)
    toxic = lambda k: k % 7 == 0
    text = lambda k: " ".join([rng.choice(("Vile!", "scum", "vile")) for _ in range(2 if toxic(k) else 0)] + [f"w{rng.randrange(200)}" for _ in range(30)])
    rows = [(k, text(k), "x") for k in range(600)] + [(None, "vile", "x"), (601, None, None), (602, "", None), (7, "vile vile", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    labels = [(k, int(toxic(k))) for k in range(600)]
    model = learn(docs, spark.createDataFrame([*labels, (0, 0), (None, 1)], "doc_id long, toxic int"))
    other = learn(docs, spark.createDataFrame([(k, 1 - x if held(k) else x) for k, x in labels], "doc_id long, toxic int"))
    assert (model.weights == other.weights).all() and model.bias == other.bias
    from quire.llm.shared import mix, word_hashes
    from quire.llm.toxicity_pu import BITS

    def plain(t):
        words = {w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")}
        slots = {int(mix(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0])[0]) >> (64 - BITS) for w in words}
        return 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[s]) for s in slots))))

    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 6)) for r in score_toxicity(docs, model).collect())
    assert got == sorted((k if k is not None else -1, round(plain(t), 6)) for k, t, _ in rows)
    found = [r["score"] >= 0.5 for r in score_toxicity(docs.where("doc_id < 600 and doc_id <> 7"), model).orderBy("doc_id").collect()]
    assert sum(f == toxic(k) for f, k in zip(found, [k for k in range(600) if k != 7])) > 590
    assert learn(docs.limit(0), docs.selectExpr("doc_id", "1 as toxic")) is None and learn(docs, docs.selectExpr("doc_id", "0 as toxic")) is None
    assert score_toxicity(docs.limit(0), model).count() == 0


def least_bins(sizes, capacity):
    """The exact least number of bins, by filling one after the other with every maximal choice for the largest item."""
    best = len(sizes)

    def fill(left, used):
        nonlocal best
        if not left:
            best = min(best, used)
            return
        if used + -(-sum(left) // capacity) >= best:
            return
        first, rest = left[0], left[1:]
        for k in range(len(rest), -1, -1):
            for chosen in set(combinations(range(len(rest)), k)):
                if first + sum(rest[i] for i in chosen) <= capacity:
                    fill([x for i, x in enumerate(rest) if i not in chosen], used + 1)

    fill(sorted(sizes, reverse=True), 0)
    return best


def test_packing_against_the_exact_minimum():
    """At most one sequence more than the least, and the least in nearly all cases."""
    rng, more = random.Random(3), 0
    for _ in range(120):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        counts = {n: sizes.count(n) for n in sizes}
        used, least = sum(times for _, times in plan_sequences(counts, 20)), least_bins(sizes, 20)
        assert least <= used <= least + 1
        more += used > least
    assert more <= 6


def test_ids_beyond_their_memory(monkeypatch):
    """Words that are forgotten are encoded again; marks, case and words of every kind give the tokenizer's ids."""
    monkeypatch.setattr("quire.llm.packing.CACHE", 40)
    tokenizer, own = Tokenizer.from_file(TOKENIZER), Ids(TOKENIZER)
    assert own.apart and own.folds
    rng = random.Random(4)
    kinds = ["Word", "it's", "IT'S.", "a1b,", "É.", "é!?", "ÉA'", "x-y", "--", "'s'", "(x)", "9.", "1,000", "ß…", "…", "İx", "ǰ", "J̌", "á.", "\x1f", "<|x|>", "don't!!", "#%%%", "w%%%", "$$$,", "日本語。", "a\xa0b."]
    for _ in range(60):
        texts = [rng.choice((" ", "\n", "  ")).join(rng.choice(kinds) + rng.choice(("", str(rng.randrange(99)), rng.choice(kinds))) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        data = b"".join(t.encode() for t in texts)
        ids, ends = own.of(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words():
    rng = np.random.default_rng(5)
    memory, known = Memory(16), {}
    for _ in range(20):
        new = np.unique(rng.integers(1, 1 << 63, 100).astype(np.uint64))
        sizes = rng.integers(0, 5, len(new))
        ids = rng.integers(0, 1000, sizes.sum()).astype(np.uint32)
        memory.add(new, sizes, ids)
        known |= dict(zip(new.tolist(), (x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1]))))
    asked = np.array([*known, 12345], np.uint64)
    found = memory.find(asked)
    assert found[-1] == -1 and (found[:-1] >= 0).all()
    size = memory.sizes(found[:-1])
    assert np.split(memory.ids(found[:-1], size), np.cumsum(size)[:-1])[7].tolist() == list(known.values())[7]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, target int, cut int, last int, source_size int, changed_id int, kept string, _kept string, gone_id int, mix_size int, component_id int"


def odd_documents():
    """Null columns, empty and repeated rows, ties, exact and near copies, a passage in several documents."""
    rng = random.Random(6)
    base = [f"word{rng.randrange(900)}" for _ in range(80)]
    extra = (0.5, "p", 1, 2, 3, 4, 5, "k", "_k", 6, 7, 8)
    rows = [(1, None, None, None, None), (None, "null id here", "en", "s", 1), (2, "", "en", "s", 0), (3, "12 34", "en", "t", 5), (4, "a b", "en", None, 3), (4, "a b", "en", None, 3), (5, "a b", "en", None, 3)]
    rows += [(10, " ".join(base), "en", "s", 1), (11, " ".join(base), "en", "t", 1), (12, " ".join([*base[:79], "other"]), "de", "s", 1), (13, "start " + " ".join(base[5:60]) + " end of it", "de", "t", 1)]
    rows += [(20 + k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 40))), rng.choice(("en", "de")), rng.choice(("s", "t", None)), 9) for k in range(30)]
    return [(*r, *extra) for r in rows]


def test_stages_of_odd_tables(spark, tmp_path):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, CLASHING)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = lambda name: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept[name])
    rest = list(range(20, 50))
    assert ids("language") == [-1, 4, 4, 5, 10, 11, 12, 13, *rest]
    assert ids("near_duplicates") == [-1, 4, 4, 10, 13, *rest]
    assert ids("substrings") == [-1, 4, 4, 10, 13, *rest]
    (cut,) = (r for r in kept["substrings"] if r["doc_id"] == 13)
    assert cut["text"] == "start end of it" and cut["n_chars"] == 15 and cut["target"] == 1 and cut["kept"] == "k"
    assert set(ids("mixing")) <= set(ids("substrings")) and all(r["score"] == 0.5 for r in kept["mixing"])
    assert len(kept["packing"]) == len(kept["mixing"])


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)


def test_jaccard_dedup_of_odd_tables(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B c d e  f", "y"), (None, "a b c d e f", "z"), (3, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    assert sorted((r["doc_id"] or 0, r["gone_id"]) for r in jaccard_dedup(df).collect()) == [(0, "z"), (1, "x"), (1, "x"), (3, "z"), (3, "z")]
    assert jaccard_dedup(df.limit(0)).columns == df.columns
