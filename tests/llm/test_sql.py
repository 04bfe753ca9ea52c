"""Corpus queries against their DuckDB SQL, on a small corpus and on tables with planted and odd rows."""

import random
from pathlib import Path

import duckdb
import pytest

from quire.llm.queries import oracle_sql, queries

SMALL = Path("/root/testdata/sf0.001")


def compared(spark, name, folder):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from '{path if path.is_file() else path / '*.parquet'}'")
    df = queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    expected = db.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return got


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_small_corpus(spark, name):
    assert compared(spark, name, SMALL)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Passages across documents, near copies, exact copies, empty and null texts; near vectors and such as link with nothing."""
    rng = random.Random(5)
    words = [f"W{k}" for k in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.choice((49, 50, 51, 90)))] for _ in range(8)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c d e"), (6, "A b\tc d e")]
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        docs.append((10 + 3 * k, " ".join(text)))
        if k % 4 == 0 and text:
            text[rng.randrange(len(text))] = "new"
            docs.append((11 + 3 * k, "\n".join(text)))
    vectors = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 1), (4, [1.0, 0.0], None), (5, [1.0, 0.0], 1), (6, [2.0, 0.01], 1), (7, [1.0, 0.0], 2)]
    for k in range(300):
        vectors.append((10 + k, [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)], k % 3))
    folder = tmp_path_factory.mktemp("planted")
    pages = [(k, f"u{k}", None if k % 5 == 0 else f"<p>{k}") for k in range(-300, 2500, 3)] + [(None, "u", f"n{k}") for k in range(40)] + [(13, "u", f"r{k % 25}") for k in range(60)] + [(7, None, "x")] * 3
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["op1_warc_fixity", "op2_substring_dedup", "op3_jaccard_join", "op6_metric_join"])
def test_planted(spark, planted, name):
    got = compared(spark, name, planted)
    assert len(set(got)) > 20
