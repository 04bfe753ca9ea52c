"""Progress as a stream: batches, restarts, repeated batches."""

from pathlib import Path

import pytest
from quire.streaming import progress as P


def told(rows: list) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


def plain(rows: list[tuple]) -> list:
    """The same, document by document."""
    out = []
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        newest = max(own, key=lambda r: (r[1], r[5] is not None, r[5] or ""))
        out.append((doc, sum(r[3] == 0 for r in own), sum(r[3] == 1 for r in own), sum(r[4] for r in own), max(r[2] for r in own), newest[5]))
    return told(out)


ROWS = [(doc, seq, seq // 10 + 1, int(seq % 4 == 3), 7 * seq % 13, f"m{doc}-{seq}") for doc in (1, 2, 5, None) for seq in range(40)]
ROWS += [(7, 3, 1, 0, 0, None), (7, 3, 1, 0, 4, "b"), (7, 3, 1, 0, 4, "a"), (8, 0, 1, 0, 0, None)]


@pytest.fixture
def folders(tmp_path) -> tuple[str, str, str]:
    return f"{tmp_path}/messages", f"{tmp_path}/progress", f"{tmp_path}/checkpoint"


def test_progress_over_restarts(spark, folders):
    """The newest messages come first and each run stops; after each, progress is that of all messages so far."""
    seen: list[tuple] = []
    for part in range(3):
        new = [r for k, r in enumerate(ROWS) if k % 3 == 2 - part]
        seen += new
        spark.createDataFrame(new, P.MESSAGES).repartition(4).write.mode("append").parquet(folders[0])
        P.follow(spark, *folders, files_a_batch=2)
        assert told(P.current(spark, folders[1]).collect()) == plain(seen)
    assert told(P.counted(spark.createDataFrame(ROWS, P.MESSAGES)).selectExpr("* except (newest)", "newest.message").collect()) == plain(ROWS)
    batches = len(list(Path(folders[1]).glob("batch=*")))
    assert batches >= 6  # each run had several
    P.follow(spark, *folders)
    assert len(list(Path(folders[1]).glob("batch=*"))) == batches  # nothing new, no batch


def test_batch_that_runs_again(spark, folders):
    """A driver lost between a batch's output and its commit: the next run repeats the batch, and nothing counts twice."""
    half = len(ROWS) // 2
    spark.createDataFrame(ROWS[:half], P.MESSAGES).coalesce(1).write.parquet(folders[0])
    P.follow(spark, *folders)
    (commit,) = [p for p in Path(f"{folders[2]}/commits").iterdir() if p.name == "0"]
    commit.unlink()
    commit.with_name(".0.crc").unlink(missing_ok=True)
    spark.createDataFrame(ROWS[half:], P.MESSAGES).coalesce(1).write.mode("append").parquet(folders[0])
    P.follow(spark, *folders)
    assert told(P.current(spark, folders[1]).collect()) == plain(ROWS)


def test_batch_that_fails(spark, folders, monkeypatch):
    """The batch's output can't be written: the run fails, its error is raised, and the next run has all of it."""
    spark.createDataFrame(ROWS, P.MESSAGES).coalesce(2).write.parquet(folders[0])
    Path(folders[1]).write_text("in the way")
    with pytest.raises(Exception, match="progress"):
        P.follow(spark, *folders)
    Path(folders[1]).unlink()
    P.follow(spark, *folders)
    assert told(P.current(spark, folders[1]).collect()) == plain(ROWS)


def test_no_worker_and_no_window(spark):
    plan = P.counted(spark.createDataFrame(ROWS, P.MESSAGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Window" not in plan
