"""Progress of conversions as a stream: messages that tasks append to a folder, and what each document has come to.

The state of a document is a row of counters and its newest message, kept by Spark's own streaming aggregate (no Python
worker, no window over a document's messages), by doc_id, in the checkpoint. Each batch writes the documents that it
changed to a folder named by the batch: one that runs again after a lost driver overwrites its own folder, so that none
counts twice. ``current`` is the newest row of each document.

Messages may arrive in any order and in any number of files; ``seq`` tells which of a document is the newest (of equal ones
the greater text). A null doc_id is a document of its own, a null message is older than all others of its seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "doc_id long, seq long, page_num int, is_image int, chars long, message string"
PROGRESS = "doc_id long, lines long, images long, chars long, page_num int, newest struct<seq:bigint,message:string>, batch long"


def messages(events: DataFrame) -> DataFrame:
    """One message for each line and image of ``events``."""
    message = F.when(F.col("is_image") == 1, F.concat(F.lit("image "), F.col("image_idx").cast("string"))).otherwise(F.col("text"))
    return events.select(
        "doc_id", F.col("arrival_seq").cast("long").alias("seq"), "page_num", "is_image", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"), message.alias("message")
    )


def counted(found: DataFrame) -> DataFrame:
    """What each document has come to; of a stream or a table of messages."""
    return found.groupBy("doc_id").agg(
        F.count_if(F.col("is_image") == 0).alias("lines"),
        F.count_if(F.col("is_image") == 1).alias("images"),
        F.sum("chars").alias("chars"),
        F.max("page_num").alias("page_num"),
        F.max(F.struct("seq", "message")).alias("newest"),
    )


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Take up where the last run stopped, and read all messages that ``folder`` has by now, in batches of files.

    ``target`` gets a folder a batch. All three folders must be on a store that the executors share; one ``target``
    belongs to one ``checkpoint``.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    query = counted(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of each document: doc_id, lines, images, chars, page_num, message."""
    rows = spark.read.schema(PROGRESS).parquet(target)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("lines", "images", "chars", "page_num", "newest.message"), "batch").alias("last"))
    return last.select("doc_id", "last.*")
