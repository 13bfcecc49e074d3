"""New messages polled into the memory, exactly once.

A file stream of message rows is deduplicated against what is stored: within the batch by the lowest
arrival number, and against history by an anti-join with the stored messages of the same buckets of the key (the table is
kept in buckets by it), of which only the key is read. The checkpoint takes the
place of a cursor; a batch that is replayed after a failure finds its rows stored already and adds none.
Rows without message id go to a dead-letter table and do not stop the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.functions.keys import key
from thicket.sources.store import Store

MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("conversation_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("token_count", T.LongType()), T.StructField("created_at", T.DoubleType()), T.StructField("ingest_seq", T.LongType()),
])


def fresh_rows(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of a batch whose message is not stored yet, one for each message."""
    rows = batch.withColumn("message_key", key("message_id")).where("message_key IS NOT NULL")
    first = rows.groupBy("message_key").agg(F.min("ingest_seq").alias("ingest_seq"))
    rows = rows.join(first, ["message_key", "ingest_seq"], "left_semi").dropDuplicates(["message_key"])
    return rows if stored is None else rows.join(stored.select("message_key"), "message_key", "left_anti")


def poll(spark: SparkSession, source: str, store: Store, checkpoint: str, conversation_id: int | None = None, files_per_batch: int = 8, once: bool = True, seconds: int = 8):
    """Starts the stream; ``once`` takes what is there and stops, else it looks again every few seconds."""
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if conversation_id is not None:
        stream = stream.where(F.col("conversation_id") == conversation_id)

    def take(batch: DataFrame, batch_id: int) -> None:
        bad = batch.where(key("message_id").isNull())
        new = fresh_rows(batch, store.near("messages", batch.select(key("message_id").alias("message_key")), ["message_key"])).withColumn("branch_id", F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")))
        counts = batch.agg(F.count(F.lit(1)).alias("polled"), F.max("ingest_seq").alias("last_seq")).first()
        if store.current("messages"):
            store.append("messages", new)
        else:
            store.replace("messages", new, ["message_key"])
        store.upsert("dead_letter", bad.withColumn("batch_id", F.lit(batch_id)), ["ingest_seq"])
        row = [(batch_id, counts["polled"], counts["last_seq"])]
        store.upsert("polls", batch.sparkSession.createDataFrame(row, "batch_id long, polled long, last_seq long"), ["batch_id"])

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def lag(spark: SparkSession, source: str, store: Store) -> int:
    """Rows of the source that no poll has taken yet, by arrival number."""
    done = store.read("polls")
    last = done.agg(F.max("last_seq")).first()[0] if done is not None else None
    newest = spark.read.schema(MESSAGES).parquet(source).agg(F.max("ingest_seq")).first()[0]
    return max(0, (newest or 0) - (last or 0))


def activity_windows(stream: DataFrame, minutes: int = 60, lateness: str = "2 hours") -> DataFrame:
    """Messages and tokens per conversation and window of source time; rows later than ``lateness`` are left out.

    Works on a stream and on a table.
    """
    ts = F.timestamp_seconds("created_at")
    timed = stream.where("conversation_id IS NOT NULL").withColumn("at", ts).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("tokens")).select(
        F.unix_timestamp("w.start").alias("window_start"), "conversation_id", "messages", "tokens"
    )
