"""Streams: ledgers that take each key once, standing answers, weekly counts and sessions.

Windows with watermarks and sessions are extras; the batch operators of the same names give the results to compare with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.runtime import scratch


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose ``key`` the ledger at ``path`` doesn't hold yet; a batch that is run again adds nothing.

    The ledger is one table of any file system, partitioned by batch, so a repeated batch replaces what it wrote before it failed.
    Of earlier batches only keys within the new ones' range are read.
    """

    def insert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, path):
            lo, hi = batch.agg(F.min(key), F.max(key)).first()
            held = spark.read.parquet(path)
            if "batch" in held.columns and lo is not None:
                fresh = fresh.join(held.where((F.col("batch") != n) & F.col(key).between(lo, hi)).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events per seven-day window (weeks begin on Mondays) and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Each user's sessions: runs of events no further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def standing_answers(answers: DataFrame, late: str = "30 days") -> DataFrame:
    """The latest answer of each judge on each entry so far; use output mode 'update' or 'complete'."""
    return answers.withWatermark("answered_at", late).groupBy("entry_id", "judge").agg(F.max_by("verdict", F.struct("answered_at", "answer_id")).alias("verdict"), F.max("answered_at").alias("answered_at"))


def drain(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Run a stream over all that is there now into a table at ``path`` and return it; mode 'append' or 'complete'.

    The table and the stream's own checkpoint lie below ``path``, by default a new folder in the session's checkpoint folder. Each
    batch writes its part as its own folder; in complete mode the last one is the whole result.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/table/batch={n}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{path}/table"):
        return spark.createDataFrame([], stream.schema)
    table = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/table")
    if mode == "complete":
        table = table.where(F.col("batch") == table.agg(F.max("batch")).first()[0])
    return table.drop("batch")
