"""Raw messages, each stored once: keyed state for what repeats soon, the stored names for what repeats months later.

Messages are (msg_id, received, payload) and whatever other columns the stream has. Within the horizon, counted by when
the engine met a message, the state store drops repetitions; as this time never runs backwards, no message is late and
none is lost. What gets through is checked against the names stored, whose folder is partitioned by a hash of msg_id,
so only the partitions of the batch's names are read, and of them one column. The folder is partitioned by batch, too: a
batch that runs again doesn't compare with its own rows and writes the same partitions again. Batches are named after
their stream, as a stream with a new checkpoint counts from 0.

Defined cases: of a batch's messages with one name the one received first is stored, of those the first by payload; a
message without a name can't be told from others and goes to the folder of the rejected, repeated or not; equal payloads
under different names are different messages; an empty batch stores nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Partitions of the stored names.
BUCKETS = 64


def batch_name(batch: DataFrame, number: int) -> str:
    """A batch's name: the id of its stream, which its checkpoint keeps, and its number there."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or 'none'}-{number}"


class Messages:
    """The folder of stored messages, and that of the rejected ones."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, f"{folder}/messages", schema, buckets
        self.refused = f"{folder}/rejected"

    def _read(self, path: str, more: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, {more}").parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, {more}")

    def stored(self) -> DataFrame:
        return self._read(self.path, "bucket int, batch string")

    def rejected(self) -> DataFrame:
        return self._read(self.refused, "batch string")

    def add(self, batch: DataFrame, number: int) -> None:
        """Store the messages of a batch whose names aren't stored yet."""
        own = batch_name(batch, number)
        names = self.spark.createDataFrame([], self.schema).columns
        number_ = F.lit(own).alias("batch")
        batch.where("msg_id is null").select(*names, number_).write.option("partitionOverwriteMode", "dynamic").partitionBy("batch").mode("overwrite").parquet(self.refused)
        first = F.min_by(F.struct(*names), F.struct(F.col("received").isNull(), "received", "payload"))
        one = batch.where("msg_id is not null").groupBy("msg_id").agg(first.alias("m")).select("m.*").withColumn("bucket", F.pmod(F.xxhash64("msg_id"), F.lit(self.buckets)).cast("int"))
        asked = one.select("bucket").distinct()  # at most `buckets` rows
        known = self.stored().where(F.col("batch") != own).join(F.broadcast(asked), "bucket", "left_semi").select("bucket", "msg_id")
        one.join(known, ["bucket", "msg_id"], "left_anti").select(*names, "bucket", number_).write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").mode("overwrite").parquet(self.path)


def start(stream: DataFrame, messages: Messages, checkpoints: str, horizon: str = "1 day", **trigger: object) -> StreamingQuery:
    """Store the messages of a stream; trigger as of writeStream."""
    unnamed = F.when(F.col("msg_id").isNull(), F.uuid()).otherwise(F.col("msg_id"))  # those are kept apart, not dropped
    met = stream.withColumn("_met", F.current_timestamp()).withColumn("_name", unnamed)
    once = met.withWatermark("_met", horizon).dropDuplicatesWithinWatermark(["_name"]).drop("_met", "_name")
    return once.writeStream.foreachBatch(messages.add).option("checkpointLocation", checkpoints).trigger(**(trigger or {"availableNow": True})).start()
