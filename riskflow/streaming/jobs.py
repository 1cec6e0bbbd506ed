"""Starting streams and their sinks."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riskflow.session import fresh_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark):
    """State on disk with a memory cache; needed by the per-user state, good for every large state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # one store per task of a join in place of four
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    # sessions are merged on the map side before the shuffle
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def each_batch(write, path: str):
    """Idempotent foreachBatch writer: write(batch, batch_id, path) replaces what that batch wrote before.

    Batches without rows, such as the last one of an availableNow run, are fine for every writer here.
    """
    return lambda batch, batch_id: write(batch, batch_id, path)


def replace_folder(batch: DataFrame, batch_id: int, path: str):
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(df: DataFrame, path: str, checkpoint: str, write=replace_folder, output_mode="append",
          available_now=True) -> StreamingQuery:
    """Starts a stream whose batches go through `write`; the checkpoint folder must be shared."""
    writer = (df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
              .foreachBatch(each_batch(write, path)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_end(df: DataFrame, write=replace_folder, output_mode="append", arrivals=()) -> str:
    """Runs a stream over everything available and returns the folder it wrote.

    `arrivals` are calls that each bring further input; the stream is started again after every one, from its checkpoint.
    """
    spark = df.sparkSession
    path, progress = fresh_dir(spark, "stream"), fresh_dir(spark, "progress")
    start(df, path, progress, write, output_mode).awaitTermination()
    for arrive in arrivals:
        arrive()
        start(df, path, progress, write, output_mode).awaitTermination()
    return path


def read_back(df: DataFrame, path: str) -> DataFrame:
    """What a stream with the columns of `df` wrote."""
    return df.sparkSession.read.schema(df.schema).parquet(path).drop("batch_id")
