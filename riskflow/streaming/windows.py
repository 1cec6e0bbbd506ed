"""Streams without custom state: repeated requests, rolling counts, bursts.

Rolling counts and bursts lose no row, however late it comes, and need no state: every micro-batch writes what it adds
(`hourly`, `pieces`), replacing its own folder when it is repeated, and a reader puts the parts together (`rolling_counts`,
`bursts`). Windows that are still open are there as well, with what has arrived so far.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.streaming.jobs import replace_folder

HOURS = 24


def first_copies(requests: DataFrame, key="transaction_id", keep="7 days", spread=0) -> DataFrame:
    """One row per transaction id among rows that arrive within `keep` of each other.

    What counts is the time of arrival, which only rises, so no row is too late: a transaction with an old time of
    its own passes like any other. Ids are forgotten when `keep` has passed.
    With spread > 0 copies are first dropped per (id, input partition modulo spread). A transaction that is
    sent very often then reaches the final step at most `spread` times per batch instead of with all copies.
    """
    marked = requests.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", keep)
    if spread:
        marked = (marked.withColumn("__part", F.spark_partition_id() % spread)
                  .dropDuplicatesWithinWatermark([key, "__part"]).drop("__part"))
    return marked.dropDuplicatesWithinWatermark([key]).drop("__arrived")


def hourly(txn: DataFrame) -> DataFrame:
    """Transactions per user and hour."""
    return txn.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def write_hourly(batch: DataFrame, batch_id: int, path: str):
    """foreachBatch writer: what this batch adds to the hourly counts."""
    replace_folder(hourly(batch), batch_id, path)


def rolling_counts(counts: DataFrame, hours=HOURS) -> DataFrame:
    """Transactions per user and window of `hours` hours that ends at a full hour, from any parts of hourly counts."""
    whole = counts.groupBy("user_id", "hour").agg(F.sum("n").alias("n"))
    ends = F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("later")
    return (whole.select("user_id", "hour", "n", ends)
            .groupBy("user_id", (F.col("hour") + F.make_dt_interval(hours=F.col("later"))).alias("window_end"))
            .agg(F.sum("n").alias("n")))


def pieces(txn: DataFrame, gap="1 hour") -> DataFrame:
    """Runs of transactions of a user with less than `gap` between neighbours; a run ends `gap` after its last row."""
    return (txn.groupBy("user_id", F.session_window("ts", gap).alias("run"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("transaction_amount").alias("amount"))
            .select("user_id", F.col("run.start").alias("burst_start"), F.col("run.end").alias("burst_end"), "n", "amount"))


def write_pieces(batch: DataFrame, batch_id: int, path: str):
    """foreachBatch writer: the runs within this batch."""
    replace_folder(pieces(batch), batch_id, path)


def bursts(runs: DataFrame) -> DataFrame:
    """Whole bursts from the runs of any parts of the rows: runs that overlap are one."""
    before = W.partitionBy("user_id").orderBy("burst_start", "burst_end")
    reached = F.max("burst_end").over(before.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("opens", (reached.isNull() | (F.col("burst_start") >= reached)).cast("int"))
    numbered = marked.withColumn("burst", F.sum("opens").over(before.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "burst").agg(
        F.min("burst_start").alias("burst_start"), F.max("burst_end").alias("burst_end"), F.sum("n").alias("n"),
        F.sum("amount").alias("amount")).drop("burst")
