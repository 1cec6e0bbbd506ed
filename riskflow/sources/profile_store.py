"""Store of the parts that profiles are made of (`operators.partials`): a folder per day and write.

Every write has a number, higher than those before; a repeated write replaces its own folders. A write brings either further
rows of its days, which add to what is there, or whole days (`whole`): these take back every earlier write of the same days, which is how late
corrections and deleted rows are handled. A whole day without rows is named in `days`. A write reads its own rows only; what is valid is decided
when the parts are read, from a table with a row per whole day.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import partials, profiles
from riskflow.sources import tables

PARTS = {"totals": partials.totals, "values": partials.value_parts, "newest": partials.newest_parts}


def write(txn: DataFrame, root: str, number: int, whole=False, days=()):
    """Adds the parts of some rows. `whole`: the rows are all there is of their days and of `days` (ISO dates)."""
    spark = txn.sparkSession
    for name, part in PARTS.items():
        (part(txn).withColumn("write", F.lit(number)).hint("rebalance", "day").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "write").parquet(f"{root}/{name}"))
    named = spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
    replaced = txn.select(F.to_date("ts").alias("day")).unionByName(named).distinct() if whole else named.limit(0)
    (replaced.withColumn("since", F.lit(number)).withColumn("write", F.lit(number)).coalesce(1).write.mode("overwrite")  # a row per day
     .option("partitionOverwriteMode", "dynamic").partitionBy("write").parquet(f"{root}/whole_days"))


def parts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The valid parts: of a day that was written whole, those of that write and later ones."""
    whole = spark.read.schema("day DATE, since INT").parquet(f"{root}/whole_days").groupBy("day").agg(F.max("since").alias("since"))
    rows = spark.read.parquet(f"{root}/{name}")
    whole = whole.withColumnRenamed("day", "whole_day")
    return (rows.join(whole, F.col("day").eqNullSafe(F.col("whole_day")), "left")
            .where("since IS NULL OR write >= since").drop("whole_day", "since", "write"))


def training_profile(spark: SparkSession, root: str) -> DataFrame:
    return partials.training_profile(partials.merged_totals(parts(spark, root, "totals")), partials.merged_values(parts(spark, root, "values")))


def serving_profile(spark: SparkSession, root: str, recent: DataFrame = None) -> DataFrame:
    return partials.serving_profile(partials.merged_totals(parts(spark, root, "totals")), partials.merged_values(parts(spark, root, "values")), recent)


def newest(spark: SparkSession, root: str, limit=partials.NEWEST) -> DataFrame:
    """The newest rows of each user, at most `partials.NEWEST`."""
    return partials.merged_newest(parts(spark, root, "newest"), limit)


def refresh(spark: SparkSession, history: str, root: str, number: int, first: str, last: str):
    """Brings the days from `first` to `last` (ISO dates) up to date from the history store, whose other days are not read."""
    rows = days_of(spark, history, first, last)
    wanted = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}'))").collect()  # a row per day
    write(rows, root, number, whole=True, days=[str(r[0]) for r in wanted])


def days_of(spark: SparkSession, history: str, first: str, last: str) -> DataFrame:
    day = F.col("txn_date")
    return tables.read_history(spark, history).where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).drop("txn_date")


def recent_counts(spark: SparkSession, history: str, as_of) -> DataFrame:
    """Rows of each user in the 24 hours before `as_of`, from the two days of the history store that hold them."""
    rows = tables.read_history(spark, history, since=F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    return profiles.recent_counts(rows, as_of)
