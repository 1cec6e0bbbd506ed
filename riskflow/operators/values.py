"""What each user does: counts per user, field and value, and everything that follows from them.

One map-side-combined aggregation (user, field, value) feeds the top-3 lists, the modes, the lists of known
values and the first-seen flags, so a hot user's rows are reduced to a row per distinct value before any of
them is gathered.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KNOWN_FIELDS = {"device": "device_type", "location": "location", "merchant": "merchant_category"}


def field_values(txn: DataFrame, fields: dict, user="user_id", keep=()) -> DataFrame:
    """Long form: one row per transaction and field."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), (F.col(c) if isinstance(c, str) else c)
                               .cast("string").alias("value")) for name, c in fields.items()])
    return txn.select(user, *keep, F.inline(pairs))


def value_counts(txn: DataFrame, fields: dict, user="user_id") -> DataFrame:
    """(user, field, value, n, first): `first` is the time of the first row with the value.

    Counts and times have a fixed width, so this is a hash aggregation on both sides of the shuffle.
    """
    long = field_values(txn, fields, user, keep=("ts",))
    return long.groupBy(user, "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


def top_values(counts: DataFrame, k: int, user="user_id") -> DataFrame:
    """The k most frequent values per user and field; among equals the one seen first (then the smaller)."""
    order = W.partitionBy(user, "field").orderBy(F.desc("n"), F.asc("first"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def modes(counts: DataFrame, user="user_id") -> DataFrame:
    """(user, field, value): the most frequent value, the smallest among equals, missing values aside."""
    order = W.partitionBy(user, "field").orderBy(F.desc("n"), F.asc("value"))
    return (counts.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") == 1).select(user, "field", "value"))
