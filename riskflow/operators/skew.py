"""Keys with more rows than one task should sort.

A window needs all rows of a key in one task, and the engine can't split it. A key is *hot* when it has more than
ROWS_PER_TASK rows; it deserves a piece for each ROWS_PER_TASK of them. That only decides how the work is cut, never a
result. There is at most one hot key, and two pieces, per ROWS_PER_TASK rows of the table, so the list is a millionth of
it: it is fetched once per job (one pass over the key column, pre-aggregated in the map tasks) and broadcast. Joins do
not use this: the engine measures and splits skewed join partitions itself.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """`frame` holds the key, its extra aggregates, `size`, its rows, and `pieces`, the tasks they deserve."""

    frame: DataFrame = None

    def attach(self, df: DataFrame, on) -> DataFrame:
        """`df` with the columns of its hot key, null for all other rows."""
        return df.join(F.broadcast(self.frame), on, "left")

    def __bool__(self):
        return self.frame is not None


NONE_HOT = HotKeys()


def hot_keys(df: DataFrame, key: str, extra=()) -> HotKeys:
    """Finds the hot keys of a table; runs a job that reads only the key and the columns of `extra`."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"), *extra)
    hot = counts.where(F.col("size") > ROWS_PER_TASK).withColumn(
        "pieces", F.ceil(F.col("size") / F.lit(ROWS_PER_TASK)).cast("int"))
    rows = hot.collect()
    return HotKeys(df.sparkSession.createDataFrame(rows, hot.schema)) if rows else NONE_HOT
