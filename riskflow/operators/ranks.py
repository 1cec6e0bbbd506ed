"""Exact row numbers over groups that are too large for one task.

The rows of a group are cut into blocks that follow the order of the numbering. Rows are numbered inside
their block, and each block starts where the blocks before it end; the block sizes are a small table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, group, block: Column, order, name="n") -> DataFrame:
    """Adds `name` = 1, 2, 3, ... per group.

    `block` is an integer that never decreases along `order` and takes a bounded number of values per group;
    `order` must be unique within a group.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = order if isinstance(order, (list, tuple)) else [order]
    rows = df.withColumn("__block", block)
    sizes = rows.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("__size"))
    earlier = W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "__block", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"),
                          F.sum("__size").over(W.partitionBy(*group)).alias("__group_size"))
    inside = W.partitionBy(*group, "__block").orderBy(*order)
    return (rows.withColumn("__at", F.row_number().over(inside))
            .join(starts, group + ["__block"])
            .withColumn(name, F.col("__start") + F.col("__at"))
            .withColumn(f"{name}_of", F.col("__group_size"))
            .drop("__block", "__at", "__start", "__group_size"))
