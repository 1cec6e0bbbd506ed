"""Connected components of a graph whose links are a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; `links` has the columns a and b.

    Rounds of two steps until no link changes: every node hooks its larger neighbours to the smallest node it knows,
    then its smaller neighbours to the smallest of them. Links only ever shrink towards stars, and the number of rounds grows
    with the logarithm of a chain's length. Each round is a stored table. Minima are pre-aggregated in the map tasks; the joins
    bring a node's links and its minimum together, so a node with very many links may be split by the engine.
    """
    both = F.col("a") != F.col("b")
    now = stored(links.where(both).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen["n"]:
            return _named(now)
        before = seen
        sides = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        smallest = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (sides.join(smallest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where(both).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.select(F.col("a"), F.col("m").alias("b")).union(small.select(F.col("b"), F.col("m")))
                 .toDF("a", "b").where(both).distinct())
        now = stored(small, "links")


def _named(stars):
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select("b", "b")).distinct().toDF("node", "component")
