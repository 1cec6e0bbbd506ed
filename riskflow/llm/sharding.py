"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of 2^64 positions; a key goes to the owner of the next point clockwise. Shards
have a capacity; what overflows a full shard continues clockwise to the next point whose owner has room. With
`slack=0` capacities are floor(rows/shards) or one more, so the row counts of two shards differ by at most one;
with a slack, a shard takes at most (1 + slack) times its share, and less moves when a shard is added.

The keys of an arc (the stretch that ends at a point) are taken in the order (position, key, text checksum). So an arc's
keys go to few shards, each of which takes a run of ranks, and the whole assignment follows from the number
of keys per arc: a table of shards * vnodes rows, whatever the number of documents. The driver walks that ring once;
ranks are one shuffle of narrow rows by arc.

Rules: a null text has no bytes; a null key is a key like any other; equal rows are told apart by their rank only;
other columns are ignored; an empty table gives an empty result.
"""

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS, VNODES = 40, 128
OVERHEAD = 16


def ring(shards: int, vnodes: int):
    """Sorted points of the ring (signed) and their owners. A shard's points don't depend on the number of shards."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") - 2**63, s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def runs(counts: list, owners: list, capacity: list):
    """Where the keys of each arc go: (arc, first rank, rows, shard, first slot), by walking the ring round by round.

    In each round, every arc with keys left offers them to one point further clockwise; a shard takes what it has room
    for. Points whose owner is full are left out of the ring.
    """
    room, used, out = list(capacity), [0] * len(capacity), []
    left, taken = list(counts), [0] * len(counts)
    open_at = [i for i, s in enumerate(owners) if room[s] > 0]
    waiting = {i: [i] for i in range(len(owners)) if left[i]}  # point -> arcs that wait at it
    while waiting:
        full = False
        for point in sorted(waiting):
            s = owners[point]
            for arc in waiting[point]:
                n = min(left[arc], room[s])
                if n:
                    out.append((arc, taken[arc], n, s, used[s]))
                    left[arc] -= n
                    taken[arc] += n
                    room[s] -= n
                    used[s] += n
                    full |= room[s] == 0
        if full:
            open_at = [i for i in open_at if room[owners[i]] > 0]
        following = {}
        for point in sorted(waiting):
            for arc in waiting[point]:
                if left[arc]:
                    if not open_at:
                        raise ValueError("capacities hold fewer rows than there are")
                    at = bisect_left(open_at, point + 1)
                    following.setdefault(open_at[at % len(open_at)], []).append(arc)
        waiting = following
    return out


def capacities(rows: int, shards: int, slack: float = 0.0):
    """Equal up to one row without slack; the first shards take the odd ones."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards=SHARDS, vnodes=VNODES, slack=0.0, key="doc_id", text="text") -> DataFrame:
    """`key`, size, text_crc32, shard, slot of every row, and `moved`: whether it left the arc's own shard."""
    spark: SparkSession = docs.sparkSession
    points, owners = ring(shards, vnodes)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(key).cast("long")).alias("at"))

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(points, np.int64), at.to_numpy())
        return pd.Series(found % len(points)).astype("int32")

    counts = [0] * len(points)
    keys = docs.select(F.xxhash64(F.col(key).cast("long")).alias("at"))
    for r in keys.groupBy(arc_of("at").alias("arc")).count().collect():  # at most shards * vnodes rows
        counts[r["arc"]] = r["count"]
    plan = runs(counts, owners, capacities(sum(counts), shards, slack))
    schema = "arc int, first long, rows long, shard int, slot0 long"
    plan = spark.createDataFrame([(int(a), int(f), int(n), int(s), int(u)) for a, f, n, s, u in plan], schema)
    own = spark.createDataFrame(list(enumerate(owners)), "arc int, own int")
    table = F.broadcast(plan.join(own, "arc").groupBy("arc", "own").agg(F.sort_array(F.collect_list(
        F.struct("first", "rows", "shard", "slot0"))).alias("runs")))
    order = W.partitionBy("arc").orderBy("at", "key", "text_crc32", "size")
    ranked = rows.withColumn("arc", arc_of("at")).withColumn("rank", F.row_number().over(order) - F.lit(1))
    run = F.element_at(F.filter("runs", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["first"] + r["rows"])), 1)
    placed = ranked.join(table, "arc").withColumn("run", run)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.col("run.shard").alias("shard"),
                         (F.col("run.slot0") + F.col("rank") - F.col("run.first")).cast("long").alias("slot"),
                         (F.col("run.shard") != F.col("own")).alias("moved"))
