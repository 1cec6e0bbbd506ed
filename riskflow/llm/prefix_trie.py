"""Trie of conversation prefixes, built by a splitter skeleton.

Every different sequence of a conversation's first d turns (role, text) is a node; the root is the empty sequence. Conversations that
begin with a node's sequence are its members, and what a trie store saves there is its text for all members but one.

A turn is 20 bytes: 128 bits of a digest of its role and text, and the length of its text; a conversation is the path of these. In byte order a node's
members stand next to each other. Equal paths are one row, with their number and the digest of their ids. The sorted paths are cut into
shards at splitters from a sample. A node with members in two shards is a prefix of the splitter between them, so
the trie of the splitters' prefixes, the skeleton, is all that shards share. It is broadcast: at most shards x `SPLITTER_TURNS` nodes.
Each shard walks its sorted paths with the open path as its stack and finishes every other node by itself; for a
skeleton node it returns what it saw (members, children, leaves and savings outside the skeleton). Those parts are summed in Spark to a
row per skeleton node and go up the skeleton on the driver; their number is bounded as the skeleton is.

The ids that end at a node are hashed in ascending order, however many they are: ranges of (path, id) are sorted apart and
written as pieces of `PIECE` ids, and one task hashes a path's pieces in a stream, which is all that SHA-256 leaves to do in order.

A conversation is one row of 20 bytes per turn from then on; its turns come together in one task. More than `SPLITTER_TURNS` turns
that very many conversations share are in one shard, since splitters are cut to that length.

Rules: turns are ordered by their number (null first, equal numbers by their digest); a null role or text is empty; repeated rows are
turns of their own; rows with a null key are nobody's; a conversation of `ids` without turns is a member of the root alone; keys may be of any type that
has an order; other columns are ignored; without conversations there is no node.
"""

import hashlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import stored
from riskflow.session import shares

TURN_BYTES = 20
SPLITTER_TURNS, SAMPLED = 1024, 64
PIECE = 50_000
_NONE = hashlib.sha256(b"").hexdigest()
NODES = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _code(role, text):
    """20 bytes of a turn, in hexadecimal digits."""
    own = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(own, 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def paths(turns: DataFrame, ids=None, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """key, path (20 bytes per turn) of every conversation in `turns`, and of those in `ids` (one column, the keys) without any."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(key).alias("key"), F.struct(F.col(turn).alias("turn"), _code(plain(role), plain(text)).alias("code")).alias("at"))
    if ids is not None:
        rows = rows.unionByName(ids.select(F.col(ids.columns[0]).alias("key"), F.lit(None).cast(rows.schema["at"].dataType).alias("at")))
    rows = rows.where("key IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("turns"))
    return rows.select("key", F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("path"))


def _pieces(batches):
    """Rows (path_key, key) in that order -> path_key, first key, the keys as text; a piece has at most `PIECE` of them."""
    now, held = None, []

    def table(rows, kind):
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), kind, pa.string()))],
                                          names=["path_key", "first", "piece"])
    kind = None
    for batch in batches:
        kind, out = batch.column("key").type, []
        for p, k in zip(batch.column("path_key").to_pylist(), batch.column("key").to_pylist()):
            if held and (p != now or len(held) == PIECE):
                out.append((now, held[0], ",".join(map(str, held))))
                held = []
            now = p
            held.append(k)
        yield table(out, kind)
    if held:
        yield table([(now, held[0], ",".join(map(str, held)))], kind)


def _hashed(batches):
    """Pieces in the order of (path_key, first) -> path_key, ends_sha256."""
    now, state = None, None
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)],
                                                    names=["path_key", "ends_sha256"])
    for batch in batches:
        out = []
        for p, piece in zip(batch.column("path_key").to_pylist(), batch.column("piece").to_pylist()):
            if p == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = p, hashlib.sha256()
            state.update(piece.encode())
        yield table(out)
    if now is not None:
        yield table([(now, state.hexdigest())])


def ends(own: DataFrame) -> DataFrame:
    """path_key, ends_sha256 of `own` (key, path_key): the digest of each path's keys, ascending, as text with commas between."""
    kind, n = own.schema["key"].dataType.simpleString(), shares(own.sparkSession)
    sorted_ = own.repartitionByRange(n, "path_key", "key").sortWithinPartitions("path_key", "key")
    pieces = sorted_.select("path_key", "key").mapInArrow(_pieces, f"path_key string, first {kind}, piece string")
    return (pieces.repartition(n, "path_key").sortWithinPartitions("path_key", "first")
            .mapInArrow(_hashed, "path_key string, ends_sha256 string"))


def splitters(found: DataFrame, shards: int) -> list:
    """At most `shards` - 1 points in the order of the paths, quantiles of a sample; they only decide how the work is cut."""
    longest = SPLITTER_TURNS * TURN_BYTES
    sample = found.select(F.substring("path", 1, longest).alias("path"), F.xxhash64("path").alias("draw"))
    sample = sorted(bytes(r["path"]) for r in sample.orderBy("draw").limit(shards * SAMPLED).collect())
    return sorted({sample[i * len(sample) // shards] for i in range(1, shards)} - {b""}) if sample else []


class Skeleton:
    """Trie of the splitters' prefixes: node 0 is the root, children have higher numbers than their parents."""

    def __init__(self, points):
        self.child, self.parent, self.depth, self.size = {}, [-1], [0], [0]
        for path in points:
            node = 0
            for at in range(0, len(path), TURN_BYTES):
                step = (node, path[at:at + TURN_BYTES])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.size.append(int.from_bytes(step[1][-4:], "big"))
                node = self.child[step]


class Node:
    """An open node of a shard; `skeleton` is its number there, -1 if the shard has it to itself."""

    __slots__ = ("skeleton", "depth", "size", "key", "convs", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, skeleton, depth, size):
        self.skeleton, self.depth, self.size, self.key = skeleton, depth, size, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends, self.rows = _NONE, []

    def add(self, key, convs):
        self.key = key if self.key is None else min(self.key, key)
        self.convs += convs


def _grown(sent):
    """Sorted paths -> finished nodes (of a skeleton parent: with its number in place of its key) and parts of skeleton nodes."""

    def close(stack, out):
        node = stack.pop()
        if node.skeleton >= 0:
            out.append((node.skeleton, -1, node.key, None, node.depth, node.convs, node.children, node.leaves, node.saved, node.ends))
            return
        node.saved += (node.convs - 1) * node.size
        node.leaves = node.leaves or 1
        for row in node.rows:
            out.append((-1, -1, row[0], node.key, *row[1:]))
        row = (node.key, node.depth, node.convs, node.children, node.leaves, node.saved, node.ends)
        above = stack[-1]
        above.add(node.key, node.convs)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        if above.skeleton >= 0:
            out.append((-1, above.skeleton, node.key, None, *row[1:]))
        else:
            above.rows.append(row)

    def run(batches):
        bones, stack, before, kind = sent.value, [], b"", None

        def table(out):
            types = [pa.int32(), pa.int32(), kind, kind, *[pa.int64()] * 5, pa.string()]
            names = ["skeleton", "under", "conv_id", "parent_conv_id", *NODES, "ends_sha256"]
            columns = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            kind, out = batch.column("key").type, []
            for path, key, n, sha in zip(*[batch.column(c).to_pylist() for c in ("path", "key", "n_ends", "ends_sha256")]):
                if not stack:
                    stack = [Node(0, 0, 0)]
                same = 0
                while same < min(len(path), len(before)) and path[same:same + TURN_BYTES] == before[same:same + TURN_BYTES]:
                    same += TURN_BYTES
                while len(stack) > same // TURN_BYTES + 1:
                    close(stack, out)
                for at in range(same, len(path), TURN_BYTES):
                    code, above = path[at:at + TURN_BYTES], stack[-1]
                    bone = bones.child.get((above.skeleton, code), -1) if above.skeleton >= 0 else -1
                    stack.append(Node(bone, above.depth + 1, int.from_bytes(code[-4:], "big")))
                stack[-1].add(key, n)
                stack[-1].ends, before = sha, path
                if len(out) >= 5000:
                    yield table(out)
                    out = []
            yield table(out)
        if stack:
            out = []
            while stack:
                close(stack, out)
            yield table(out)
    return run


def _up(bones: Skeleton, parts: dict) -> list:
    """Rows (number, key, parent's key, ...) of the skeleton nodes from the sums of their parts, leaves first."""
    nodes = [Node(i, d, s) for i, (d, s) in enumerate(zip(bones.depth, bones.size))]
    for i, r in parts.items():
        n = nodes[i]
        n.key, n.convs, n.children, n.leaves, n.saved, n.ends = r
    for n in reversed(nodes):
        if not n.convs:
            continue
        n.saved += (n.convs - 1) * n.size
        n.leaves = n.leaves or 1
        if n.depth:
            above = nodes[bones.parent[n.skeleton]]
            above.add(n.key, n.convs)
            above.children += 1
            above.leaves += n.leaves
            above.saved += n.saved
    return [(n.skeleton, n.key, nodes[bones.parent[n.skeleton]].key if n.depth else None, n.depth, n.convs, n.children, n.leaves, n.saved, n.ends)
            for n in nodes if n.convs]


def trie(turns: DataFrame, ids=None, key="conv_id", turn="turn", role="role", text="text", shards=None) -> DataFrame:
    """A row per node: `conv_id` (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    text saved in its subtree) and ends_sha256 (of the members that end there)."""
    spark, kind = turns.sparkSession, turns.schema[key].dataType.simpleString()
    shards = shards or shares(spark)
    own = stored(paths(turns, ids, key, turn, role, text).withColumn("path_key", F.sha2("path", 256)), "paths")
    found = own.groupBy("path").agg(F.count(F.lit(1)).alias("n_ends"), F.min("key").alias("key"))
    found = found.withColumn("path_key", F.sha2("path", 256)).join(ends(own.select("key", "path_key")), "path_key")
    found = stored(found.select("path", "key", "n_ends", "ends_sha256"), "distinct_paths")
    points = splitters(found, shards)
    bones = Skeleton(points)
    sent = spark.sparkContext.broadcast(bones)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series) -> pd.Series:
        return path.map(lambda p: bisect_right(points, p)).astype("int32")

    dealt = found.withColumn("shard", shard_of("path")).repartition(shards, "shard").sortWithinPartitions("shard", "path").drop("shard")
    schema = (f"skeleton int, under int, conv_id {kind}, parent_conv_id {kind}, " + ", ".join(f"{c} long" for c in NODES) + ", ends_sha256 string")
    rows = stored(dealt.mapInArrow(_grown(sent), schema), "nodes")
    sent.unpersist()
    total = rows.where("skeleton >= 0").groupBy("skeleton").agg(
        F.min("conv_id"), *[F.sum(c) for c in NODES[1:]], F.coalesce(F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))), F.lit(_NONE)))
    top = _up(bones, {r[0]: tuple(r)[1:] for r in total.collect()})  # a row per skeleton node at most
    names = ["conv_id", "parent_conv_id", *NODES, "ends_sha256"]
    top = spark.createDataFrame(top, schema.replace("under int, ", ""))
    heads = F.broadcast(top.select(F.col("skeleton").alias("under"), F.col("conv_id").alias("above")))
    rest = rows.where("skeleton < 0").join(heads, "under", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return rest.select(*names).unionByName(top.select(*names))
