"""Best-fit packing of token pieces into sequences, by partitions first and then up a tree.

Every document becomes its token ids and an end id; only a document that is longer than a sequence is cut, into pieces
of exactly one sequence (the first piece may be shorter). Each partition packs its pieces best-fit, longest first:
a piece goes where it leaves the least room. Nearly full bins are done. The others go up the tree as items: `FAN`
neighbouring nodes meet in one task, which packs their underfull bins best-fit again, and so on to the root.

What goes up is bounded. Best-fit leaves at most one bin that is not over half full in a node, since two of them would have
gone together. So at most `FAN` of the bins that meet can be put into another one, and for that the emptiest are
as good as any: the `FAN` emptiest per round still to come are enough, the rest are done. A node thus handles
at most FAN * FAN * rounds bins, at any size of the corpus. Pieces are not moved in these rounds: bins have a parent and an
offset in it, and pieces learn their sequence from that narrow table at the end.

Rules: a null text is empty, that is, the end id alone; repeated rows are packed each; other columns are ignored; an
empty table gives an empty result. Pieces of a partition are packed in runs of at most `RUN`.
"""

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.tables import stored

CAPACITY, FAN, RUN, NEARLY = 2048, 16, 200_000, 0.99
END_ID = 0
_PIECE_CHARS = 1 << 20
_BREAK = regex.compile(r"(?<=\S) (?=\S)")


def _byte_of_char():
    """The printable characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the
    others follow from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, run by the faster library of the two: the same merges give the same ids.

    Added tokens of the file (special or not) are found in texts, as the file's own library does.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    table = _byte_of_char()
    ranks = {bytes(map(table.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def token_ids(encoding, text: str) -> np.ndarray:
    """Ids of the whole text; long texts are encoded in parts cut at a blank between words, where no pre-token reaches across."""
    parts, at = [], 0
    while len(text) - at > _PIECE_CHARS and (cut := _BREAK.search(text, at + _PIECE_CHARS)):
        parts.append(text[at:cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return np.concatenate([np.asarray(encoding.encode_to_numpy(p, allowed_special="all"), "<u4") for p in parts])


def cuts(n: int, capacity=CAPACITY):
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def best_fit(sizes, capacity=CAPACITY):
    """Bin and offset of each item, packed in the given order, and the bins' fills."""
    bins, offsets, fills = [], [], []
    with_room, mask = [[] for _ in range(capacity + 1)], 0
    for size in sizes:
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        room -= size
        if room:
            with_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, fills


PIECES = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("node", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])


def _bin_id(level, node, b):
    return level << 58 | node << 30 | b


def _packed_locally(path, pattern, capacity):
    def run(batches):
        encoding, part, runs = tokenizer(path, pattern), TaskContext.get().partitionId(), 0
        rows = []

        def packed():
            nonlocal runs
            node = part  # runs of a partition share its node
            order = sorted(range(len(rows)), key=lambda i: -rows[i][3])
            bins, offsets, fills = best_fit([rows[i][3] for i in order], capacity)
            base = runs << 20
            columns = list(zip(*[(*rows[i], node, _bin_id(0, node, base + b), o, fills[b]) for i, b, o in zip(order, bins, offsets)]))
            rows.clear()
            runs += 1
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                ids = np.append(token_ids(encoding, text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                rows.extend((key, i, at, n, zlib.crc32(ids[at:at + n].tobytes())) for i, (at, n) in enumerate(cuts(len(ids), capacity)))
                if len(rows) >= RUN:
                    yield packed()
        if rows:
            yield packed()
    return run


MERGED = pa.schema([("bin", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])


def _merged(level, capacity):
    def run(batches):
        now, items = None, []

        def packed():
            bins, offsets, fills = best_fit([f for _, f in items], capacity)
            columns = list(zip(*[(b, now, _bin_id(level, now, p), o, fills[p]) for (b, _), p, o in zip(items, bins, offsets)]))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, MERGED)], schema=MERGED)

        for batch in batches:
            for node, b, fill in zip(*[batch.column(c).to_pylist() for c in ("node", "bin", "fill")]):
                if node != now and items:
                    yield packed()
                    items = []
                now = node
                items.append((b, fill))
        if items:
            yield packed()
    return run


def _carried(bins: DataFrame, capacity, many):
    """The emptiest bins of each node that are not nearly full."""
    rank = F.row_number().over(W.partitionBy("node").orderBy("fill", "bin"))
    return (bins.where(F.col("fill") < int(capacity * NEARLY)).withColumn("rank", rank).where(F.col("rank") <= many)
            .select("node", "bin", "fill"))


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, key="doc_id", text="text", capacity=CAPACITY) -> DataFrame:
    """`key`, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Token counts are made once: the partitions' result is a stored table, and later rounds read its narrow columns.
    """
    rows = docs.selectExpr(f"CAST(`{key}` AS BIGINT) key", f"CAST(`{text}` AS STRING) text")
    schema = "key long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, fill long"
    pieces = stored(rows.mapInArrow(_packed_locally(tokenizer_path, pattern, capacity), schema), "pieces")
    nodes = (pieces.agg(F.max("node")).first()[0] or 0) + 1
    rounds = 0
    while FAN**rounds < nodes:
        rounds += 1
    bins, to_root = pieces.where("offset = 0").select("node", "bin", "fill"), None
    for level in range(1, rounds + 1):
        items = _carried(bins, capacity, FAN * (rounds - level + 1)).withColumn("node", F.floor(F.col("node") / FAN))
        dealt = items.repartition("node").sortWithinPartitions("node", F.desc("fill"), "bin")
        merged = stored(dealt.mapInArrow(_merged(level, capacity), "bin long, node long, parent long, offset long, fill long"), "bins")
        bins = merged.where("offset = 0").select("node", F.col("parent").alias("bin"), "fill")
        step = merged.select("bin", "parent", "offset")
        if to_root is None:
            to_root = step
        else:  # bins that went no further keep the parent they have
            up = step.toDF("parent", "next", "more")
            to_root = to_root.join(up, "parent", "left").select("bin", F.coalesce("next", "parent").alias("parent"),
                                                               (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    if to_root is None:
        placed = pieces.withColumn("sequence_id", F.col("bin"))
    else:
        up = to_root.toDF("bin", "root", "more")
        placed = (pieces.join(up, "bin", "left").withColumn("sequence_id", F.coalesce("root", "bin"))
                  .withColumn("offset", F.col("offset") + F.coalesce("more", F.lit(0))))
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
