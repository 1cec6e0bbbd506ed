"""Ranked lexical search: the best documents for every item, by groups of documents that hold the same of its terms.

Terms are the runs of ASCII letters, digits and any characters beyond ASCII, with A-Z in lower case. A term's weight is
floor(1000 ln((2N + 2) / (2 df + 1))); all else is whole numbers: a document's norm m is 100 - B + (B n N) div L with B = 90, and its score
the sum of weight * ((1000000000 tf) div (1000 tf + 8 m)) over the item's terms, once each. N documents have a term, L is the number of all
their terms, n that of one document, df the documents with a term, tf its occurrences in one.

One pass over the texts stores, per document, its length and the counts of the terms that items use. N, L and df are sums over
that table. Then every task takes its documents in blocks. For an item, the presence of each of its terms is a bitmap over the block;
together they give each document a mask of the terms it holds. Documents with equal masks are a group, and a group's highest possible score is the
sum, over the mask, of the weight times the term's largest part in this block. Groups are scored in descending order of that bound, and the
rest is left as soon as it cannot reach the tenth best score found so far in this task: a bound equal to it is still
scored, since a smaller id may win the tie. Each task returns its best `top` per item, and a rank filter, which
Spark applies in the map tasks too, takes the best of those. So no pair of item and document is ever a row.

Items are handed out in blocks of about `BLOCK_CHARS` characters, a bounded broadcast; each block is a search of its own.

Rules: a null or empty text has no term and is in no result; an item without terms has no result; items are told apart by their row, so
equal ids or texts are ranked each; repeated documents are documents of their own; a null key comes after all others in a tie; keys
may be of any type that has an order; other columns are ignored; without documents or items the result is empty; a long text is
one document, counted whole.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.tables import stored

TOP = 10
#: Fixed values of the score.
B, SCALE, TF_UNIT, NORM_UNIT = 90, 1_000_000_000, 1000, 8
BLOCK_CHARS, BLOCK_DOCS = 1_000_000, 8192
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SLICE = 1 << 22


def terms(text: bytes):
    """Lists of the terms of a whole text, in order, in pieces of bounded size; only a longer term makes a piece longer."""
    at = 0
    while at < len(text):
        end, cut = at, 0
        while cut <= 0 and end < len(text):  # a piece ends before a term that it does not hold whole
            end = min(len(text), end + _SLICE)
            piece = text[at:end].translate(_TABLE)
            cut = piece.rfind(b" ") if end < len(text) else len(piece)
        yield piece[:cut].split()
        at += cut


def _blocks(items: DataFrame, key, text):
    """Lists of (key, distinct terms in order), each of about `BLOCK_CHARS` characters; the driver holds one list."""
    rows = items.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> ''").toLocalIterator()
    block, size = [], 0
    for r in rows:
        block.append((r["key"], list(dict.fromkeys(t for ts in terms(r["text"].encode()) for t in ts))))
        size += len(r["text"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counted(sent):
    """key, n, and the counts of the known terms of every document that has a term."""
    def run(batches):
        number = sent.value
        for batch in batches:
            keep, lengths, known, counts, sizes = [], [], [], [], []
            for i, t in enumerate(batch.column("text").cast(pa.binary())):
                n, seen = 0, Counter()
                for found in terms(t.as_py() or b""):
                    n += len(found)
                    seen.update(map(number.get, found))
                if n:
                    seen.pop(None, None)
                    keep.append(i)
                    lengths.append(n)
                    known += seen.keys()
                    counts += seen.values()
                    sizes.append(len(seen))
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(known, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["key", "n", "terms", "tf"])
    return run


def norms(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of every document; in whole numbers of any size where 64 bits would not hold the product."""
    if int(n.max(initial=0)) * documents * B < 2**63:
        return 100 - B + (B * n * documents) // length
    return np.array([100 - B + (B * int(x) * documents) // length for x in n], np.int64)


class Block:
    """Some documents: for every term the documents that hold it and what it adds to their score, without its weight."""

    def __init__(self, keys, n, sizes, known, tf, n_terms, documents, length):
        self.keys, self.n_docs = keys, len(n)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        part = (SCALE * tf) // (TF_UNIT * tf + NORM_UNIT * norms(n, documents, length)[doc])
        order = np.argsort(known, kind="stable")
        self.doc, self.part = doc[order], part[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(known, minlength=n_terms))])
        held = np.flatnonzero(np.diff(self.first))
        self.most = np.zeros(n_terms, np.int64)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.part, self.first[held])

    def groups(self, item: np.ndarray):
        """(masks, documents in the order of their masks, where each mask's documents start); the first mask may be empty."""
        words = np.zeros(((len(item) + 63) // 64, self.n_docs), np.uint64)
        for bit, t in enumerate(item.tolist()):
            words[bit >> 6, self.doc[self.first[t]:self.first[t + 1]]] |= np.uint64(1 << (bit & 63))
        order = np.lexsort(words) if len(words) > 1 else np.argsort(words[0], kind="stable")
        words = words[:, order]
        new = np.flatnonzero(np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(0)]))
        return words[:, new], order, new

    def bounds(self, masks, item, weight):
        """The highest score that each mask allows here."""
        most = weight * self.most[item]
        total = np.zeros(masks.shape[1], np.int64)
        for bit in range(len(item)):
            total += most[bit] * ((masks[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64)
        return total

    def scores(self, docs, item, weight):
        """Exact scores of some documents, given in ascending order."""
        total = np.zeros(len(docs), np.int64)
        for t, w in zip(item.tolist(), weight.tolist()):
            holds = self.doc[self.first[t]:self.first[t + 1]]
            at = np.searchsorted(holds, docs)
            hit = at < len(holds)
            hit[hit] = holds[at[hit]] == docs[hit]
            total[hit] += w * self.part[self.first[t] + at[hit]]
        return total


def _order(entry):
    score, key = entry
    return -score, key is None, 0 if key is None else key


def best(block: Block, item, weight, found: list, top=TOP) -> int:
    """Merges a block into the best (score, key) `found` so far; returns how many documents were scored."""
    masks, order, first = block.groups(item)
    bound = block.bounds(masks, item, weight)
    ends = np.append(first[1:], len(order))
    by_bound = np.argsort(-bound, kind="stable")
    at, step, scored = 0, 1, 0
    while at < len(by_bound):
        least = found[top - 1][0] if len(found) >= top else 1
        chosen = by_bound[at:at + step]
        chosen = chosen[bound[chosen] >= max(least, 1)]
        if not len(chosen):
            break
        docs = np.sort(np.concatenate([order[first[g]:ends[g]] for g in chosen]))
        score = block.scores(docs, item, weight)
        scored += len(docs)
        good = score >= max(least, 1)
        found += [(s, block.keys[d].as_py()) for s, d in zip(score[good].tolist(), docs[good].tolist())]
        found.sort(key=_order)
        del found[top:]
        at += step
        step = min(step * 2, 256)
    return scored


def _searched(sent, top):
    """item (its place in the block), score, key: the best documents of this task for every item."""
    def run(batches):
        items, weights, documents, length, n_terms = sent.value
        found, held, n_held, kind = [[] for _ in items], [], 0, pa.null()
        weights = [weights[i] for i in items]

        def search(parts):
            keys = pa.chunked_array([p.column("key") for p in parts])
            n = np.concatenate([p.column("n").to_numpy() for p in parts])
            sizes = np.concatenate([p.column("terms").value_lengths().to_numpy() for p in parts])
            known, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in ("terms", "tf"))
            block = Block(keys, n, sizes, known, tf, n_terms, documents, length)
            for item, weight, own in zip(items, weights, found):
                best(block, item, weight, own, top)

        for batch in batches:
            kind = batch.column("key").type
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                if n_held + part.num_rows > BLOCK_DOCS:
                    search(held)
                    held, n_held = [], 0
                held.append(part)
                n_held += part.num_rows
        if n_held:
            search(held)
        rows = [(i, s, k) for i, own in enumerate(found) for s, k in own]
        if not rows:
            return
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), kind))],
                                         names=["item", "score", "key"])
    return run


def _search(docs: DataFrame, block: list, top: int) -> DataFrame:
    """item, score, key, rank for one block of items."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, ts in block for t in ts))}
    sent = spark.sparkContext.broadcast(number)
    kind = docs.schema["key"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_counted(sent), f"key {kind}, n long, terms array<int>, tf array<long>"), "postings")
    sent.destroy()
    total = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    df = np.zeros(len(number), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block at most
        df[r["t"]] = r["count"]
    documents, length = total["documents"], total["length"] or 1
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = [np.array([number[t] for t in ts], np.int64) for _, ts in block]
    sent = spark.sparkContext.broadcast((items, weight, documents, length, len(number)))
    found = rows.mapInArrow(_searched(sent, top), f"item int, score long, key {kind}")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item="item_id", item_text="text", top=TOP) -> DataFrame:
    """`item`, rank, `key`, score: the `top` highest-scoring rows of `docs` for every row of `items`, from rank 1."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    spark, kind = docs.sparkSession, items.schema[item].dataType
    out = None
    for block in _blocks(items, item, item_text):
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"item int, item_key {kind.simpleString()}")
        own = _search(rows, block, top).join(F.broadcast(names), "item")
        own = own.select(F.col("item_key").alias(item), "rank", F.col("key").alias(key), "score")
        out = own if out is None else out.unionByName(own)
    if out is None:
        empty = f"`{item}` {kind.simpleString()}, rank int, `{key}` {docs.schema[key].dataType.simpleString()}, score long"
        return spark.createDataFrame([], empty)
    return out
