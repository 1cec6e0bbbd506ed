"""Bottom-k sketches of word shingles: fingerprints that can be merged.

A text's shingles are its runs of five lower-case words (a shorter text is one shingle, an empty one has none). Every
shingle is hashed to 48 bits; the sketch is the K smallest distinct hashes. Sketches of parts merge into the sketch of
the whole (`merged`), and two sketches estimate resemblance, containment and the number of distinct shingles.

As text, a fingerprint is the base64 of the sorted hashes, six bytes each. Rules: a null text is empty; equal texts
have equal fingerprints; two empty sketches resemble each other fully, an empty and another one not at all; long texts
are read in pieces of bounded size.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.words import shingle_lists
from riskflow.session import shares

K, WORDS, BITS = 128, 5, 48
_KNOWN = 300_000
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(64)], np.uint64)


class _Hashes(dict):
    """Word -> 64 bits; forgets all words when it holds too many."""

    def __missing__(self, word):
        if len(self) > _KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h):
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(64 - BITS)


def smallest(values: np.ndarray, k=K) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    room = 4 * k
    while len(values) > room:  # most values go without being sorted; copies may ask for more of them
        few = np.unique(np.partition(values, room)[:room])
        if len(few) >= k:
            return few[:k]
        room *= 4
    return np.unique(values)[:k]


def sketch(text: str, known: dict, k=K, n=WORDS) -> np.ndarray:
    found = np.empty(0, np.uint64)
    for words in shingle_lists((text or "").lower().encode(), n):
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        m = min(n, len(h))
        total = np.zeros(len(h) - m + 1, np.uint64)
        for i in range(m):
            total += h[i:len(h) - m + 1 + i] * _ODD[i]
        found = smallest(np.concatenate([found, _mixed(total)]), k)
    return found


def merged(a: np.ndarray, b: np.ndarray, k=K) -> np.ndarray:
    """Sketch of the union of two parts' shingles."""
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(s: np.ndarray, k=K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**BITS / (float(s[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k=K) -> float:
    """Estimated share of the union's shingles that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = merged(a, b, k)
    return np.intersect1d(np.intersect1d(a, b, True), union, True).size / len(union)


def containment(a: np.ndarray, b: np.ndarray, k=K) -> float:
    """Estimated share of a's shingles that b has as well."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def as_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).copy().view(">u8").ravel().astype(np.uint64)


def _sketched(k, n):
    def run(batches):
        known = _Hashes()
        for batch in batches:
            found = [as_text(sketch(t.as_py(), known, k, n)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], names=["key", "fingerprint"])
    return run


def fingerprints(docs: DataFrame, key="doc_id", text="text", k=K, n=WORDS) -> DataFrame:
    """`key` and fingerprint of every row; nothing is shuffled."""
    rows = docs.selectExpr(f"CAST(`{key}` AS BIGINT) key", f"CAST(`{text}` AS STRING) text")
    return rows.mapInArrow(_sketched(k, n), "key long, fingerprint string").withColumnRenamed("key", key)


def _merge_pieces(k):
    def run(batches):
        key, now = None, None
        out = []
        for batch in batches:
            for c, s in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist()):
                if now is not None and c == key:
                    now = merged(now, from_text(s), k)
                else:
                    if now is not None:
                        out.append((key, now))
                    key, now = c, from_text(s)
            yield _pairs(out)
            out = []
        if now is not None:
            yield _pairs([(key, now)])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()),
                                           pa.array([as_text(s) for _, s in rows], pa.string())], names=["key", "fingerprint"])
    return run


def merge_parts(parts: DataFrame, key="doc_id", fingerprint="fingerprint", k=K) -> DataFrame:
    """One fingerprint per `key` from those of its parts (pages of a book, shards of a source): parts meet within
    their map task first, then by key, and are merged one by one."""
    rows = parts.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fingerprint"))
    near = rows.sortWithinPartitions("key").mapInArrow(_merge_pieces(k), "key long, fingerprint string")
    far = near.repartition("key").sortWithinPartitions("key").mapInArrow(_merge_pieces(k), "key long, fingerprint string")
    return far.withColumnRenamed("key", key).withColumnRenamed("fingerprint", fingerprint)


COMPARED = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                      ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                      ("n_shingles", pa.float64()), ("in_edited", pa.float64())])


def _compared(k, n):
    def run(batches):
        known, before, out = _Hashes(), None, []

        def compare(key, text, own, following, theirs):
            half = len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            other = sketch(edited, known, k, n)
            return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other),
                    resemblance(own, other, k), resemblance(own, theirs, k), distinct(own, k), containment(own, other, k))

        def flush():
            columns = list(zip(*out)) or [[] for _ in COMPARED]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, COMPARED)], schema=COMPARED)

        for batch in batches:
            for key, text, tail in zip(*[batch.column(c) for c in ("key", "text", "tail")]):
                key, text, tail = key.as_py(), text.as_py(), tail.as_py()
                own = sketch(text, known, k, n)
                if before is not None:
                    out.append(compare(*before, text, own))
                before = None if tail else (key, text, own)
                if len(out) >= 500:
                    yield flush()
        yield flush()
    return run


def compare_with_next(docs: DataFrame, key="doc_id", text="text", k=K, n=WORDS, parts=None) -> DataFrame:
    """Every row's fingerprint next to that of its edited text and to that of the next row, in descending order of the key.

    The edited text has the last half of its code points replaced by the first ones of the next text, as many or all;
    after the last row comes the first. Rows with equal keys follow each other in the order of their texts, null keys
    come last.

    Texts are shuffled once, into ranges of the key; the range bounds are quantiles of the key, a bounded list that the
    driver holds. Each range ends with a copy of the next one's first row, so no range waits for another. A task
    streams its rows and holds two texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = parts or 4 * shares(spark)
    found = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 50 * parts).alias("at"),
                     F.max("key").alias("top"), F.count_if(F.col("key").isNull()).alias("nulls")).first()
    bounds = sorted({*(found["at"] or []), *([] if found["top"] is None else [found["top"]])})
    ranges = len(bounds) + (found["nulls"] > 0)  # range i ends at bounds[-1 - i]; null keys are the last one

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds, np.int64), keys.fillna(0).astype("int64").to_numpy())
        return pd.Series(np.where(keys.isna(), ranges - 1, len(bounds) - 1 - at)).astype("int32")

    heads = spark.createDataFrame([(b, len(bounds) - 1 - i) for i, b in enumerate(bounds)], "key long, head int")
    first = rows.join(F.broadcast(heads), "key").groupBy("head").agg(F.min("text").alias("text"))
    if found["nulls"]:
        first = first.unionByName(rows.where("key IS NULL").agg(F.min("text").alias("text"))
                                  .select(F.lit(ranges - 1).alias("head"), "text"))
    tails = first.select(F.lit(None).cast("long").alias("key"), "text",
                         F.pmod(F.col("head") - 1, F.lit(max(ranges, 1))).cast("int").alias("part"), F.lit(True).alias("tail"))
    dealt = rows.select("key", "text", range_of("key").alias("part"), F.lit(False).alias("tail")).unionByName(tails)
    dealt = dealt.repartition(shares(spark), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("key"), "text")
    schema = ("key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double, n_shingles double, in_edited double")
    return dealt.select("key", "text", "tail").mapInArrow(_compared(k, n), schema).withColumnRenamed("key", key)
