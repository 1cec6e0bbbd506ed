"""Repeated passages inside and across documents, found through difference-cover anchors.

A window is a run of `width` words. A word is removed if a window that covers it stands, word for word, at another place
as well, in any document or the same one. Words are what stands between runs of ASCII white space, unchanged.

Anchors: of every `PERIOD` positions only those of a difference cover are hashed (5 of 21: the differences of the cover's
members are all residues), each with the run of `width - PERIOD + 1` words that starts there. Two equal windows, wherever they
start, have an anchor at the same place inside: for some shift under `PERIOD` both shifted starts are cover positions, and the
anchor's run still lies within the window. So a window without a repeated anchor is unique. Every repeated anchor is extended
to the windows that contain it, and those are compared by 128 bits of all their words.

What moves: equal texts are one row, stored once in a table that is bucketed by the text's key, so the two joins with what was
found about a text do not shuffle texts again. Anchors and windows go through one shuffle of narrow rows each, by their hash. A task combines
before that: of a hash that it meets again it sends one row, and the other places are known to be repeated there and then, so a
passage that a third of all texts share is a row per task. A task remembers `KNOWN` hashes and then starts anew; that
costs rows, not results. What a text gathers again (its repeated anchors, its repeated windows) is bounded by its length.

Rules: a null text has no words; so has one of white space; a text of fewer than `width` words loses nothing; two documents of
one text of at least `width` words both lose all of it; repeated rows and repeated or null keys are documents of their own; the
key may have any type and other columns are ignored; an empty table gives an empty result; long texts are hashed
window by window, in a task that holds one text.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.tables import stored
from riskflow.session import fresh_dir, shares

WIDTH = 35
#: A difference cover of the period: every residue is a difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
KNOWN = 300_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROWS = 100_000


class Words:
    """The words of a text, joined by single blanks, and where each starts and ends."""

    def __init__(self, text: bytes):
        words = text.split()
        self.data, self.n = b" ".join(words), len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def runs(self, at: np.ndarray, length: int):
        """Bytes of the runs of `length` words that start at the positions `at`."""
        data = self.data
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist())]

    def anchors(self, width: int):
        """Cover positions and the hashes of their runs."""
        length = width - PERIOD + 1
        at = np.arange(max(0, self.n - length + 1))
        at = at[_IN_COVER[at % PERIOD]]
        return at, [xxhash.xxh3_64_intdigest(r) - 2**63 for r in self.runs(at, length)]

    def without(self, starts, width: int):
        """Number of words that the windows at `starts` cover, and the SHA-256 of the others."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.asarray(starts) + width, -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        if not len(kept):
            return self.n, _EMPTY
        cut = np.flatnonzero(np.diff(kept) != 1)
        first, last = kept[np.append(0, cut + 1)], kept[np.append(cut, len(kept) - 1)]
        text = b" ".join(self.data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist()))
        return self.n - len(kept), hashlib.sha256(text).hexdigest()


class Combiner:
    """Marks what a task knows to be repeated: (hash, place, sure) for every place.

    A hash's first place is unsure and speaks for the task; once the hash comes back, its first place and all later ones are sure.
    """

    def __init__(self, known=KNOWN):
        self.seen, self.known = {}, known

    def add(self, key, place, out):
        first = self.seen.get(key, self)
        if first is self:
            if len(self.seen) >= self.known:
                self.seen.clear()
            self.seen[key] = place
            out.append((key, place, False))
            return
        if first is not None:
            out.append((key, first, True))
            self.seen[key] = None
        out.append((key, place, True))


def _described(batches):
    """key, n_words, sha (of the words joined by blanks) and the two parts of the text's key of every row."""
    for batch in batches:
        sha, n = [], []
        for t in batch.column("text").cast(pa.binary()):
            words = (t.as_py() or b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(n, pa.int64()), pa.array([x.hex() for x in sha], pa.string()),
             pa.array([int.from_bytes(x[:8], "big", signed=True) for x in sha], pa.int64()),
             pa.array([int.from_bytes(x[8:16], "big", signed=True) for x in sha], pa.int64())],
            names=["key", "n_words", "sha", "k1", "k2"])


def _texts(width):
    """k1, k2, text of every row that has a window; of equal texts a task sends one, as long as it remembers them."""
    def run(batches):
        seen = set()
        for batch in batches:
            out = []
            for t in batch.column("text").cast(pa.binary()):
                words = (t.as_py() or b"").split()
                if len(words) < width:
                    continue
                text = b" ".join(words)
                sha = hashlib.sha256(text).digest()
                if sha[:16] in seen:
                    continue
                if len(seen) >= KNOWN:
                    seen.clear()
                seen.add(sha[:16])
                out.append((int.from_bytes(sha[:8], "big", signed=True), int.from_bytes(sha[8:16], "big", signed=True), text))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                                             names=["k1", "k2", "text"])
    return run


def distinct_texts(rows: DataFrame, width: int) -> DataFrame:
    """k1, k2, text: the different texts of `rows` that have a window, as a table bucketed by k1."""
    spark = rows.sparkSession
    n = shares(spark)
    dealt = rows.mapInArrow(_texts(width), "k1 long, k2 long, text binary").repartition(n, "k1")
    name = f"texts_{uuid.uuid4().hex}"
    (dealt.groupBy("k1", "k2").agg(F.first("text").alias("text")).write.format("parquet").option("compression", "zstd")
     .option("path", fresh_dir(spark, "texts")).bucketBy(n, "k1").saveAsTable(name))
    return spark.table(name)


def _anchored(width):
    def run(batches):
        known = Combiner()
        for batch in batches:
            for k1, text in zip(batch.column("k1").to_pylist(), batch.column("text")):
                out = []
                for h in Words(text.as_py()).anchors(width)[1]:
                    known.add(h, k1, out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.bool_())], names=["h", "k1", "sure"])
    return run


WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()),
                     ("sure", pa.bool_())])


def _windows(width):
    """The windows around a text's repeated anchors, by 128 bits of their words."""
    def table(out):
        h1 = np.fromiter((k >> 64 for k, _, _ in out), np.uint64, len(out)).view(np.int64)
        h2 = np.fromiter((k & 2**64 - 1 for k, _, _ in out), np.uint64, len(out)).view(np.int64)
        k1, k2, start = (list(x) for x in zip(*[p for _, p, _ in out])) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                           pa.array(start, pa.int32()), pa.array([s for _, _, s in out], pa.bool_())], schema=WINDOWS)

    def run(batches):
        known = Combiner()
        for batch in batches:
            out = []
            for k1, k2, text, found in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                                           batch.column("text"), batch.column("found")):
                words, found = Words(text.as_py()), set(found.as_py())
                at, hashes = words.anchors(width)
                at = at[np.fromiter((h in found for h in hashes), bool, len(hashes))]
                edge = np.zeros(words.n + 2, np.int64)
                np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[:words.n - width + 1])
                for s, run_ in zip(starts.tolist(), words.runs(starts, width)):
                    known.add(xxhash.xxh3_128_intdigest(run_), (k1, k2, s), out)
                    if len(out) >= _ROWS:
                        yield table(out)
                        out = []
            yield table(out)
    return run


def _repeated(rows: DataFrame, by: list, own: list) -> DataFrame:
    """Rows that are sure or share `by` with another row; a sure row is dealt out alone, by what is its own."""
    alone = F.when(F.col("sure"), F.xxhash64(*own)).alias("alone")
    dealt = rows.select(*by, *own, alone)
    same = W.partitionBy(*by, "alone")
    return dealt.withColumn("times", F.count(F.lit(1)).over(same)).where("alone IS NOT NULL OR times > 1")


def repeated_windows(texts: DataFrame, width=WIDTH) -> DataFrame:
    """k1, k2, start of every window of `texts` (k1, k2, text) whose words stand at another place of them too."""
    anchors = texts.select("k1", "text").mapInArrow(_anchored(width), "h long, k1 long, sure boolean")
    found = _repeated(anchors, ["h"], ["k1"]).groupBy("k1").agg(F.collect_set("h").alias("found"))
    windows = (texts.join(found, "k1").select("k1", "k2", "text", "found")
               .mapInArrow(_windows(width), "h1 long, h2 long, k1 long, k2 long, start int, sure boolean"))
    return _repeated(windows, ["h1", "h2"], ["k1", "k2", "start"]).select("k1", "k2", "start")


def _cleared(width):
    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, text, places in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                                            batch.column("text"), batch.column("places")):
                starts = [p["start"] for p in places.as_py() if p["k2"] == k2]
                if starts:
                    out.append((k1, k2, *Words(text.as_py()).without(starts, width)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["k1", "k2", "n_removed", "kept_sha256"])
    return run


def removed(docs: DataFrame, key="doc_id", text="text", width=WIDTH) -> DataFrame:
    """`key`, n_words, n_removed, kept_sha256 (of the kept words, joined by single blanks) of every row."""
    if width < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ids = stored(rows.mapInArrow(_described, f"key {kind}, n_words long, sha string, k1 long, k2 long"), "described")
    texts = distinct_texts(rows.select("text"), width)
    places = repeated_windows(texts, width).groupBy("k1").agg(F.collect_set(F.struct("k2", "start")).alias("places"))
    cleared = texts.join(places, "k1").select("k1", "k2", "text", "places").mapInArrow(
        _cleared(width), "k1 long, k2 long, n_removed long, kept_sha256 string")
    copies = (ids.where(F.col("n_words") >= width).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
              .where("copies > 1"))
    of_text = cleared.withColumn("copies", F.lit(1).cast("long")).unionByName(
        copies.select("k1", "k2", F.lit(0).cast("long").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"), "copies"))
    of_text = of_text.groupBy("k1", "k2").agg(F.max("n_removed").alias("n_removed"), F.max("copies").alias("copies"),
                                              F.max(F.when(F.col("copies") == 1, F.col("kept_sha256"))).alias("kept_sha256"))
    of_text = stored(of_text, "of_text")  # so that the join below may split a text that very many documents have
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    return ids.join(of_text, ["k1", "k2"], "left").select(
        F.col("key").alias(key), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
