"""Benchmark decontamination by the q-gram lemma.

If a stretch of a document turns into a benchmark item of m characters with at most k edits, the two share at least
m - q + 1 - k*q of the item's q-grams, on diagonals (document position less item position) that lie within k of each other. So the
q-grams of an item are looked up in a document, counted in overlapping bands of diagonals (k + 1 apart, twice as wide,
so that one band has them all), bands that reach the bound are kept, and a banded alignment of the whole
item decides. The edit budget is `ERRORS` of the item's characters; q is the largest for which the bound still says something.

Texts are compared in lower case with every white-space character as a blank. An item of fewer than `MIN_CHARS` characters stands
in many texts as a part of other words, so it is found where it stands as words of its own: neither end of the stretch, which may
differ by the same edit budget (0 or 1), lies inside a word. Scripts that are written without blanks have an end at every character.
Blanks at the ends of a short item do not count.

`matches` reports every place. `clean` drops a text only on evidence that chance does not give: a place of an item of `MIN_CHARS` characters
or more, or places of different short items at most `GAP` characters apart that hold `MIN_CHARS` characters together, each item counted
once, and of which one holds half of that, as a short question and its answer do. Common words, however often, drop nothing.

Rules: null and empty texts match nothing; items with equal texts are all reported; an
item that occurs several times in a document gives a row per place (of overlapping places, the one with the fewest edits); repeated documents are
rows of their own; other columns are kept by `clean` and ignored by `matches`; without documents or items there are no matches.

The items are handed out in blocks of about `BLOCK_CHARS` characters, a bounded broadcast; every block is a pass over all
documents. Of several blocks, each but the last of `matches` runs at once and its result is stored; its broadcast is gone before the next is
made. `clean` filters in place where there is one block; of several, it stores what each found in a text under the text's 128-bit
key, puts the places of all blocks together and drops the texts in one join. Long texts are searched in slices that overlap
by more than an item. Keys may be of any type.
"""

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import free, stored

ERRORS, MIN_CHARS, GAP = 0.1, 20, 12
GRAM_SIZES = (1, 4, 6, 8)
BLOCK_CHARS = 1_000_000
_SLICE, _HITS = 1 << 20, 1 << 21
_TABLE_BITS = 20
_START = 1 << 32  # an alignment's cost is edits * _START + its first column
#: Scripts without blanks between words: Thai and Lao, Tibetan, Burmese, Khmer, Chinese and Japanese.
_UNSPACED = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA4D0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000))


def plain(text: str) -> np.ndarray:
    """Code points in lower case, blanks for white space; one per character of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32).copy()
    codes[((codes >= 9) & (codes <= 13)) | (codes == 0x85) | (codes == 0xA0)] = 32
    return codes


def gram_slots(codes: np.ndarray, q: int) -> np.ndarray:
    """A table slot per q-gram; equal q-grams have equal slots, and the few others that share one only add candidates."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.int64)
    size, total = 1, codes  # runs of 1, 2, 4, ... characters, and of q from two runs that overlap or touch
    while size * 2 <= q:
        total = total[:-size] * np.uint32(0x01000193) + total[size:]
        size *= 2
    if size < q:
        total = total[:n] * np.uint32(0x85EBCA6B) + total[q - size:q - size + n]
    return ((total * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)).astype(np.int64)


def budget(m: int) -> int:
    return int(m * ERRORS)


def shared(m: int, q: int) -> int:
    """q-grams that survive the edit budget."""
    return m - q + 1 - budget(m) * q


def gram_size(m: int) -> int:
    """The largest q that leaves at least four q-grams to share; for short items, one."""
    if m < MIN_CHARS:
        return min(max(GRAM_SIZES), m // (budget(m) + 1))
    return max(q for q in GRAM_SIZES if q == 1 or shared(m, q) >= 4)


def align(item: np.ndarray, doc: np.ndarray, low: int, width: int):
    """(edits, start, end) of the best place of the whole item whose diagonals lie in [low, low + width)."""
    at = max(low, 0)
    same = doc[at:low + width + len(item) - 1]
    if len(same) >= len(item):
        exact = np.flatnonzero((sliding_window_view(same, len(item)) == item).all(1))
        if len(exact):
            return 0, at + int(exact[0]), at + int(exact[0]) + len(item)
    k = budget(len(item)) * _START + _START
    column = np.arange(width, dtype=np.int64)
    # a cell holds the cost after r characters of the item at document position low + r + column
    pad = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)
    begin, end = max(low, 0), min(low + len(item) + width, len(doc))
    if begin < end:
        pad[begin - low:end - low] = doc[begin:end]
    row = column + (low if low > 0 else 0)
    if low <= 0:
        row = np.where(column + low < 0, np.int64(2**62), column + low)
    row = np.where(column + low > len(doc), np.int64(2**62), row)
    for r, c in enumerate(item):
        down = np.append(row[1:], np.int64(2**62)) + _START
        new = np.minimum(row + np.where(pad[r:r + width] == c, 0, _START), down)
        shift = column * _START
        row = np.minimum.accumulate(new - shift) + shift
        if row.min() >= k:
            return None
    at = int(row.argmin())
    cost = int(row[at])
    return (cost // _START, cost % _START, low + len(item) + at) if cost < k else None


def word_ends(codes: np.ndarray) -> np.ndarray:
    """For each position from 0 to the length: whether it does not lie between two characters of one word."""
    kinds, of = np.unique(codes, return_inverse=True)
    word = np.array([chr(c).isalnum() and not any(a <= c < b for a, b in _UNSPACED) for c in kinds.tolist()], bool)[of]
    out = np.ones(len(codes) + 1, bool)
    out[1:-1] = ~(word[1:] & word[:-1])
    return out


def few_edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edits between two texts whose lengths differ by one at most; 2 stands for more than one."""
    if len(a) == len(b):
        return min(int((a != b).sum()), 2)
    if len(a) < len(b):
        a, b = b, a
    at = int(np.append(np.flatnonzero(a[:-1] != b), len(b))[0])
    return 1 if (a[at + 1:] == b[at:]).all() else 2


def apart(found) -> list:
    """(item, start, end, edits) of (edits, start, end, item): of overlapping places of an item, the one with the fewest edits."""
    kept = {}
    for edits, start, end, item in sorted(found):
        own = kept.setdefault(item, [])
        at = bisect_left(own, (start,))
        if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or own[at][0] >= end):
            own.insert(at, (start, end, edits))
    return [(item, *place) for item in sorted(kept) for place in kept[item]]


@dataclass
class Index:
    """Items of one block with one gram size, and where their q-grams are: those of slot i are first[i]:first[i + 1]."""

    ids: list
    texts: list        # code points
    q: int
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray     # position in the item

    def __post_init__(self):
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.step = np.array([budget(int(m)) + 1 for m in self.sizes], np.int64)
        self.needed = np.array([shared(int(m), self.q) for m in self.sizes], np.int64)
        self.longest = int(self.sizes.max(initial=0) * 2 + 8)
        self.known = np.diff(self.first) > 0

    @staticmethod
    def of(rows):
        """Indexes of the items, one per gram size, those of short items apart."""
        rows = [(i, plain(t)) for i, t in rows]
        rows = [(i, t if len(t) >= MIN_CHARS else plain("".join(map(chr, t)).strip(" "))) for i, t in rows]
        kinds = {}
        for i, t in rows:
            if len(t):
                kinds.setdefault((ShortIndex if len(t) < MIN_CHARS else Index, gram_size(len(t))), []).append((i, t))
        return [kind._of(own, q) for (kind, q), own in sorted(kinds.items(), key=lambda x: (x[0][0].__name__, x[0][1]))]

    @classmethod
    def _of(cls, rows, q):
        ids, texts = [i for i, _ in rows], [t for _, t in rows]
        slots = [gram_slots(t, q) for t in texts]
        all_slots = np.concatenate(slots)
        order = np.argsort(all_slots, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(all_slots, minlength=1 << _TABLE_BITS))]).astype(np.int32)
        item = np.repeat(np.arange(len(slots)), [len(x) for x in slots])[order]
        return cls(ids, texts, q, first, item, np.concatenate([np.arange(len(x)) for x in slots])[order])

    def hits(self, codes: np.ndarray):
        """Runs of bounded size of (item, document position, item position) of the q-grams that both have."""
        slots = gram_slots(codes, self.q)
        where = np.flatnonzero(self.known[slots])
        first = self.first[slots[where]].astype(np.int64)
        n = self.first[slots[where] + 1] - first
        upto, at = np.cumsum(n), 0
        while at < len(where):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + _HITS)))
            own = n[at:end]
            post = np.repeat(first[at:end] - (upto[at:end] - own - done), own) + np.arange(own.sum())
            yield self.item[post], np.repeat(where[at:end], own), self.at[post]
            at = end

    def bands(self, codes: np.ndarray):
        """(item, band) pairs with enough shared q-grams; a band reaches from its number over two steps of diagonals."""
        parts = []
        for item, i, j in self.hits(codes):
            diagonal = i - j + self.longest
            parts.append((*np.unique(item << 40 | diagonal // self.step[item], return_counts=True), item, diagonal, j))
        if not parts:
            return []
        keys, counts = parts[0][:2]
        if len(parts) > 1:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
        both = counts.copy()
        both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)  # a band and the next step
        found = [(int(k >> 40), int(k & (1 << 40) - 1)) for k in keys[both >= self.needed[keys >> 40]]]
        if len(parts) > 1:
            return found
        _, _, item, diagonal, j = parts[0]
        return [(t, b) for t, b in found if self._distinct(item, diagonal, j, t, b) >= self.needed[t]]

    def _distinct(self, item, diagonal, j, t, band):
        """Different q-grams of the item in a band: one that the document repeats counts once."""
        low = band * self.step[t]
        return len(np.unique(j[(item == t) & (diagonal >= low) & (diagonal < low + 2 * self.step[t])]))

    def places(self, whole: np.ndarray):
        """(item, start, end, edits) of the verified places in one text (code points)."""
        found = []
        for at in range(0, len(whole), _SLICE):
            codes = whole[at:at + _SLICE + self.longest]
            for item, band in self.bands(codes):
                step = int(self.step[item])
                # the alignment may leave the band of its q-grams by the edit budget on either side
                place = align(self.texts[item], codes, (band - 1) * step - self.longest, 4 * step)
                if place:
                    found.append((place[0], at + place[1], at + place[2], item))
        return apart(set(found))


class ShortIndex(Index):
    """Items under `MIN_CHARS`: a q-gram that both have names the start but for the edit budget, and every stretch there is compared."""

    def places(self, whole: np.ndarray):
        ends, found = word_ends(whole), set()
        for at in range(0, len(whole), _SLICE):
            for item, i, j in self.hits(whole[at:at + _SLICE + self.longest]):
                for shift in (-1, 0, 1):
                    start = i - j + at + shift
                    ok = (abs(shift) < self.step[item]) & (start >= 0)
                    ok[ok] = ends[start[ok]]
                    for t, s in np.unique(np.stack([item[ok], start[ok]], 1), axis=0).tolist():
                        found.update(self._at(whole, ends, t, s))
        return apart(found)

    def _at(self, whole, ends, t, start):
        text, k = self.texts[t], int(self.step[t]) - 1
        for end in range(start + len(text) - k, min(start + len(text) + k, len(whole)) + 1):
            if end > start and ends[end] and (edits := few_edits(text, whole[start:end])) <= k:
                yield edits, start, end, t


def places(indexes: list, text: str):
    """(item id, start, end, edits) of the verified places of the items in one text."""
    if not text:
        return []
    codes = plain(text)
    return [(index.ids[item], *place) for index in indexes for item, *place in index.places(codes)]


def _blocks(benchmark: DataFrame, key, text):
    """Indexes of the items, block by block, and whether a block is the last; the driver holds one block."""
    rows = benchmark.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.length("text") > 0).toLocalIterator()
    r = next(rows, None)
    while r is not None:
        block, size = [], 0
        while r is not None and size < BLOCK_CHARS:
            block.append((r["key"], r["text"]))
            size += len(r["text"])
            r = next(rows, None)
        yield Index.of(block), r is None


def _passes(benchmark: DataFrame, key, text, run):
    """`run` of every block's broadcast; all results but the last are stored, then their broadcast goes."""
    context = benchmark.sparkSession.sparkContext
    for index, last in _blocks(benchmark, key, text):
        sent = context.broadcast(index)
        del index
        if last:
            yield run(sent)
        else:
            out = stored(run(sent), "decontam_block")
            sent.destroy()
            yield out


def _match(sent):
    def run(batches):
        indexes = sent.value
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text")):
                found = places(indexes, text.as_py())
                at += [i] * len(found)
                rows += found
            item, *numbers = list(zip(*rows)) or [()] * 4
            types = batch.column("item_kind").type
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(list(item), types),
                                              *[pa.array(list(c), pa.int64()) for c in numbers]],
                                             names=["key", "item_id", "start", "end", "edits"])
    return run


def matches(docs: DataFrame, benchmark: DataFrame, key="doc_id", text="text", item="item_id", item_text="text") -> DataFrame:
    """`key`, item_id, start, end (code points of the text), edits of every place that holds an item."""
    kinds = [x.dataType.simpleString() for x in (docs.schema[key], benchmark.schema[item])]
    schema = "key {}, item_id {}, start long, end long, edits long".format(*kinds)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(None).cast(kinds[1]).alias("item_kind"))
    found = docs.sparkSession.createDataFrame([], schema)
    for own in _passes(benchmark, item, item_text, lambda sent: rows.mapInArrow(_match(sent), schema)):
        found = found.unionByName(own)
    return found.withColumnRenamed("key", key)


def evidence(found: list) -> bool:
    """Whether the places (item, start, end, edits, long) in a text are more than chance."""
    reach, sizes = 0, {}
    for item, start, end, _, long in sorted(found, key=lambda x: x[1:3]):
        if long:
            return True
        if start > reach + GAP:
            sizes = {}
        sizes[item] = end - start
        reach = max(reach, end)
        if len(sizes) > 1 and sum(sizes.values()) >= MIN_CHARS and 2 * max(sizes.values()) >= MIN_CHARS:
            return True
    return False


def _marked(indexes: list, text: str) -> list:
    """Places in a text as `evidence` takes them; those of a long item end the search."""
    if not text:
        return []
    codes, found = plain(text), []
    for index in sorted(indexes, key=lambda x: isinstance(x, ShortIndex)):
        short = isinstance(index, ShortIndex)
        own = [("".join(map(chr, index.texts[i])), *place, not short) for i, *place in index.places(codes)]
        if own and not short:
            return own[:1]
        found += own
    return found


def _clean(sent, text):
    def run(batches):
        indexes = sent.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(text).cast(pa.string())]
            yield batch.filter(pa.array([not evidence(_marked(indexes, t)) for t in texts], pa.bool_()))
    return run


_FOUND = "k1 long, k2 long, item string, start long, end long, edits long, long boolean"


def _hits(sent):
    def run(batches):
        indexes = sent.value
        for batch in batches:
            rows = [(k1, k2, *place) for k1, k2, t in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2")], batch.column("text"))
                    for place in _marked(indexes, t.as_py())]
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             names=["k1", "k2", "item", "start", "end", "edits", "long"])
    return run


def _guilty(batches):
    for batch in batches:
        keep = [evidence([(p["item"], p["start"], p["end"], p["edits"], p["long"]) for p in found])
                for found in batch.column("places").to_pylist()]
        yield batch.select(["k1", "k2"]).filter(pa.array(keep, pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame, text="text", item="item_id", item_text="text") -> DataFrame:
    """`docs` without the rows whose text holds an item beyond chance."""
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item, item_text)
    index, last = next(blocks, (None, True))
    if index is None:
        return docs
    if last:
        return docs.mapInArrow(_clean(context.broadcast(index), text), docs.schema)
    body = F.col(text).cast("string")
    k1, k2 = free(docs, "k1", "k2")
    key = [F.xxhash64(body), F.xxhash64(F.lit(1), body)]
    rows = docs.select(key[0].alias("k1"), key[1].alias("k2"), body.alias("text"))
    found = None
    while index is not None:
        sent = context.broadcast(index)
        own = stored(rows.mapInArrow(_hits(sent), _FOUND).distinct(), "decontam_block")
        sent.destroy()
        found = own if found is None else found.unionByName(own)
        index, _ = next(blocks, (None, True))
    whole = found.where("long").select("k1", "k2")
    short = found.where("NOT long").join(whole, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("item", "start", "end", "edits", "long")).alias("places"))
    bad = whole.unionByName(short.mapInArrow(_guilty, "k1 long, k2 long")).distinct().toDF(k1, k2)
    return (docs.withColumns({k1: key[0], k2: key[1]}).join(bad, [k1, k2], "left_anti").select(*docs.columns))
