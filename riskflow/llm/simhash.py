"""Near-duplicates by SimHash fingerprints, found with multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and hashed in shingles of `words` words (XXH64, seed
42, repeats included); a text with fewer words is one shingle, one without words has fingerprint zero. A bit of the
fingerprint is 1 if it is set in over half of the hashes. Two texts are linked if their fingerprints differ in at most
`distance` bits; a group is what links reach, and its name is its smallest key.

Search: the 64 bits are cut into segments, three of 21, 21 and 22 bits at first. If two fingerprints differ in at most four
bits, they differ in at most one bit of the first or of the second segment, or not at all in the third: were
there two in each of the first two and one in the third, that would make five. So every fingerprint looks up the small Hamming ball
around its segments (22 + 22 + 1 keys) in the table of all fingerprints' segments, and the full distance decides.
`radii` has the rule for any distance and number of segments.

A look-up in a segment of b bits meets about N / 2^b of N fingerprints by chance, so with 21 bits the comparisons would grow with N squared. Wide
segments meet few but have larger balls: two of 32 bits take 529 + 33 keys. `segments` takes the number of segments with the least of
both, keys plus chance meetings, for N fingerprints: two from about 30 million on, where a look-up of 32 bits meets one in
four billion. Every choice finds the same links; one segment fewer, where that is needed again, would be a scan.

What keeps it whole and bounded: equal fingerprints are one row (a group of copies costs one). Look-ups that meet no
entry end in a join with the number of entries per key, which moves both sides by key at any size. A key with more than `BLOCK` entries is cut into blocks, and all
pairs of blocks are tasks of their own. Inside a block the links are not listed pair by pair: a search from
fingerprint to fingerprint takes each one it reaches out of the rest, so a dense group costs one pass and
yields one link per member. No candidate is dropped.

Rules: a null text is empty; empty texts are linked to each other like any others; repeated rows and keys share a
group if their texts do; a null key has a fingerprint and a group but never names it unless all keys are null; keys may be of any
type that has an order; other columns are ignored and may have any names; an empty table gives an empty result.
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.components import components
from riskflow.llm.tables import free, stored
from riskflow.llm.words import shingle_lists
from riskflow.session import shares

WORDS, DISTANCE, SEED = 4, 4, 42
#: Cuts of the 64 bits: (lowest bit, bits) of every segment.
CUTS = (((0, 21), (21, 21), (42, 22)), ((0, 32), (32, 32)))
BLOCK = 20_000
_RUN = 8192


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64 bits as a signed integer."""
    ones, total, hash64 = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    for found in shingle_lists(text.lower(), words):
        data, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
        m = min(words, len(found))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[:len(found) - m + 1].tolist()
        ends = ends[m - 1:].tolist()
        for at in range(0, len(ends), _RUN):
            raw = b"".join([hash64(data[a:b], SEED) for a, b in zip(starts[at:at + _RUN], ends[at:at + _RUN])])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
            ones += bits.sum(0, dtype=np.int64)
        total += len(ends)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _fingerprints(words):
    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", words) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("content"), pa.array(found, pa.int64())],
                                             names=["key", "content", "fp"])
    return run


def _plain(key, text):
    return F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))


def fingerprints(docs: DataFrame, key="doc_id", text="text", words=WORDS) -> DataFrame:
    """key, content (a hash of the text), fp of every row."""
    k, t = _plain(key, text)
    rows = docs.select(k.alias("key"), F.xxhash64(t).alias("content"), t.alias("text"))
    return rows.mapInArrow(_fingerprints(words), f"key {rows.schema['key'].dataType.simpleString()}, content long, fp long")


def radii(distance: int, segments: int):
    """Bits in which the segments may differ: the radii and one per segment add up to more than `distance`."""
    return [(distance + 1) // segments + (i < (distance + 1) % segments) - 1 for i in range(segments)]


def _signed(m):
    return m - 2**64 if m >= 2**63 else m


def _ball(low, bits, radius):
    """Masks over 64 bits with at most `radius` ones, all within the segment."""
    ball, reached = {0}, {0}
    for _ in range(radius):
        reached = {m ^ (1 << b) for m in reached for b in range(low, low + bits)}
        ball |= reached
    return sorted(ball) if radius >= 0 else []


def keys_per_fingerprint(cut, distance=DISTANCE) -> list:
    """How many keys a fingerprint looks up in each segment."""
    return [sum(comb(bits, k) for k in range(r + 1)) for (_, bits), r in zip(cut, radii(distance, len(cut)))]


def cost(cut, n: int, distance=DISTANCE) -> float:
    """Keys that a fingerprint looks up and fingerprints that it meets by chance among `n`."""
    return sum(k * (1 + n / 2**bits) for k, (_, bits) in zip(keys_per_fingerprint(cut, distance), cut))


def segments(n: int, distance=DISTANCE):
    """The cut with the least cost for `n` different fingerprints."""
    return min(CUTS, key=lambda cut: cost(cut, n, distance))


def _slot(fp, cut, segment, mask=0):
    """The key of one segment of a fingerprint, with the bits of `mask` turned, as one integer for all segments."""
    low, bits = cut[segment]
    value = F.shiftrightunsigned(fp.bitwiseXOR(F.lit(_signed(mask))), low).bitwiseAND(F.lit((1 << bits) - 1))
    return value + F.lit(segment << 40)


def _cells(entries):
    """Tasks of a look-up: one for a key of one block, else entry block i with probe block j.

    Role 0: the row is an entry of the cell, 2: a probe, 1: both.
    """
    blocks = F.ceil(entries / F.lit(BLOCK)).cast("int")
    own_block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    every = F.sequence(F.lit(0), blocks - 1)
    as_entry = F.transform(every, lambda j: cell(own_block, j, F.when(j == own_block, 1).otherwise(0)))
    as_probe = F.transform(every, lambda i: cell(i, own_block, F.lit(2)))
    others = F.filter(as_probe, lambda c: c["i"] != own_block)
    one = F.array(cell(F.lit(0), F.lit(0), F.when(F.col("own"), 1).otherwise(2)))
    return F.when(blocks <= 1, one).when(F.col("own"), F.concat(as_entry, others)).otherwise(as_probe)


def forest(entries: np.ndarray, probes: np.ndarray, distance: int):
    """Links that connect what the links between any entry and any probe connect: one per fingerprint reached."""
    found, sides = [], [entries, probes]
    left = [np.arange(len(entries)), np.arange(len(probes))]
    while len(left[0]) and len(left[1]):
        todo = [(0, left[0][0])]
        left[0] = left[0][1:]
        while todo:
            side, at = todo.pop()
            value, other = sides[side][at], 1 - side
            near = np.bitwise_count(sides[other][left[other]] ^ value) <= distance
            if near.any():
                reached = left[other][near]
                left[other] = left[other][~near]
                found.append((np.full(len(reached), value), sides[other][reached]))
                todo += [(other, x) for x in reached]
    return found


def _links(distance, chunk=200_000, small=512):
    """Rows (key, i, j, role, fp) in that order -> links. Holds the entries of one cell and a chunk of its probes."""

    def of_small(cell, role, fp):
        """All links of many small cells at once."""
        e, p = np.flatnonzero(role <= 1), np.flatnonzero(role >= 1)
        of_p = cell[p]
        start = np.searchsorted(of_p, cell[e])
        n = np.searchsorted(of_p, cell[e], "right") - start
        a = np.repeat(e, n)
        b = p[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        x, y = fp[a], fp[b]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        return [(x[near], y[near])]

    def run(batches):
        held = None  # (id columns, role, fp) of the last cell so far
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            role, fp = batch.column("role").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if held is not None:
                ids, role, fp = (np.concatenate(x) for x in zip(held, (ids, role, fp)))
            if not len(ids):
                continue
            cell = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(1))])
            first = np.searchsorted(cell, cell[-1])  # the last cell may go on in the next batch
            found = done(cell[:first], role[:first], fp[:first])
            held = (ids[first:], role[first:], fp[first:])
            probes = held[1] == 2
            if probes.sum() > chunk:  # all entries are there: these probes can be answered and forgotten
                found += forest(held[2][held[1] <= 1], held[2][held[1] >= 1], distance)
                held = tuple(x[~probes] for x in held)
            yield table(found)
        if held is not None:
            yield table(done(np.zeros(len(held[1]), np.int64), held[1], held[2]))

    def done(cell, role, fp):
        if not len(cell):
            return []
        n = cell[-1] + 1
        work = np.bincount(cell[role <= 1], minlength=n) * np.bincount(cell[role >= 1], minlength=n)
        large = work > small
        found = of_small(*(x[~large[cell]] for x in (cell, role, fp)))
        for c in np.flatnonzero(large):
            at = slice(*np.searchsorted(cell, [c, c + 1]))
            found += forest(fp[at][role[at] <= 1], fp[at][role[at] >= 1], distance)
        return found

    def table(found):
        a = np.concatenate([np.empty(0, np.uint64), *[x for x, _ in found]])
        b = np.concatenate([np.empty(0, np.uint64), *[y for _, y in found]])
        return pa.RecordBatch.from_arrays([pa.array(x[a != b].view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def links(fps: DataFrame, distance=DISTANCE, cut=None) -> DataFrame:
    """a, b: links between different fingerprints of `fps` (column fp, distinct) that connect all that are within
    `distance` bits of each other."""
    fps = stored(fps.select("fp"), "fingerprints")
    cut = cut or segments(fps.count(), distance)
    fps = fps.repartition(2 * shares(fps.sparkSession))  # narrow rows in few files: the keys are made by all tasks
    fp = F.col("fp")
    own = F.array(*[_slot(fp, cut, s) for s in range(len(cut))])
    entries = fps.select(F.explode(own).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
    probe = lambda s, m: F.struct(_slot(fp, cut, s, m).alias("key"), F.lit(m == 0).alias("own"))
    ball = [probe(s, m) for s, (seg, r) in enumerate(zip(cut, radii(distance, len(cut)))) for m in _ball(*seg, r)]
    # the engine takes the look-ups to be as small as the fingerprints that they are made of, and would broadcast them
    met = fps.select("fp", F.inline(F.array(*ball))).hint("merge").join(entries, "key")
    cells = met.select("key", "fp", F.inline(_cells(F.col("entries"))))
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "fp")
    return dealt.mapInArrow(_links(distance), "a long, b long")


def groups(docs: DataFrame, key="doc_id", text="text", words=WORDS, distance=DISTANCE) -> DataFrame:
    """key, content, fp, group (a fingerprint), component_id of every row. `component_id` is the group's smallest key and
    `first_content` the content of its first row, by key (nulls last) and content."""
    rows = stored(fingerprints(docs, key, text, words), "simhash")
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("content").alias("content"))
    nodes = rows.groupBy("fp").agg(F.min(first).alias("first"))
    named = components(links(rows.select("fp").distinct(), distance))
    nodes = nodes.join(named.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group"))
    heads = nodes.groupBy("group").agg(F.min("first").alias("head"))
    of_fp = nodes.join(heads, "group").select("fp", "group", F.col("head.key").alias("component_id"),
                                              F.col("head.content").alias("first_content"))
    return rows.hint("merge").join(of_fp, "fp")  # copies make the stored rows' files far smaller than the rows


def deduplicate(docs: DataFrame, key="doc_id", text="text", words=WORDS, distance=DISTANCE) -> DataFrame:
    """`docs` with one row of each group: that of the smallest key (of equal or null keys, the smallest content hash)."""
    heads = groups(docs, key, text, words, distance).select("component_id", "first_content").distinct()
    own, none, content, copy = free(docs, "own_key", "no_key", "own_content", "copy_number")

    def places(k, c):
        """What names a row, in columns without nulls: the join and the numbering then need one shuffle of the texts."""
        return {own: F.coalesce(k.cast("string"), F.lit("")), none: k.isNull(), content: c}

    heads = heads.select(*[c.alias(n) for n, c in places(F.col("component_id"), F.col("first_content")).items()])
    k, t = _plain(key, text)
    kept = docs.withColumns(places(k, F.xxhash64(t))).join(heads, [own, none, content], "left_semi")
    order = W.partitionBy(own, none, content).orderBy(own)
    return kept.withColumn(copy, F.row_number().over(order)).where(F.col(copy) == 1).select(*docs.columns)
