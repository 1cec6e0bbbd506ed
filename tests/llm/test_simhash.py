import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import simhash
from riskflow.llm.components import components

SCHEMA = "doc_id long, text string, fp long, key long, group string, content string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "g", "c") for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Label of each distinct fingerprint by all pairs."""
    of = {f: f for f in fps}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x
    found = sorted(fps)
    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {f: root(f) for f in fps}


def clustered(draw, n, flips=3):
    """Random fingerprints, chains of near ones, and pairs at exactly four and five bits."""
    out = [draw.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        f = draw.choice(out[-20:])
        for _ in range(draw.randint(1, flips + 3)):
            f ^= 1 << draw.randrange(64)
        out.append(f)
    return list(dict.fromkeys(out))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def labels(spark, fps, **more):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(6)
    found = simhash.links(df, **more).toDF("a", "b")
    for a, b in found.collect():
        assert a != b and bin((a ^ b) & 2**64 - 1).count("1") <= 4
    named = {r["node"] % 2**64: r["component"] for r in components(found).collect()}
    return found, named


def partition_of(label):
    groups = {}
    for f, g in label.items():
        groups.setdefault(g, set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "One two  three", "a b c d", "a b c d e f " * 9, "É é x ß \x0b y", "x" * 10_000, "the cat " * 30_000]
    rows = list(enumerate(texts)) + [(None, "a b c d")]
    got = sorted(((r["key"], r["fp"] % 2**64) for r in simhash.fingerprints(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, brute_fingerprint(t)) for i, t in rows), key=repr)


def test_radii():
    assert simhash.radii(4, 3) == [1, 1, 0] and simhash.radii(4, 4) == [1, 0, 0, 0] and simhash.radii(1, 3) == [0, 0, -1]
    assert all(sum(r + 1 for r in simhash.radii(d, m)) > d for d in range(9) for m in range(1, 6))
    assert len(simhash._ball(21, 21, 2)) == 1 + 21 + 210


@pytest.mark.parametrize("block, small", [(20_000, 512), (3, 1)])
def test_links_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash._links, "__defaults__", (7 if small == 1 else 200_000, small))
    fps = clustered(random.Random(block), 600)
    want = brute_groups(fps)
    for cut in simhash.CUTS:
        _, named = labels(spark, fps, cut=cut)
        assert partition_of({f: named.get(f, f) for f in fps}) == partition_of(want)


def test_segments_by_size():
    """Look-ups and chance meetings per fingerprint grow slower than the number of fingerprints, tenfold by tenfold."""
    assert [simhash.keys_per_fingerprint(c) for c in simhash.CUTS] == [[22, 22, 1], [529, 33]]
    sizes = [10**k for k in range(3, 11)]
    assert [len(simhash.segments(n)) for n in sizes] == [3] * 5 + [2] * 3
    each = [simhash.cost(simhash.segments(n), n) for n in sizes]
    assert all(b < 10 * a for a, b in zip(each, each[1:])) and each[-1] < 2000
    assert all(sum(bits for _, bits in cut) == 64 and all(a + b == c for (a, b), (c, _) in zip(cut, cut[1:])) for cut in simhash.CUTS)


def test_dense_group_gives_few_links(spark):
    base = random.Random(9).getrandbits(64)
    fps = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    found, named = labels(spark, sorted(fps))
    assert set(named) == fps and len(set(named.values())) == 1
    assert found.count() < len(fps) * (len(fps) - 1) / 2 / 10


def test_forest_connects_what_all_links_connect():
    draw = np.random.default_rng(4)
    for _ in range(30):
        e, p = (draw.integers(0, 2**9, n, dtype=np.uint64) for n in (60, 90))
        got = simhash.forest(e, p, 1)
        of = {("e", i): i for i in range(60)} | {("p", j): 60 + j for j in range(90)}

        def joined(pairs):
            name = list(range(1024))

            def root(x):
                while name[x] != x:
                    x = name[x]
                return x
            for a, b in pairs:
                name[root(a)] = root(b)
            return [root(x) for x in range(1024)]
        full = joined([(int(a), int(b)) for a in e for b in p if int(a ^ b).bit_count() <= 1])
        few = joined([(int(a), int(b)) for x, y in got for a, b in zip(x, y)])
        assert len(of) == 150 and all((full[a] == full[b]) == (few[a] == few[b]) for a in range(512) for b in range(512) if a < b)


def brute_ids(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = brute_groups(set(fp))
    first = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    return sorted(((i, f"{f:016x}", first.get(label[f])) for (i, _), f in zip(rows, fp)), key=repr)


def corpus():
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randint(0, 500)}" for _ in range(80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(60):
        words = draw.choice(texts).split()
        words[draw.randrange(80)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    return rows + [(200 + i, texts[0]) for i in range(50)] + [(7, None), (300, ""), (301, " "), (None, texts[3]), (None, "lonely words with no id here"), (5, texts[5]), (5, texts[5])]


def test_groups_against_brute_force(spark):
    rows = corpus()
    got = simhash.groups(frame(spark, rows).repartition(5)).select("key", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ids(rows)


def test_deduplicate(spark):
    rows = corpus()
    df = frame(spark, rows).repartition(5)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    label = brute_groups({brute_fingerprint(t) for _, t in rows})
    assert len(kept) == len(set(label.values())) == len({label[brute_fingerprint(t)] for _, t in kept})
    assert set(kept) <= set(rows)
    first = {}
    for i, t in rows:
        g = label[brute_fingerprint(t)]
        first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    assert all((float("inf") if i is None else i) == first[label[brute_fingerprint(t)]] for i, t in kept)


def test_keys_of_any_type_and_columns_with_any_names(spark):
    rows = [("b/2", "one text of five words", 100), ("a/1", "one text of five words", 101), (None, "one text of five words", 102), ("c", "other", 103),
            (None, None, 104), (None, "", 105)]
    names = ["__key", "__none", "__content", "__copy", "own_key", "own_content", "head_key", "head_content", "copy_number", "fp", "group"]
    docs = spark.createDataFrame([(i, t, *[n + 10 * j for j in range(len(names))]) for i, t, n in rows], ["url", "text", *names])
    got = simhash.deduplicate(docs, "url")
    assert got.columns == docs.columns
    kept = {r["url"]: r for r in got.collect()}
    assert set(kept) == {"a/1", "c", None} and got.count() == 3
    assert all(kept["a/1"][n] == 101 + 10 * j for j, n in enumerate(names))


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = simhash.deduplicate(frame(spark, corpus()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange" in line and "own_key" in line for line in plan.splitlines()) == 2  # the texts, and the heads
    above = plan[:plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Window" in above


def test_look_ups_are_never_broadcast(spark):
    """45 rows are made of each fingerprint, which the engine's estimate does not know."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_are_not_broadcast_by_the_size_of_their_files(spark):
    plan = simhash.groups(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    whole = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in whole


def test_empty_table(spark):
    assert simhash.groups(frame(spark, [])).count() == 0 and simhash.deduplicate(frame(spark, [])).count() == 0


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(500)]
    df = spark.createDataFrame(chain + [(b, a) for a, b in star] + [(2000, 2000), (5, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(501)}
