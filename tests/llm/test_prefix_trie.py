import hashlib
import random
from collections import defaultdict

import pytest

from riskflow.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, skeleton int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def brute(rows, ids=()):
    turns = defaultdict(list, {c: [] for c in ids})
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {c: tuple((r, t) for _, _, r, t in sorted(ts)) for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, out = defaultdict(set), []
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(n, seed=1):
    draw, rows = random.Random(seed), []
    for c in range(n):
        kind = draw.random()
        if kind < 0.33:  # one conversation, very often
            rows += [(c, t, "user", f"hot {t}") for t in range(5)]
        elif kind < 0.5:  # all prefixes of one
            rows += [(c, t, "user", f"hot {t}") for t in range(draw.randint(1, 9))]
        else:
            rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice("abü")) for t in range(draw.randint(1, 7))]
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_against_brute_force(spark, shards):
    rows = made(500)
    assert result(pt.trie(frame(spark, rows).repartition(5), shards=shards)) == brute(rows)


def test_nulls_ties_and_conversations_without_turns(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 3)
    # equal turn numbers are ordered by digest: only turns that are equal in role and text tie here
    rows = made(60, 2) + [(100, None, "user", "x"), (100, 0, None, None), (101, 0, "", ""), (102, 1, "us", "er"), (103, 1, "user", ""),
                          (104, 2, "a", "b"), (104, 2, "a", "b"), (None, 0, "user", "nobody"), (-7, 5, "user", "hot 0"), (105, 0, "user", "")]
    ids = [100, 200, 201, -9]
    got = pt.trie(frame(spark, rows), spark.createDataFrame([(i,) for i in ids], "conv_id long"), shards=6)
    assert result(got) == brute(rows, ids)


def test_long_conversations_are_cut_in_the_skeleton(spark, monkeypatch):
    monkeypatch.setattr(pt, "SPLITTER_TURNS", 3)
    rows = [(c, t, "user", "same" if t < 200 else f"{c % 4}") for c in range(30) for t in range(190 + c)]
    rows += [(c + 1000, *r) for c, *r in made(40, 3)]
    assert result(pt.trie(frame(spark, rows), shards=5)) == brute(rows)


def test_other_keys_and_empty_table(spark):
    rows = [("b/1", 0, "user", "x"), ("a/2", 0, "user", "x"), ("c", 0, "user", "y")]
    got = pt.trie(spark.createDataFrame(rows, "id string, n int, who string, said string"), None, "id", "n", "who", "said")
    assert result(got) == brute(rows)
    assert pt.trie(frame(spark, [])).count() == 0


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    own = spark.createDataFrame([(i, "p" if i % 3 else "q") for i in range(1000)], "key long, path_key string").repartition(9)
    want = {k: hashlib.sha256(",".join(str(i) for i in range(1000) if (i % 3 > 0) == (k == "p")).encode()).hexdigest() for k in "pq"}
    assert {r[0]: r[1] for r in pt.ends(own).collect()} == want
