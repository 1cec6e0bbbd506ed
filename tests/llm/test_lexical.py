import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskflow.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """(place of the item, item, rank, key, score); every document is scored."""
    counts = [(k, Counter(split(t))) for k, t in docs]
    counts = [(k, c, sum(c.values())) for k, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for i, (item, text) in enumerate(items):
        found = []
        for key, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(split(text)) if c[t])
            if s > 0:
                found.append((-s, key is None, key or 0, key))
        out += [(i, item, r + 1, key, -s) for r, (s, _, _, key) in enumerate(sorted(found)[:top])]
    return out


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in docs], "doc_id long, text string, key string, n long, score double"),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, term string"))


def made(seed, n):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcdEé漢" for b in range(12)]
    text = lambda k: "".join(draw.choice(words) + draw.choice([" ", ", ", "\n", "-", "_"]) for _ in range(draw.randint(0, k)))
    docs = [(i, text(draw.choice([3, 30, 200]))) for i in range(n)]
    docs += [(draw.randint(0, n), t) for _, t in docs[:n // 4]] + [(None, docs[1][1]), (None, docs[2][1]), (5, None), (6, ""), (7, "., -")]
    items = [(i, text(draw.choice([2, 10, 90]))) for i in range(25)] + [(3, "b1 b2 b3"), (3, "b1 b2 b3"), (None, "c1"), (30, None), (31, ""), (32, "zzz"),
                                                                        (33, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block", [16, 8192])
def test_against_every_score(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = made(1, 600)
    d, i = frames(spark, docs, items)
    got = result(lexical.search(d.repartition(5), i))
    assert got == sorted((r[1:] for r in brute(docs, items)), key=repr)
    assert result(lexical.search(d, i, top=3)) == sorted((r[1:] for r in brute(docs, items, 3)), key=repr)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 150)
    docs, items = made(2, 100)
    d, i = frames(spark, docs, items)
    assert result(lexical.search(d, i)) == sorted((r[1:] for r in brute(docs, items)), key=repr)


def test_groups_are_left_unscored():
    """A document with rare terms fills the top; the many with common ones only are never scored."""
    n = 4000
    known = [np.array([0])] * n + [np.array([0, 1, 2])] * 20
    block = lexical.Block(pa.array(range(n + 20)), np.full(n + 20, 10), [len(k) for k in known], np.concatenate(known),
                          np.ones(n + 60, np.int64), 3, n + 20, 10 * (n + 20))
    found = []
    scored = lexical.best(block, np.array([0, 1, 2]), np.array([1, 5000, 5000]), found)
    assert scored == 20 and [k for _, k in found] == list(range(n, n + 10))


def test_terms_of_long_texts_in_pieces(monkeypatch):
    text = ("Ab é1 " * 50 + "x" * 100 + " " + "tail, end").encode()
    whole = [t for ts in lexical.terms(text) for t in ts]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(lexical, "_SLICE", size)
        assert [t for ts in lexical.terms(text) for t in ts] == whole
    assert [t.decode() for t in whole] == split(text.decode())


def test_norms_beyond_64_bits():
    assert lexical.norms(np.array([10**8]), 10**11, 10**13)[0] == 10 + 90 * 10**8 * 10**11 // 10**13


def test_keys_of_any_type_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "url string, body string")
    items = spark.createDataFrame([("mmlu/1", "X")], "name string, question string")
    got = lexical.search(docs, items, "url", "body", "name", "question").collect()
    assert [(r["name"], r["rank"], r["url"]) for r in sorted(got, key=lambda r: r["rank"])] == [("mmlu/1", 1, "a"), ("mmlu/1", 2, "b"), ("mmlu/1", 3, None)]
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0
    assert lexical.search(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
