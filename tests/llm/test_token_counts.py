import math
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex

from riskflow.llm import token_counts as tc

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def scores():
    found = {}

    def walk(node, word):
        for b, child in node.items():
            if b == -1:
                found[bytes(word)] = child
            else:
                walk(child, word + [b])
    walk(tc.vocabulary(PATH), [])
    return found


def brute(scores, word):
    data = word.encode()
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(data)
    for end in range(1, len(data) + 1):
        for at in range(max(0, end - 130), end):
            own = scores.get(data[at:end])
            if own is not None:
                s, n = best[at][0] + own, best[at][1] + 1
                if s > best[end][0] or s == best[end][0] and n < best[end][1]:
                    best[end] = (s, n)
    return best[-1][1]


def texts(spark, folder="/root/testdata/sf0.001", n=60):
    return [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(n).select("text").collect()]


def test_vocabulary_has_every_byte(scores):
    assert len(scores) == 50_256 and all(bytes([b]) in scores for b in range(256))


def test_counts_against_brute_force(spark, scores):
    words = {w for t in texts(spark) for w in regex.findall(PATTERN, t)}
    words |= {"a", " the", "aaaaaaaa", "é", "😀😀", "the" * 100, "", " " * 300, "antidisestablishment", "antidisestablished"}
    got = tc.counts(tc.vocabulary(PATH), words)
    assert got == {w: brute(scores, w) for w in words}


def test_shared_prefixes_are_scored_once(monkeypatch):
    calls = []
    real = tc.extended
    monkeypatch.setattr(tc, "extended", lambda *a: calls.append(1) or real(*a))
    tc.counts(tc.vocabulary(PATH), ["prefix", "prefixes", "prefixed", "prefix"])
    assert len(calls) == len("prefix") + len("es") + len("d")


def test_rows(spark, scores):
    own = ["", None, "a", "the the\n\n  x", "z" * 5000, "word " * 40_000, "a"]
    rows = [(i if i != 2 else None, t, 1, "k") for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, key string")
    got = sorted(map(tuple, tc.token_counts(df.repartition(3), PATH, PATTERN).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words = regex.findall(PATTERN, t or "")
        each = {w: brute(scores, w) for w in set(words)}
        want.append((i, len(words), sum(each[w] for w in words)))
    assert got == sorted(want, key=repr)


def test_forgetting_changes_nothing(monkeypatch, spark):
    batch = pa.RecordBatch.from_pydict({"key": list(range(40)), "text": texts(spark, n=40)})
    plain = list(tc._count(PATH, PATTERN)([batch, batch]))
    monkeypatch.setattr(tc, "KNOWN", 10)
    monkeypatch.setattr(tc, "RUN", 50)
    monkeypatch.setattr(tc, "LONG", 6)
    assert list(tc._count(PATH, PATTERN)([batch, batch])) == plain


def test_unknown_bytes_cost_a_token():
    root = {97: {-1: -1.0}}
    assert tc.counts(root, ["ab", "aa"]) == {"ab": 2, "aa": 2}


def test_random_vocabularies():
    draw = random.Random(1)
    for _ in range(20):
        scores = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 4))).encode(): -draw.random() for _ in range(8)} | {b"a": -3.0, b"b": -3.0}
        root = {}
        for token, s in scores.items():
            node = root
            for b in token:
                node = node.setdefault(b, {})
            node[-1] = s
        words = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 12))) for _ in range(30)}
        assert tc.counts(root, words) == {w: brute(scores, w) for w in words}


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
