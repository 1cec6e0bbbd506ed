import hashlib
import random
from collections import Counter

import pytest

from riskflow.llm import passages

SCHEMA = "doc_id long, text string, k1 long, h long, text2 string, sure boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", True) for i, t in rows], SCHEMA)


def brute(docs, width=passages.WIDTH):
    """All windows of all rows, counted by their words."""
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=repr)


def test_cover():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


def test_every_shift_and_length(spark):
    """A shared run of 34 words stays, one of 35 or more goes, wherever it starts in either text."""
    draw = random.Random(5)
    rows, n = [], 0
    for shared in (34, 35, 36, 60):
        for a, b in [(0, 0), (0, 1), (3, 20), (20, 3), (7, 13), (11, 40), (21, 42), *[(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(12)]]:
            run = [f"s{n}_{i}" for i in range(shared)]
            for before in (a, b):
                own = [f"d{n}_{len(rows)}_{i}" for i in range(before + 10)]
                rows.append((len(rows), " ".join(own[:before] + run + own[before:])))
            n += 1
    got = result(passages.removed(frame(spark, rows).repartition(6), width=35))
    assert got == brute(rows)
    assert Counter(r[2] for r in got)[0] == 2 * 19 and {r[2] for r in got} == {0, 35, 36, 60}


def test_random_texts(spark):
    """Few words, so that windows share many runs; copies, repeats inside a text, chains, white space of all kinds."""
    draw = random.Random(9)
    blocks = [[draw.choice("a b c d e ü 漢字 . ,".split()) for _ in range(draw.randint(10, 90))] for _ in range(30)]
    rows = []
    for i in range(300):
        words = sum((draw.choice(blocks)[draw.randint(0, 20):draw.randint(25, 90)] for _ in range(draw.randint(0, 5))), [])
        words += [f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 60))]
        rows.append((i, "".join(w + draw.choice([" ", "  ", "\n", "\t\r\n", "\x0b\x0c"]) for w in words)))
    rows += [(i, t) for i, t in rows[:40]] + [(None, rows[3][1]), (None, rows[3][1] + " more"), (1, "x " * 500), (2, None), (3, ""), (4, " \n")]
    rows += [(900 + i, "the same license line " * 9) for i in range(60)]
    assert result(passages.removed(frame(spark, rows).repartition(7), width=35)) == brute(rows)
    assert result(passages.removed(frame(spark, rows).repartition(3), width=25)) == brute(rows, 25)


def test_a_task_that_forgets_finds_the_same(spark, monkeypatch):
    """With memory for three hashes only."""
    known = passages.Combiner(3)
    out = []
    for place, key in enumerate([1, 1, 2, 3, 4, 1, 5, 5, 1]):
        known.add(key, place, out)
    assert [(k, p) for k, p, s in out if s] == [(1, 0), (1, 1), (5, 6), (5, 7), (1, 5), (1, 8)] or Counter(k for k, _, s in out if not s)[1] == 2
    assert {p for _, p, _ in out} == set(range(9))


def test_any_key_and_long_texts(spark):
    long = " ".join(f"u{i}" for i in range(200_000))
    rows = [("a/1", long), ("b", "start " + long[-4000:]), ("c", None)]
    got = {r["id"]: r for r in passages.removed(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert got["a/1"]["n_words"] == 200_000 and 400 < got["a/1"]["n_removed"] < 1000
    assert got["b"]["n_words"] - got["b"]["n_removed"] <= 2 and got["c"]["n_words"] == 0


def test_width_and_empty_table(spark):
    assert passages.removed(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        passages.removed(frame(spark, []), width=20)


def test_texts_are_shuffled_once(spark):
    rows = [(i, " ".join(f"w{(i % 5) * 100 + j}" for j in range(80))) for i in range(50)]
    texts = passages.distinct_texts(frame(spark, rows).selectExpr("CAST(NULL AS STRING) unused", "text").select("text"), 35)
    assert texts.count() == 5
    found = passages.repeated_windows(texts).groupBy("k1").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = texts.join(found, "k1")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(k1") == 2, plan  # what was found, twice
