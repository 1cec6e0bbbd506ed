import hashlib
import random

import numpy as np
import pytest

from riskflow.llm import sketches as sk

SCHEMA = "doc_id long, text string, fingerprint string, part int, tail boolean, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, True, "k") for i, t in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(draw, n, words=3000):
    return " ".join(f"w{draw.randint(0, words)}" for _ in range(n))


def test_smallest_is_exact():
    draw = np.random.default_rng(1)
    for n, top in ((0, 5), (10, 5), (5000, 2**48), (5000, 40), (50_000, 200)):
        values = draw.integers(0, top, n).astype(np.uint64)
        assert sk.smallest(values, 64).tolist() == sorted(set(values.tolist()))[:64]


def test_estimates():
    draw = random.Random(2)
    for shared in (0, 300, 900, 1000):
        common = prose(draw, shared)
        a, b = common + " " + prose(draw, 1000 - shared), common + " " + prose(draw, 3000 - shared)
        x, y = sk.sketch(a, sk._Hashes()), sk.sketch(b, sk._Hashes())
        s, t = shingles(a), shingles(b)
        assert abs(sk.resemblance(x, y) - len(s & t) / len(s | t)) < 0.12
        assert abs(sk.distinct(x) / len(s) - 1) < 0.3
        assert abs(sk.containment(x, y) - len(s & t) / len(s)) < 0.3


def test_small_texts_are_exact():
    a, b = sk.sketch("A b c d e f", sk._Hashes()), sk.sketch("a b c d e g", sk._Hashes())
    assert sk.distinct(a) == 2 and sk.resemblance(a, b) == pytest.approx(1 / 3) and sk.containment(a, b) == 0.5
    empty = sk.sketch(None, sk._Hashes())
    assert len(empty) == 0 and sk.resemblance(empty, empty) == 1.0 and sk.resemblance(empty, a) == 0.0
    assert sk.containment(empty, a) == 1.0 and len(sk.sketch("two words", sk._Hashes())) == 1


def test_pieces_of_a_long_text_change_nothing():
    text = prose(random.Random(3), 4000)
    from riskflow.llm import words
    whole = sk.sketch(text, sk._Hashes())
    short, words.shingle_lists.__defaults__ = words.shingle_lists.__defaults__, (100,)
    try:
        assert sk.sketch(text, sk._Hashes()).tolist() == whole.tolist()
    finally:
        words.shingle_lists.__defaults__ = short


def test_text_form():
    s = sk.sketch(prose(random.Random(4), 500), sk._Hashes())
    assert sk.from_text(sk.as_text(s)).tolist() == s.tolist() and sk.from_text("").size == 0


def test_merged_parts_equal_the_whole(spark):
    draw = random.Random(6)
    parts = [(i % 7 if i % 7 else None, prose(draw, 200)) for i in range(70)]
    got = {r[0]: r[1] for r in sk.merge_parts(sk.fingerprints(frame(spark, parts).repartition(5))).collect()}
    assert len(got) == 7
    for key in got:
        whole = np.empty(0, np.uint64)
        for k, t in parts:
            if k == key:
                whole = sk.merged(whole, sk.sketch(t, sk._Hashes()))
        assert got[key] == sk.as_text(whole)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        a, e, n = (sk.sketch(x, sk._Hashes()) for x in (t, edited, u))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sk.as_text(a), sk.as_text(e), sk.resemblance(a, e), sk.resemblance(a, n)))
    return sorted(out, key=repr)


def compared(df, **more):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in sk.compare_with_next(df, **more).select(*names).collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_compare_with_next(spark, parts):
    draw = random.Random(7)
    rows = [(draw.randint(-10**12, 10**12), prose(draw, draw.randint(0, 300))) for _ in range(120)]
    rows += [(5, "é" * 9), (5, None), (5, "b c"), (None, "none one"), (None, None), (6, ""), (5, "b c"), (9, prose(draw, 30_000))]
    assert compared(frame(spark, rows).repartition(4), parts=parts) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one row here")], [(None, "x y")], [(None, "x y"), (None, None)], [(1, "a"), (2, "b")]])
def test_few_rows(spark, rows):
    assert compared(frame(spark, rows)) == brute(rows)
