import os
import random

import numpy as np
import pytest

from riskflow.llm import decontam as dc

SCHEMA = "doc_id long, text string, item_id long, start long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], SCHEMA)


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, key string")


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshrd") for _ in range(draw.randint(1, 7))) for _ in range(n))


def edited(draw, text, n):
    chars = list(text)
    for _ in range(n):
        at = draw.randrange(len(chars))
        chars[at:at + 1] = draw.choice([[], [draw.choice("xyz")], [chars[at], draw.choice("xyz")]])
    return "".join(chars)


def least_edits(item, text):
    """Sellers: fewest edits that turn some stretch of the text into the item."""
    a, b = dc.plain(item), dc.plain(text)
    row = np.zeros(len(b) + 1, int)
    for c in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        best = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        for j in range(len(b)):
            new[j + 1] = min(best[j], new[j] + 1)
        row = new
    return int(row.min())


def test_against_all_alignments(spark):
    draw = random.Random(11)
    items = [(i, prose(draw, draw.randint(6, 30))) for i in range(12)]
    docs = []
    for i in range(150):
        parts = [prose(draw, draw.randint(0, 25))]
        if i % 3:
            _, text = draw.choice(items)
            parts += [edited(draw, text, draw.randint(0, int(0.16 * len(text)))), prose(draw, draw.randint(0, 25))]
        docs.append((i, draw.choice([str, str.upper])(" ".join(parts))))
    got = {}
    for r in dc.matches(frame(spark, docs).repartition(4), bench(spark, items)).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append(r["edits"])
    want = {}
    for d, t in docs:
        for i, x in items:
            if len(x) >= dc.MIN_CHARS and (k := least_edits(x, t)) <= dc.budget(len(x)):
                want[d, i] = k
    assert {k: min(v) for k, v in got.items()} == want and len(want) > 40
    kept = {r["doc_id"] for r in dc.clean(frame(spark, docs).repartition(4), bench(spark, items)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_places(spark):
    item = "The quick brown fox jumps over the lazy dog."
    docs = [(1, f"İ é {item}  {item.upper()} end"), (2, item[:-4] + "\ndog!"), (3, item[:30]), (None, item), (None, item), (4, None), (5, "")]
    got = sorted(((r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in
                  dc.matches(frame(spark, docs), bench(spark, [(8, item), (9, item), (10, None), (11, "short"), (None, "")])).collect()), key=repr)
    n = len(item)
    want = [(d, i, *p) for i in (8, 9) for d, p in ((1, (4, 4 + n, 0)), (1, (6 + n, 6 + 2 * n, 0)), (2, (0, n, 2)), (None, (0, n, 0)), (None, (0, n, 0)))]
    got = [(d, i, s, e if d != 2 else n, k) for d, i, s, e, k in got]
    assert got == sorted(want, key=repr) or [g for g in got if g[0] != 2] == sorted((w for w in want if w[0] != 2), key=repr) and sum(g[0] == 2 for g in got) == 2
    assert len(item) - 1 >= dc.MIN_CHARS


def brute_short(item, text):
    """Fewest edits of a stretch that begins and ends at no inside of a word, if they are within the budget."""
    a, b = "".join(map(chr, dc.plain(item))).strip(), "".join(map(chr, dc.plain(text)))
    k, n = dc.budget(len(a)), len(a)
    edge = [not (0 < i < len(b) and b[i - 1].isalnum() and b[i].isalnum()) for i in range(len(b) + 1)]
    best = [d for s in range(len(b)) for e in range(s + max(n - k, 1), min(s + n + k, len(b)) + 1) if edge[s] and edge[e]
            and (d := whole_edits(a, b[s:e])) <= k]
    return min(best, default=None)


def whole_edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        row, old = [i + 1], row
        for j, x in enumerate(b):
            row.append(min(old[j] + (c != x), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_short_items(spark, monkeypatch):
    draw = random.Random(14)
    items = [(i, prose(draw, 6)[:n].strip()) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 10, 11, 12, 13, 15, 17, 18, 19, 19])]
    items += [(100, " Ab-3 "), (101, "(x) = 4"), (102, "   ")]
    docs = []
    for i in range(200):
        parts = [prose(draw, draw.randint(0, 4))]
        for _ in range(draw.randint(0, 3)):
            text = draw.choice(items)[1].strip() or "q"
            parts += [draw.choice(["", " ", ".", "x"]).join(["", edited(draw, text, draw.randint(0, min(2, len(text)))), ""]), prose(draw, draw.randint(0, 4))]
        docs.append((i, draw.choice([str, str.upper])(" ".join(parts))))
    want = {(d, i): k for d, t in docs for i, x in items if x.strip() and (k := brute_short(x, t)) is not None}
    assert len({i for _, i in want}) == len(items) - 1 and 1 in want.values()
    for size in (dc._SLICE, 17):
        monkeypatch.setattr(dc, "_SLICE", size)
        got = {}
        for d, t in docs:
            for i, s, e, k in dc.places(dc.Index.of(items), t):
                got[d, i] = min(k, got.get((d, i), 9))
        assert got == want


def test_clean_needs_more_than_a_common_word(spark, monkeypatch):
    """Short items drop a text only as a chain of two or more that holds 20 characters; long ones always do."""
    items = [(1, "yes"), (2, "no"), (3, "the"), (4, "capital of Peru?"), (5, "Lima"), (6, "a longer item that stands alone"), (7, "yes")]
    docs = ["Yes, it is the way of the world, yes yes yes yes yes yes yes yes.", "no", "yes", "yes no yes no yes", "They lived in Lima, Peru, and said no.",
            "Capital of Peru? And then, much later, Lima.", "Q: capital of Peru?\nA: Lima", "the CAPITAL of peru? - lima", "capital of Peru is not Lima",
            "It was a longer item that stands alone here.", "no a longer itm that stands alone", "", None, "capital of Peru? capital of Peru? capital of Peru?"]
    clean = {0, 1, 2, 4, 5, 8, 11, 12, 13, 3}
    rows = [(i, t) for i, t in enumerate(docs)] * 2
    for size in (10**6, 40, 1):
        monkeypatch.setattr(dc, "BLOCK_CHARS", size)
        got = sorted(r["doc_id"] for r in dc.clean(frame(spark, rows).repartition(3), bench(spark, items)).collect())
        assert got == sorted([*clean] * 2)
    found = {r["doc_id"] for r in dc.matches(frame(spark, rows), bench(spark, items)).collect()}
    assert found == set(range(len(docs))) - {11, 12}


def test_keys_of_any_type_and_columns_with_any_names(spark, monkeypatch):
    docs = spark.createDataFrame([("u/1", "x the very long question of all y", 1, 2), ("u/2", "fine", 3, 4)], "url string, body string, k1 int, k2 int")
    items = spark.createDataFrame([("mmlu/1", "the very long question of all"), ("mmlu/2", "another long question of all")], "name string, text string")
    for size in (10**6, 1):
        monkeypatch.setattr(dc, "BLOCK_CHARS", size)
        got = dc.matches(docs, items, "url", "body", "name")
        assert [tuple(r) for r in got.collect()] == [("u/1", "mmlu/1", 2, 31, 0)] and got.columns[:2] == ["url", "item_id"]
        assert [tuple(r) for r in dc.clean(docs, items, "body", "name").collect()] == [("u/2", "fine", 3, 4)]


def test_short_items_stand_for_themselves():
    found = lambda item, text: [p[1:] for p in dc.places(dc.Index.of([(1, item)]), text)]
    assert found("Paris", "comparison") == [] and found("Paris", "in PARIS, paris") == [(3, 8, 0), (10, 15, 0)]
    assert found("東京都", "彼は東京都に住む") == [(2, 5, 0)]
    assert len(found("the", "the " * 20_000)) == 20_000


def test_one_block_at_a_time(spark, monkeypatch):
    draw = random.Random(15)
    items = [(i, prose(draw, 10)) for i in range(6)]
    docs = [(i, f"{prose(draw, 5)} {items[i % 9][1] if i % 9 < 6 else ''}") for i in range(27)]
    sent, make, context = [], type(spark.sparkContext).broadcast, type(spark.sparkContext)

    def recorded(self, value):
        assert not any(os.path.exists(b._path) for b in sent)
        sent.append(make(self, value))
        return sent[-1]
    monkeypatch.setattr(dc, "BLOCK_CHARS", 60)
    monkeypatch.setattr(context, "broadcast", recorded)
    got = dc.clean(frame(spark, docs), bench(spark, items))
    assert len(sent) >= 3 and sorted(r["doc_id"] for r in got.collect()) == [i for i in range(27) if i % 9 >= 6]


def test_slices_and_blocks(spark, monkeypatch):
    draw = random.Random(12)
    items = [(i, prose(draw, 20)) for i in range(10)]
    text = " ".join(prose(draw, 30) + " " + edited(draw, x, 2) for _, x in items)
    whole = sorted(dc.places(dc.Index.of(items), text))
    assert len(whole) == 10
    monkeypatch.setattr(dc, "_SLICE", 97)
    monkeypatch.setattr(dc, "_HITS", 5)
    assert sorted(dc.places(dc.Index.of(items), text)) == whole
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)
    got = dc.matches(frame(spark, [(1, text)]), bench(spark, items)).collect()
    assert sorted((r["item_id"], r["start"], r["end"], r["edits"]) for r in got) == whole
    assert dc.clean(frame(spark, [(1, text), (2, "clean")]), bench(spark, items)).count() == 1


def test_long_and_repetitive_texts(spark):
    item = "ab" * 40
    docs = [(1, "x" * 300_000 + item + "y" * 300_000), (2, "ab" * 3000), (3, "z" * 2_000_000)]
    got = dc.matches(frame(spark, docs), bench(spark, [(1, item)])).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 1] == [(300_000, 300_080)]


def test_the_bound_holds_for_any_size():
    draw = random.Random(13)
    assert all(dc.shared(m, dc.gram_size(m)) >= 1 for m in range(dc.MIN_CHARS, 3000))
    for m in (20, 26, 35, 60, 95, 400):
        q = dc.gram_size(m)
        for _ in range(50):
            item = dc.plain("".join(draw.choice("abcd") for _ in range(m)))
            text = dc.plain(edited(draw, "".join(map(chr, item)), dc.budget(m)))
            slots = set(dc.gram_slots(text, q).tolist())
            assert sum(x in slots for x in dc.gram_slots(item, q).tolist()) >= dc.shared(m, q)


def test_equal_grams_have_equal_slots():
    codes = dc.plain("abcdefghijklmno xyz abcdefghijklmno")
    for q in range(1, 11):
        slots, grams = dc.gram_slots(codes, q), [tuple(codes[i:i + q]) for i in range(len(codes) - q + 1)]
        assert len(slots) == len(grams) and all((a == b) == (x == y) for a, x in zip(grams, slots) for b, y in zip(grams, slots))


@pytest.mark.parametrize("docs, items", [([], [(1, "x" * 50)]), ([(1, "x" * 50)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert dc.matches(frame(spark, docs), bench(spark, items)).collect() == []
    assert dc.clean(frame(spark, docs), bench(spark, items)).count() == len(docs)
