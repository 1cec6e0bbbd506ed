import random
from collections import Counter

import corpus_pipeline as cp
from riskflow.llm import langid
from riskflow.llm.tables import read, stored
from tests.llm import test_lines, test_packing, test_simhash
from tests.llm.test_queries import FOLDER, contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_brute_force(spark):
    from tokenizers import Tokenizer
    docs = read(spark, FOLDER, "documents")
    items = [tuple(r) for r in read(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    now = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        if name == "best_fit_packing":
            break
        assert docs.columns == COLUMNS
        got = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
        if name == "language_id":
            now = [r for r in now if langid.has_letter(r[1])]
        elif name == "line_dedup":
            now = test_lines.brute_once(now, 0.01, 3)
        elif name == "near_dedup":
            first = {}
            for i, _, component in test_simhash.brute_ids([r[:2] for r in now]):
                first.setdefault(component, i)
            now = [r for r in now if r[0] in first]
        elif name == "decontaminate":
            gone = {i for i, _ in contaminated([r[:2] for r in now], items)}
            assert gone
            now = [r for r in now if r[0] not in gone]
        assert got == sorted(now), name
    t = Tokenizer.from_file(test_packing.PATH)
    test_packing.check([r[:2] for r in now], docs.collect(), lambda x: t.encode(x, add_special_tokens=False).ids)
    assert sorted(map(tuple, cp.run(spark, FOLDER).drop("sequence_id", "offset").collect())) == \
        sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_one_whole_copy_of_every_document_stays(spark):
    """Articles that stand on their site three times or more, exactly or with an edited line, on sites of 100 and 1,000 pages: their
    lines outlast line dedup, and near-dedup keeps one whole text of each."""
    draw, rows, planted = random.Random(21), [], []
    for site, n in (("a", 100), ("b", 1000)):
        pages = [test_lines.article(draw, 6) for _ in range(n - 10)]
        for k, copies in enumerate((3, 7)):
            text = test_lines.article(draw, 120)
            planted.append("\n".join(text))
            pages += [text if k == 0 or c == 0 else [*text[:c * 9], text[c * 9] + " x", *text[c * 9 + 1:]] for c in range(copies)]
        rows += [(len(rows) + i, "\n".join(["menu", *p]), "en", site, 0) for i, p in enumerate(pages)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[1:3]:
        docs = stored(stage(spark, docs, FOLDER), name)
    got = Counter(r["text"] for r in docs.collect())
    assert all(got[t] == 1 for t in planted)
    body = {t.split("\n")[60] for t in planted}
    assert sum(n for t, n in got.items() if body & set(t.split("\n"))) == len(planted)
    assert sum(got.values()) == 90 + 990 + len(planted) and not any("menu" in t for t in got)


def test_stages_keep_other_columns_and_take_any_row(spark):
    """Nulls everywhere, empty and long texts, repeated rows, extra columns with the names that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, score double, bin long, line string"
    rows = [(i, t, g, s, n, 1, "k", 0.5, 2, "l") for i, t, g, s, n in [
        (1, "the house on the hill\nmenu", "en", "a", 26), (1, "the house on the hill\nmenu", "en", "a", 26), (2, None, None, None, None),
        (None, "das haus auf dem berg\nmenu", "de", "a", 5), (None, "das haus auf dem berg\nmenu", "de", None, 5), (3, "", "en", "a", 0),
        (4, "word " * 100_000, None, "b", None), (5, "123 456", "en", "a", 7), (6, "la maison", "fr", "", 9)]]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        if name != "best_fit_packing":
            assert docs.schema.names == spark.createDataFrame(rows[:1], schema).schema.names
            kept[name] = docs.count()
    assert kept == {"language_id": 6, "line_dedup": 6, "near_dedup": 4, "decontaminate": 4}
    assert {r["doc_id"] for r in docs.collect()} == {1, None, 4, 6}


def test_empty_documents(spark):
    docs = read(spark, FOLDER, "documents").where("false")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0
