import zlib

import numpy as np
import pytest

from riskflow.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string, key string"
WORDS = {"en": "the house and that thing which was there with all the other things of this shore",
         "de": "das haus und die sache welche dort war mit allen anderen dingen an diesem ufer",
         "fr": "la maison et la chose qui était là avec toutes les autres choses de cette rive"}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, "p", "k") for i, t, g in rows], SCHEMA)


def labelled(n=60):
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        words = WORDS[lang].split()
        rows.append((i, " ".join(words[i % 5:] + words[:i % 7]).capitalize() + ".", lang))
    return rows


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("folder, least", [("sf0.001", 0.97), ("sf0.01", 0.985)])
def test_held_out_accuracy(spark, folder, least):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["lang"] is not None}
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    unseen = [i for i in truth if held_out(i)]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in unseen]) >= least


def test_rules(spark):
    rows = labelled() + [(900, None, "en"), (901, "", "en"), (902, "12 ... 34²_!?", "de"), (903, "ª中文", None), (None, WORDS["de"], "xx"),
                         (905, WORDS["fr"].upper(), None), (906, WORDS["en"] + " " + WORDS["en"] * 5000, None), (7, "Das und die", "de"), (7, "Das und die", "de")]
    df = frame(spark, rows).repartition(3)
    model = langid.train(df)
    assert model.languages == ["de", "en", "fr"]  # labels of held-out rows and of rows without text teach nothing
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["held_out"], r["ambiguous"]) for r in langid.identify(df, model).collect()]
    by_id = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i][1:3] == ("und", 0.0) for i in (900, 901, 902)) and by_id[903][1] != "und"
    assert by_id[905][1] == "fr" and by_id[906][1] == "en" and by_id[None][1] == "de" and by_id[None][3]
    for lang in (None, "lang"):
        kept = langid.keep_identified(df, model, lang=lang)
        assert kept.columns == df.columns and kept.count() == len(rows) - 3
    filled = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert filled[905] == "fr" and filled[906] == "en" and filled[None] == "xx" and filled[7] == "de"


def test_an_ambiguous_guess_is_no_label(spark):
    weights = np.zeros((langid.BUCKETS, 1), np.float32)
    weights[np.concatenate(list(langid.grams("la maison")))] = 1
    model = langid.Model(["fr", "xx"], langid.codewords(2), weights, np.ones((2, 1)))
    assert model.predict("xyz 77")[2] and not model.predict("la maison")[2]
    rows = [(1, "la maison", None), (2, "xyz 77", None), (3, "xyz 77", "en"), (4, "12", None)]
    kept = {r["doc_id"]: r["lang"] for r in langid.keep_identified(frame(spark, rows), model, lang="lang").collect()}
    assert kept == {1: "fr", 2: None, 3: "en"}


def test_order_and_partitions_do_not_matter(spark):
    rows = labelled(90)
    a, b = langid.train(frame(spark, rows)), langid.train(frame(spark, rows[::-1]).repartition(7))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.trust, b.trust)


def test_the_bound_on_training_rows(spark):
    rows = labelled(600)
    whole, few = langid.train(frame(spark, rows)), langid.train(frame(spark, rows), rows_per_language=20)
    assert not np.array_equal(whole.weights, few.weights)
    got = langid.identify(frame(spark, rows), few).collect()
    truth = {i: g for i, _, g in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.95


@pytest.mark.parametrize("rows, languages", [([], []), ([(1, "a b", None)], []), ([(i, "a b", "en") for i in range(9)], ["en"])])
def test_little_to_learn_from(spark, rows, languages):
    model = langid.train(frame(spark, rows))
    got = langid.identify(frame(spark, rows + [(50, "some text", None)]), model).collect()
    assert model.languages == languages
    assert {(r["lang_pred"], r["score"]) for r in got} == ({("und", 0.0)} if not languages else {("en", 1.0)})
    assert langid.keep_identified(frame(spark, rows + [(51, "3.", None)]), model).count() == len(rows)


def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = langid.codewords(n).astype(int)
        apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 4) and (np.abs(code.sum(0)) < n).all()


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, 7)), np.ones(code.shape))
    for i in range(4):
        for wrong in range(7):
            margins = code[i].astype(float)
            margins[wrong] *= -1
            assert model.losses(margins).argmin() == i


def test_slices_of_long_texts_count_every_run(monkeypatch):
    text = "Ein längerer Text, der über die Grenze reicht " * 20
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "_SLICE", 50)
    assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), whole)
    assert len(whole) == sum(len(f" {text.lower()} ".encode()) - n + 1 for n in langid.LENGTHS)


def test_repeated_rows_and_keys_neither_fill_the_sample_nor_empty_it(spark):
    """A language whose rows all have one key, or one text, is learned, from no more rows than the bound."""
    draw = np.random.default_rng(3)
    words = WORDS["en"].split()
    key = next(i for i in range(99) if not held_out(i))
    same = [(key, " ".join(draw.permutation(words)), "en") for _ in range(3000)]
    rows = [r for r in labelled(300) if r[2] == "fr"] + same + [(i, WORDS["de"], "de") for i in range(3000)]
    model = langid.train(frame(spark, rows).repartition(4), rows_per_language=500)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(frame(spark, [(1, WORDS["en"], None), (2, WORDS["de"], None), (3, WORDS["fr"], None)]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", 2: "de", 3: "fr"}
    few = langid.train(frame(spark, rows), max_languages=2)
    assert few.languages == ["en", "fr"]  # by different texts


def test_against_a_decoding_in_plain_python(spark):
    """Counts, bit weights, trust and loss-weighted decoding, written out."""
    import math
    from collections import Counter
    rows = labelled(120)
    seen = {(g, t) for i, t, g in rows if not held_out(i)}

    def runs(text):
        b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in f" {text.lower()} ".encode()]
        for n in (2, 3, 4):
            for i in range(len(b) - n + 1):
                code = 0
                for x in b[i:i + n]:
                    code = (code << 8 | x) % 2**32
                yield (code * 0x9E3779B1 % 2**32 >> 17) + ((n - 2) << 15)

    langs, counts = sorted(WORDS), {g: Counter() for g in WORDS}
    for g, t in seen:
        counts[g].update(runs(t))
    n_buckets = 3 << 15
    freq = {g: lambda k, g=g, total=sum(counts[g].values()) + 0.5 * n_buckets: (counts[g][k] + 0.5) / total for g in langs}
    code = {g: [1 if c >> i & 1 else -1 for c in range(1, 4)] for i, g in enumerate(langs)}

    def margins(text):
        ks = list(runs(text))
        out = []
        for bit in range(3):
            one, zero = ([g for g in langs if code[g][bit] == side] for side in (1, -1))
            mean = lambda gs, k: sum(freq[g](k) for g in gs) / len(gs)
            out.append(sum(math.log(mean(one, k)) - math.log(mean(zero, k)) for k in ks) / len(ks))
        return out

    trust = {}
    for g in langs:
        own = [margins(t) for h, t in seen if h == g]
        right = [(sum(m[b] * code[g][b] > 0 for m in own) + 1) / (len(own) + 2) for b in range(3)]
        trust[g] = [x / (sum(right) / 3) for x in right]
    model = langid.train(frame(spark, rows))
    for text in [t for _, t, _ in rows[:12]] + ["das house et la", "thing maison", "Ünder thé", "x"]:
        m = margins(text)
        loss = [sum(t * math.log1p(math.exp(-4 * c * x)) for t, c, x in zip(trust[g], code[g], m)) for g in langs]
        best = loss.index(min(loss))
        lang, score, unsure = model.predict(text)
        assert lang == langs[best] and abs(score - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-4
        assert unsure == (sorted(loss)[1] - loss[best] < 0.5)


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("a/1", WORDS["en"], "en"), ("b", WORDS["fr"], "fr"), (None, "x", None)], "url string, text string, lang string")
    got = langid.identify(docs, langid.train(docs, "url"), "url").collect()
    assert {r["url"] for r in got} == {"a/1", "b", None}
