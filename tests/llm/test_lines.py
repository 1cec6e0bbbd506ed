import random
from collections import Counter

from riskflow.llm import lines
from riskflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, h1 long, site string, pages int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "l", 1, "s", 2) for i, t, s in rows], SCHEMA)


def brute(rows, ratio, least):
    plain = lambda x: x.strip(" \t\r")
    pages, seen = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        seen.update({(s, plain(x)) for x in (t or "").split("\n")} if t is not None else ())
    bad = {k for k, n in seen.items() if k[1] and n >= least and n > pages[k[0]] * ratio}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, plain(x)) not in bad), s) for i, t, s in rows]


def brute_once(rows, ratio, least, share=lines.COPY_SHARE):
    """As `brute`, where pages made of frequent lines that are linked by such lines support a line together; all that is
    linked has one label here, however long the chain."""
    plain = lambda t: {x.strip(" \t\r") for x in t.split("\n")} - {""}
    sites, held = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        held.update((s, x) for x in plain(t or ""))
    above = lambda k, n: n >= least and n > sites[k[0]] * ratio
    pages = {(s, t): {x for x in plain(t or "") if above((s, x), held[s, x])} for _, t, s in rows}
    copies = {k for k, own in pages.items() if own and sum(map(len, own)) >= share * sum(map(len, plain(k[1])))}
    label = {k: i for i, k in enumerate(copies)}
    moved = True
    while moved:
        moved, least_of = False, {}
        for k in copies:
            for x in pages[k]:
                least_of[k[0], x] = min(least_of.get((k[0], x), label[k]), label[k])
        for k in copies:
            low = min(least_of[k[0], x] for x in pages[k])
            moved, label[k] = moved or low < label[k], low
    at = {}
    for k, own in pages.items():
        for x in own:
            at.setdefault((k[0], x), set()).add(label.get(k, k))
    bad = {k for k, of in at.items() if above(k, len(of))}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad), s) for i, t, s in rows]


def result(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        site = draw.choice(["a", "a", "a", "b", None])
        text = "\n".join(draw.choice(["menu", " menu\t", "foot\r", "", f"own {i}", f"some {draw.randint(0, 40)}", "ünï"])
                         for _ in range(draw.randint(0, 12)))
        rows.append((i, draw.choice([text, text, text, None]), site))
    rows += [(None, "menu\nx", "a"), (None, "menu\ny", None), (7, "menu\nx", "a"), (7, "menu\nx", "a"), (8, "", "b")]
    for ratio, least in ((0.1, 3), (0.4, 2)):
        got = lines.drop_boilerplate(frame(spark, rows).repartition(5), max_ratio=ratio, min_pages=least)
        assert got.columns == frame(spark, rows[:1]).columns
        assert result(got) == sorted(brute(rows, ratio, least), key=repr)
    assert any("menu" in (t or "") for _, t, _ in rows)


def test_the_same_line_may_stay_on_another_site(spark):
    rows = [(i, f"banner\ntext {i}", "often") for i in range(10)] + [(100 + i, f"{'banner' if i == 0 else 'x%d' % i}\nz{i}", "rare") for i in range(40)]
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(frame(spark, rows), dropped="gone").collect()}
    assert got[0]["text"] == "text 0" and got[0]["gone"] == 1 and got[0]["n_chars"] == 6
    assert got[100]["text"] == "banner\nz0" and got[100]["gone"] == 0


def test_long_text_and_pages_of_boilerplate(spark):
    rows = [(i, "x", "s") for i in range(5)] + [(9, "\n".join(["x"] * 50_000 + ["y"]), "s")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(frame(spark, rows)).collect()}
    assert got[0] == "" and got[9] == "y"


def test_template_lines_of_a_large_site(spark):
    """Lines on 2, 4 and 9 % of a site's pages go, by default; lines on two pages or on half a percent of them stay."""
    n, shares = 1500, {"menu": 0.09, "foot": 0.04, "note": 0.02}
    rows = [(i, "\n".join([*(x for x, s in shares.items() if i % round(1 / s) == 0), *(["chance"] if i % 200 == 0 else []),
                           *(["twice"] if i < 2 else []), f"own {i}"]), "hot") for i in range(n)]
    rows += [(n + i, f"menu\nown {n + i}" if i < 2 else f"own {n + i}", "small") for i in range(20)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_boilerplate(frame(spark, rows)).collect()}
    count = Counter(x for i, _, s in rows if s == "hot" for x in got[i] if not x.startswith("own"))
    assert count == {"chance": 8, "twice": 2}
    assert sum("menu" in got[n + i] for i in range(20)) == 2
    assert all(f"own {i}" in got[i] for i, _, _ in rows)


def test_query_template_lines(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op2_template_lines"](spark, folder)
    assert result(got) == sorted(brute(rows, 0.01, 3), key=repr)
    assert result(got) != sorted(brute(rows, 0.1, 3), key=repr)


def article(draw, n=40, words=9):
    return [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(words)) for _ in range(n)]


def site_with_copies(draw, n, copies, edits):
    """Rows of a site of n pages with a menu line on every page; two articles stand on it `copies` times, each copy of the second
    with `edits` lines of its own."""
    exact, near = article(draw), article(draw)
    rows = [(i, "\n".join(["menu of the site", *article(draw, 6)])) for i in range(n - 2 * copies)]
    for c in range(copies):
        rows.append((len(rows), "\n".join(["menu of the site", *exact])))
        other = list(near)
        for at in draw.sample(range(40), edits):
            other[at] = " ".join(f"e{draw.randint(0, 10**6)}" for _ in range(9))
        rows.append((len(rows), "\n".join(["menu of the site", *other])))
    return rows


def test_copies_do_not_become_their_own_boilerplate(spark):
    """Exact and edited copies keep every line but the menu, on small and large sites; without the option they lose all they share."""
    draw, rows = random.Random(11), []
    for site, n, copies, edits in (("a", 100, 3, 2), ("b", 100, 20, 6), ("c", 1000, 3, 2), ("d", 1000, 250, 8), (None, 300, 40, 12)):
        rows += [(len(rows), t, site) for _, t in site_with_copies(draw, n, copies, edits)]
    rows += [rows[95]] * 3  # repeated rows are copies as well
    got = result(lines.drop_boilerplate(frame(spark, rows).repartition(5), copies_once=True))
    assert got == sorted([(i, t.removeprefix("menu of the site\n"), s) for i, t, s in rows], key=repr)
    assert got == sorted(brute_once(rows, 0.01, 3), key=repr)
    assert sum(t == "" for _, t, _ in result(lines.drop_boilerplate(frame(spark, rows)))) > 200


def test_template_lines_of_many_pages_go_next_to_copies(spark):
    """Without copies both ways agree."""
    draw = random.Random(4)
    rows = [(i, "\n".join(["head", *article(draw, 3), *(["foot"] if i % 20 == 0 else [])]), "s") for i in range(400)]
    assert result(lines.drop_boilerplate(frame(spark, rows), copies_once=True)) == result(lines.drop_boilerplate(frame(spark, rows)))


def test_columns_with_any_names(spark):
    names = ["__k1", "__k2", "__bad", "__text", "__gone", "k1", "k2", "bad_lines", "new_text", "lines_gone", "page1", "page", "s_site", "h1", "size"]
    docs = spark.createDataFrame([(i, f"menu\nown {i}", "a", *[j * 100 + i for j in range(len(names))]) for i in range(5)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    for once in (False, True):
        got = lines.drop_boilerplate(docs, copies_once=once, dropped="gone")
        assert got.columns == [*docs.columns, "gone"]
        assert all([r[n] for n in names] == [j * 100 + r["doc_id"] for j in range(len(names))] for r in got.collect())


def test_empty_table(spark):
    assert lines.drop_boilerplate(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    for once in (False, True):
        df = lines.drop_boilerplate(frame(spark, [(1, "a", "b")]), copies_once=once)
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
