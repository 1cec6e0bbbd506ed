"""Boilerplate lines by their frequency within a site.

For every site, the share of its pages that contain a line is compared with `max_ratio`; lines above it leave all
pages of the site. Lines are compared without blanks, tabs and carriage returns at their ends; blank lines stay.
A line must be on at least `min_pages` pages, so that a site of two pages has no boilerplate.

`MAX_RATIO` is a share of pages, not a count: a template puts its line on every page it makes, and a site is made of tens of
templates, so the least used of a hundred equal ones still has a hundredth of the pages. What was written for one page does
not come back on a hundredth of a large site by chance, however large the site is; on a site of under
min_pages / MAX_RATIO pages the page count decides alone.

Copies of a page are pages, unless `copies_once` is set: then pages that repeat each other support a line once. A page of which
frequent lines make up `COPY_SHARE` or more, by characters, is taken for a copy of something. Such pages get a label, the
smallest hash of their frequent lines, and twice take over the smallest label of the pages that share one of these lines, so that copies
that were edited in different places end with one label. A line's support is the number of other pages that hold it and of
the labels among these; only a line whose support is above the ratio as well goes. So a text that stands on a site three times, or a
thousand times, with small edits or none, does not become its own boilerplate. What may stay is a line that stands mostly on pages
made of little else. Near copies that share less than `COPY_SHARE` in whole lines are pages of their own.

Rules: a null text stays null and counts as a page without lines; rows with a null site form one site; a line that
occurs twice on a page counts once; repeated rows are pages of their own. A page of boilerplate alone becomes an empty text. All
other columns are returned as they came; `n_chars`, where it exists, follows the new text.

Only DataFrame expressions run. Counting pre-aggregates (site, line) in the map tasks, so a line that a third of all
pages share is one row per task; the join that finds the pages of such a line has no operator above it that needs a
key's rows together, so the engine may split it. Texts are shuffled once, when the decisions meet them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.tables import free, stored

MAX_RATIO = 0.01
MIN_PAGES = 3
COPY_SHARE = 0.5
_BLANKS = " \t\r"


def _hashes(c: Column):
    """128 bits of a line: two hashes with different seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def _lines(text: Column):
    return F.split(text, "\n", -1)


def _plain(line: Column):
    return F.btrim(line, F.lit(_BLANKS))


def page_lines(docs: DataFrame, site: str, text: str, *more: Column, keep_length=False) -> DataFrame:
    """A row per page and distinct line that is not blank: site, the line's hashes, the columns of `more`, and `size`, its
    characters, if wanted."""
    plain = F.array_distinct(F.transform(_lines(F.col(text)), _plain))
    pages = docs.select(F.col(site).alias("site"), *more, plain.alias("lines"))  # `more` once per page, not per line
    kept = [c for c in pages.columns if c != "lines"]
    rows = pages.select(*kept, F.explode("lines").alias("line")).where("line <> ''")
    a, b = _hashes(F.col("line"))
    size = [F.length("line").alias("size")] if keep_length else []
    return rows.select(*kept, a.alias("h1"), b.alias("h2"), *size)


def boilerplate(docs: DataFrame, site="source", text="text", max_ratio=MAX_RATIO, min_pages=MIN_PAGES, copies_once=False) -> DataFrame:
    """site, h1, h2, pages, site_pages of every line above the ratio."""
    counts = (page_lines(docs, site, text).groupBy("site", "h1", "h2").agg(F.count(F.lit(1)).alias("pages"))
              .where(F.col("pages") >= min_pages))
    sites = docs.groupBy(F.col(site).alias("of")).agg(F.count(F.lit(1)).alias("site_pages"))
    above = F.col("pages") > F.col("site_pages") * F.lit(float(max_ratio))
    found = counts.join(sites, F.col("site").eqNullSafe(F.col("of"))).where(above).drop("of")
    if not copies_once:
        return found
    found = stored(found, "frequent_lines")
    supported = support(docs, found, site, text)
    return (found.drop("pages").join(supported, _same("site", "h1", "h2")).select("site", "h1", "h2", "pages", "site_pages")
            .where((F.col("pages") >= min_pages) & above))


def _same(*names):
    """Equality of columns with those whose names begin with `s_`; sites may be null."""
    return [F.col(c).eqNullSafe(F.col(f"s_{c}")) if c == "site" else F.col(c) == F.col(f"s_{c}") for c in names]


def support(docs: DataFrame, frequent: DataFrame, site="source", text="text") -> DataFrame:
    """s_site, s_h1, s_h2, pages: on how many pages each of the `frequent` lines (site, h1, h2) stands, pages that repeat each other
    counted once."""
    whole = F.length(F.array_join(F.array_distinct(F.transform(_lines(F.col(text)), _plain)), ""))
    page = F.xxhash64(F.col(site).isNull(), F.col(site), F.col(text))  # equal texts of a site are one page
    lines = page_lines(docs, site, text, page.alias("page"), whole.alias("whole"), keep_length=True)
    chosen = frequent.select(*[F.col(c).alias(f"s_{c}") for c in ("site", "h1", "h2")])
    held = lines.join(chosen, _same("site", "h1", "h2"), "left_semi")
    held = stored(held.groupBy("site", "page", "h1", "h2").agg(F.max("size").alias("size"), F.max("whole").alias("whole")), "page_lines")
    pages = held.groupBy("site", "page").agg((F.sum("size") >= F.max("whole") * F.lit(COPY_SHARE)).alias("copy"), F.min("h1").alias("label"))
    copies = pages.where("copy").select("page", "label")
    of_copies = held.select("site", "page", "h1", "h2").join(copies.select("page"), "page", "left_semi")
    for _ in range(2):
        lines_of = of_copies.join(copies, "page").groupBy("site", "h1", "h2").agg(F.min("label").alias("least"))
        lines_of = lines_of.select("least", *[F.col(c).alias(f"s_{c}") for c in ("site", "h1", "h2")])
        copies = stored(of_copies.join(lines_of, _same("site", "h1", "h2")).groupBy("page").agg(F.min("least").alias("label")), "copies")
    standing = held.join(copies, "page", "left").select("site", "h1", "h2", F.col("label").isNull().alias("own"), F.coalesce("label", "page").alias("at"))
    return standing.distinct().groupBy(*[F.col(c).alias(f"s_{c}") for c in ("site", "h1", "h2")]).agg(F.count(F.lit(1)).alias("pages"))


def drop_boilerplate(docs: DataFrame, site="source", text="text", key="doc_id", max_ratio=MAX_RATIO,
                     min_pages=MIN_PAGES, dropped=None, copies_once=False) -> DataFrame:
    """`docs` without boilerplate lines; `dropped` names a column for the number of lines that went, if it is wanted.

    The lines to drop are gathered per page, a list no longer than the page itself.
    """
    k1, k2, gathered, new_text, n_gone = free(docs, "k1", "k2", "bad_lines", "new_text", "lines_gone")
    content = [F.col(key), F.col(site).isNull(), F.col(site), F.col(text)]
    ids = [F.xxhash64(*content).alias("page1"), F.xxhash64(F.lit(1), *content).alias("page2")]
    bad = boilerplate(docs, site, text, max_ratio, min_pages, copies_once).select(
        F.col("site").alias("s_site"), F.col("h1").alias("s_h1"), F.col("h2").alias("s_h2"))
    found = page_lines(docs, site, text, *ids).join(bad, _same("site", "h1", "h2"), "left_semi")
    per_page = found.groupBy(F.col("page1").alias(k1), F.col("page2").alias(k2)).agg(F.collect_set(F.struct("h1", "h2")).alias(gathered))
    rows = docs.select("*", *[c.alias(n) for c, n in zip(ids, (k1, k2))]).join(per_page, [k1, k2], "left")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(
        F.col(gathered), F.struct(*[h.alias(n) for h, n in zip(_hashes(_plain(x)), ("h1", "h2"))])))
    new = F.when(F.col(gathered).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col(gathered).isNull(), 0).otherwise(F.size(_lines(F.col(text))) - F.size(kept)).cast("long")
    rows = rows.withColumns({new_text: new, n_gone: gone})
    out = [F.col(new_text).alias(c) if c == text else
           F.length(new_text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*out, *([F.col(n_gone).alias(dropped)] if dropped else []))
