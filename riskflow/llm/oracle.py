"""SQL of the queries that SQL can express."""

ORACLE = {}

ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM p JOIN f USING (d)
"""

ORACLE["op2_line_dedup"] = """
WITH pages_of AS (SELECT source AS site, count(*) AS site_pages FROM documents GROUP BY source),
l AS (SELECT doc_id, source AS site, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, site, line, pos, trim(line, chr(32) || chr(9) || chr(13)) AS plain FROM l),
freq AS (SELECT site, plain, count(DISTINCT doc_id) AS pages FROM t WHERE plain <> '' GROUP BY site, plain),
bad AS (SELECT freq.site, plain FROM freq JOIN pages_of ON freq.site IS NOT DISTINCT FROM pages_of.site
        WHERE pages >= 3 AND pages > site_pages * CAST(0.1 AS DOUBLE)),
kept AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE bad.plain IS NULL) AS text,
                count(bad.plain) AS gone
         FROM t LEFT JOIN bad ON t.plain = bad.plain AND t.site IS NOT DISTINCT FROM bad.site GROUP BY t.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN NULL ELSE CAST(length(coalesce(k.text, '')) AS BIGINT) END AS n_chars,
       coalesce(k.gone, 0) AS lines_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLE["op11_passages"] = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
t AS (SELECT row_id, len(words) AS n, words, unnest(range(1, len(words) + 1)) AS pos FROM d),
win AS (SELECT row_id, pos, CASE WHEN pos + 34 <= n THEN sha256(array_to_string(words[pos:pos + 34], ' ')) END AS h FROM t),
again AS (SELECT h FROM win WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT win.row_id, win.pos, max(CASE WHEN again.h IS NULL THEN 0 ELSE 1 END)
                  OVER (PARTITION BY win.row_id ORDER BY win.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM win LEFT JOIN again ON win.h = again.h),
kept AS (SELECT m.row_id, sum(gone) AS n_removed, string_agg(d.words[m.pos], ' ' ORDER BY m.pos) FILTER (WHERE gone = 0) AS text
         FROM marked m JOIN d ON m.row_id = d.row_id GROUP BY m.row_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.row_id = k.row_id
"""

ORACLE["op12_prefix_trie"] = r"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                 lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)),
                 4294967295)) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM c)),
mixed AS (SELECT i.conv_id, pos, role, text FROM i JOIN c ON c.conv_id = i.base WHERE pos <= h
          UNION ALL SELECT i.conv_id, pos, role, text FROM i JOIN c ON c.conv_id = i.conv_id WHERE pos > h),
steps AS (SELECT conv_id, strlen(text) AS size, row_number() OVER mine AS d,
                 string_agg(sha256(strlen(role) || ':' || role || text), '') OVER mine AS path
          FROM mixed WINDOW mine AS (PARTITION BY conv_id ORDER BY pos)),
member AS (SELECT conv_id, size, d, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM i),
node AS (SELECT path, any_value(d) AS d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n FROM member GROUP BY path),
child AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
over_it AS (SELECT member.path, sum(CASE WHEN child.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((node.n - 1) * node.size) AS saved
            FROM node JOIN member ON member.conv_id = node.conv_id AND member.d <= node.d LEFT JOIN child ON child.path = node.path
            GROUP BY member.path),
final AS (SELECT conv_id, max(d) AS d FROM member GROUP BY conv_id),
done AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM member JOIN final USING (conv_id, d) GROUP BY path)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN over_it ON over_it.path = node.path LEFT JOIN child ON child.path = node.path LEFT JOIN done ON done.path = node.path
LEFT JOIN node up ON node.d > 0 AND up.path = left(node.path, length(node.path) - 64)
"""

ORACLE["op13_search"] = r"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT row_id, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM t WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(words) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM items JOIN df USING (term), total),
scored AS (SELECT item_id, d.row_id, any_value(d.doc_id) AS doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length))))) AS BIGINT) AS score
           FROM w JOIN tf USING (term) JOIN d USING (row_id), total GROUP BY item_id, d.row_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
