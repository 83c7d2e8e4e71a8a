"""The same results in SQL, where SQL can express them.

Left out: language (1) and quality (11), hashes of shingles (2), the
tokenizers (6, 8, 12) and markup (7) are beyond SQL; the tests compare these with plain versions.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from trendloom.llm.queries import RULES

LOWER = f"'{ascii_uppercase}', '{ascii_lowercase}'"
RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)

URLS = f"""
WITH rules AS (SELECT * FROM (VALUES {RULE_ROWS}) r(h, p, verdict)),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
places AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}) AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
       coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM places LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path"""

REPEATS = r"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM lists),
windows AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ranked AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY g, n ORDER BY doc_id, i) > 1 AS again FROM windows),
marked AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM ranked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

ARCHIVES = """
WITH pays AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first, sha1(body) AS hex FROM pays)
SELECT page_id, strlen(body)::bigint AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
         ('0x' || substr(hex, (1 + (5 * i) // 4)::int, 2))::int >> (3 - (5 * i) % 4)::int) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""

LINKS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::double[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.98),
reach AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT reach.v, pairs.b FROM reach JOIN pairs ON pairs.a = reach.c)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings JOIN (SELECT v, min(c) AS least FROM reach GROUP BY v) ON v = vec_id"""


def _normal(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


HITS = f"""
WITH items AS (SELECT item_id, {_normal('text')} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0),
asked AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
          FROM (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM sized)),
docs AS (SELECT doc_id, {_normal('text')} AS ws FROM documents),
windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
            FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
                  FROM docs CROSS JOIN (SELECT DISTINCT n FROM asked) WHERE len(ws) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN asked USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, coalesce(item_id::varchar, '') AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""

RANKED = f"""
WITH docs AS (SELECT doc_id, ws FROM (SELECT doc_id, {_normal('text')} AS ws FROM documents) WHERE len(ws) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(len(ws))::bigint AS n_words FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest({_normal('text')}) AS term FROM benchmark) GROUP BY item_id, term),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM docs)
         GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term) CROSS JOIN corpus),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::bigint AS score
           FROM asked JOIN weights USING (term) JOIN held USING (term) CROSS JOIN corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""

ORACLE: dict[str, str] = {
    "op3_url_filter": URLS,
    "op4_substring_dedup": REPEATS,
    "op5_warc": ARCHIVES,
    "op9_embedding_near_dedup": LINKS,
    "op10_benchmark_decontamination": HITS,
    "op13_ranked_search": RANKED,
}
