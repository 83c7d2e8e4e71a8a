"""The queries in plain SQL, written against the same tables.

Shared derivations are common table expressions; `sql` puts those a query
mentions, and what they need in turn, in front of it.
"""

from __future__ import annotations

import re

from trendloom.functions import vocabulary as voc


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def case_of(x: str, entries: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in entries.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def lemma(x: str) -> str:
    rules = (
        f"(CASE WHEN regexp_matches({x}, '^[a-z]{{2,}}ies$') THEN left({x}, length({x}) - 3) || 'y' "
        f"WHEN regexp_matches({x}, '^[a-z]+(ss|x|zz|tz|ch|sh)es$') THEN left({x}, length({x}) - 2) "
        f"WHEN regexp_matches({x}, '(ss|us|is)$') THEN {x} "
        f"WHEN regexp_matches({x}, '^[a-z]{{3,}}s$') THEN left({x}, length({x}) - 1) ELSE {x} END)")
    return case_of(x, voc.IRREGULAR_LEMMAS, rules)


def number_word(x: str) -> str:
    return case_of(x, voc.NUMBER_WORDS, x)


def number_like(x: str) -> str:
    endings = " OR ".join(f"suffix({x}, {text(e)})" for e in voc.ORDINAL_ENDINGS)
    return f"(regexp_matches({x}, '^[0-9]+$') OR {endings} OR {x} IN {in_list(voc.NUMBER_WORDS)})"


def cleaned(x: str) -> str:
    return f"replace(lower(replace({x}, '_', '-')), '&', 'and')"


def phrased(x: str) -> str:
    for phrase, replacement in voc.PHRASES:
        x = f"replace({x}, {text(phrase)}, {text(replacement)})"
    return x


TOKENS = r"[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\p{L}\p{M}\p{N}]"
PROTECTED = sorted({*voc.NUMBER_WORDS.values(), *voc.PROTECTED_WORDS})
CATEGORIES = values_list(voc.CATEGORIES)


def stop_list(category: str) -> str:
    words = rf"regexp_extract_all(lower({category}), '[\p{{L}}\p{{M}}\p{{N}}]+')"
    own = rf"list_filter({words}, lambda w: regexp_full_match(w, '\p{{L}}+'))"
    extra = values_list([w for w in voc.CATEGORY_STOP_EXTRA])
    return f"list_distinct(list_concat(list_transform({own}, lambda w: {lemma('w')}), {extra}))"


def normalized(source: str, id_: str, raw: str, category: str | None, word_lemma=lemma) -> str:
    """Query (id, text) with the normalised text of `raw` for each row of `source`."""
    stop = stop_list(category) if category else "[]::varchar[]"
    return f"""
    SELECT src.id, coalesce(done.text, '') AS text
    FROM (SELECT DISTINCT {id_} AS id FROM {source}) src LEFT JOIN (
      SELECT id, string_agg(lemma, ' ' ORDER BY i) AS text FROM (
        SELECT id, lemma, min(i) AS i FROM (
          SELECT id, i, tok, stops,
                 CASE WHEN {number_like('tok')} THEN {number_word('tok')} ELSE {word_lemma('tok')} END AS lemma
          FROM (
            SELECT id, stops, len(toks) AS n, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
            FROM (SELECT {id_} AS id, {stop} AS stops,
                         regexp_extract_all({phrased(cleaned(raw))}, '{TOKENS}') AS toks FROM {source}))
          WHERE NOT (i = n AND tok IN ('and', 'or')) AND NOT regexp_full_match(tok, '\\p{{P}}+'))
        WHERE lemma IN {in_list(PROTECTED)}
           OR NOT (tok IN {in_list(voc.STOP_WORDS)} OR lemma IN {in_list(voc.STOP_WORDS)}
                   OR list_contains(stops, lemma))
        GROUP BY id, lemma)
      GROUP BY id) done ON done.id = src.id"""


def normalized_tag(source: str, tag: str) -> str:
    """Query (id, text): the normalised tag of each distinct `tag`."""
    words = f"string_split_regex(trim(lower(replace({tag}, '_', ' '))), '\\s+')"
    word = lemma("num")
    return f"""
    SELECT id, string_agg(lemma, ' ' ORDER BY i) AS text FROM (
      SELECT id, lemma, min(i) AS i FROM (
        SELECT id, i, {word} AS lemma FROM (
          SELECT id, i, {number_word('tok')} AS num FROM (
            SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
            FROM (SELECT DISTINCT {tag} AS id, {words} AS toks FROM {source}))
          WHERE tok <> ''))
      GROUP BY id, lemma)
    GROUP BY id"""


def learned_rules(pairs: str, longest: int = 6, min_words: int = 2) -> str:
    """Query (ending, cut, added): the rule of each ending, learned from `pairs(token, lemma)`."""
    return f"""
    SELECT ending, cut, added FROM (
      SELECT ending, cut, added, count(*) AS words FROM (
        SELECT cut, added, unnest(list_concat(
                 list_transform(range(greatest(cut, 1), least(length(token), {longest}) + 1), lambda n: right(token, n)),
                 ['^' || token])) AS ending
        FROM (SELECT token, length(token) - kept AS cut, substr(lemma, kept + 1) AS added FROM (
          SELECT token, lemma, list_max(list_filter(range(0, least(length(token), length(lemma)) + 1),
                 lambda n: left(token, n) = left(lemma, n))) AS kept FROM {pairs})))
      GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY ending ORDER BY words DESC, cut, added DESC) = 1
        AND (words >= {min_words} OR ending[1] = '^')"""


def learned(words: str, rules: str, longest: int = 6) -> str:
    """Query (token, lemma): by the longest ending of each of `words(token)` that has one of the `rules`."""
    return f"""
    SELECT w.token, CASE WHEN r.cut IS NULL THEN w.token ELSE left(w.token, length(w.token) - r.cut) || r.added END AS lemma
    FROM (SELECT token, unnest(list_concat(
            list_transform(range(1, least(length(token), {longest}) + 1), lambda n: right(token, n)), ['^' || token])) AS ending
          FROM {words}) w LEFT JOIN {rules} r USING (ending)
    QUALIFY row_number() OVER (PARTITION BY w.token ORDER BY r.cut IS NULL, length(w.ending) DESC) = 1"""


def hashed(source: str, column: str, dim: int = 64) -> str:
    """Query (text, vec): the hashed unit vector of each distinct text."""
    return f"""
    SELECT text, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS vec
    FROM (
      SELECT all_places.text, list(coalesce(found.x, 0.0)::double ORDER BY all_places.place) AS v
      FROM (SELECT text, place FROM (SELECT DISTINCT {column} AS text FROM {source}) CROSS JOIN range({dim}) r(place)) all_places
      LEFT JOIN (
        SELECT text, ('0x' || substr(md5(w), 1, 4))::int % {dim} AS place,
               sum(1 - 2 * (('0x' || substr(md5(w), 5, 1))::int % 2)) AS x
        FROM (SELECT text, unnest(string_split_regex(text, '\\s+')) AS w
              FROM (SELECT DISTINCT {column} AS text FROM {source}))
        WHERE w <> '' GROUP BY ALL) found
      ON found.text = all_places.text AND found.place = all_places.place
      GROUP BY all_places.text)"""


def region(n: str) -> str:
    return f"(CASE WHEN {n} % 5 = 0 THEN NULL WHEN {n} % 2 = 0 THEN 'india' ELSE 'global' END)"


DENIED = [*voc.DENIED_TAGS, *[t.replace("_", " ") for t in voc.DENIED_TAGS]]
THRESHOLDS = ", ".join(f"({text(c)}, {float(t)})" for c, t, _ in voc.THRESHOLDS)
RAW_TEXT = (
    f"(CASE WHEN lower(trim(value)) IN {in_list(voc.VALUE_ONLY_VALUES)} "
    f"OR lower(trim(type)) IN {in_list(voc.VALUE_ONLY_TYPES)} THEN value ELSE value || ' ' || type END)")


def centroid(keys: str, mask: str = "1.0") -> str:
    return f"""
    SELECT {keys}, list(x ORDER BY d) AS v FROM (
      SELECT {keys}, d, sum(e * m) / greatest(sum(m), 1e-9) AS x FROM (
        SELECT {keys}, {mask} AS m, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) AS d
        FROM (SELECT *, label * 5 + vec_id % 5 AS pos FROM embeddings))
      GROUP BY ALL)
    GROUP BY ALL"""


UNIT = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"

VIEWS: dict[str, str] = {
    "thr": f"SELECT * FROM (VALUES {THRESHOLDS}) t(category, threshold)",
    "items": f"""
      SELECT vec_id, vec_id // 3 AS product_id, {CATEGORIES}[label + 5] AS category,
             (vec_id * 7 % 10) / 10.0 AS weight, embedding::double[] AS vec, label FROM embeddings""",
    "tags": f"""
      SELECT pos, 'tag_' || num AS tag, {CATEGORIES}[label + 5] AS category, {region('pos')} AS region,
             'text ' || pos AS tag_embedding_text,
             CASE WHEN pos % 7 = 0 THEN NULL WHEN pos % 7 = 1 THEN '  ' ELSE 'about tag_' || num END AS description,
             {UNIT} AS vec
      FROM (SELECT *, CASE WHEN pos % 10 = 3 THEN pos - 1 ELSE pos % 40 END AS num
            FROM ({centroid('pos, label')}))""",
    "tag_first": "SELECT tag, vec FROM tags QUALIFY row_number() OVER (PARTITION BY tag ORDER BY pos) = 1",
    "tag_meta": """SELECT category, tag, region, tag_embedding_text FROM tags
      QUALIFY row_number() OVER (PARTITION BY category, tag ORDER BY pos) = 1""",
    "pairs": """
      SELECT i.vec_id, i.product_id, i.category, i.weight, m.tag, m.region, m.tag_embedding_text,
             list_inner_product(i.vec, f.vec) AS cos
      FROM items i JOIN tag_meta m ON m.category = i.category AND m.region IS NOT NULL
      JOIN tag_first f ON f.tag = m.tag""",
    "cand": """
      SELECT product_id, category, tag, region, tag_embedding_text, max(round(cos * weight, 9)) AS confidence
      FROM pairs WHERE round(cos * weight, 9) > 0 GROUP BY ALL""",
    "cat": f"""
      SELECT p_partkey AS product_id, {CATEGORIES}[p_partkey % 16 + 1] AS category, pos, type, value,
             ((p_partkey * 7 + pos) % 11 - 1) / 10.0 AS weight
      FROM (
        SELECT p_partkey, unnest(generate_series(1, 8)) AS pos,
               unnest(['brand', 'style', 'color', 'product title', 'size', 'sleeve length', 'pattern', 'occasion']) AS type,
               unnest([p_brand, p_type, split_part(p_name, ' ', 1), p_name, p_size::varchar,
                 CASE p_size % 4 WHEN 0 THEN 'Sleeveless' WHEN 1 THEN 'Half Sleeve' WHEN 2 THEN '3rd Sleeves & Cuffs' END,
                 {values_list([p for p, _ in voc.PHRASES])}[p_partkey % 45 + 1] || ' and',
                 (p_size % 12) || ' piece ' || p_name || ' Dresses, 80s_wear']) AS value
        FROM part)""",
    "cat_raw": f"SELECT *, {RAW_TEXT} AS raw FROM cat WHERE value IS NOT NULL",
    "cat_norm": normalized(
        "(SELECT DISTINCT category, raw FROM cat_raw)", "category || '##' || raw", "raw", "category"),
    "cat_text": """SELECT r.*, n.text AS embedding_text
      FROM cat_raw r JOIN cat_norm n ON n.id = r.category || '##' || r.raw""",
    "pt_norm": normalized_tag("part", "replace(p_name, ' ', '_')"),
    "pt": f"""
      SELECT pos, tag, {CATEGORIES}[pos % 16 + 1] AS category, {region('pos')} AS region, n.text AS preprocessed_tag,
             n.text AS tag_embedding_text, 'about ' || p_brand AS description
      FROM (SELECT p_brand, replace(p_name, ' ', '_') AS tag, min(p_partkey) AS pos FROM part
            GROUP BY p_name, p_brand) g
      JOIN pt_norm n ON n.id = g.tag""",
    "vec_of_cat": hashed("cat_text", "embedding_text"),
    "vec_of_tag": hashed("pt", "tag_embedding_text"),
    "pt_first": "SELECT tag, tag_embedding_text AS text FROM pt QUALIFY row_number() OVER (PARTITION BY tag ORDER BY pos) = 1",
    "pt_last": "SELECT tag, tag_embedding_text AS text FROM pt QUALIFY row_number() OVER (PARTITION BY tag ORDER BY pos DESC) = 1",
    "pt_meta": """SELECT category, tag, region, tag_embedding_text FROM pt
      QUALIFY row_number() OVER (PARTITION BY category, tag ORDER BY pos) = 1""",
    "text_cos": """
      SELECT t.category, t.embedding_text, m.tag, m.region, m.tag_embedding_text, list_inner_product(c.vec, v.vec) AS cos
      FROM (SELECT DISTINCT category, embedding_text FROM cat_text) t
      JOIN vec_of_cat c ON c.text = t.embedding_text
      JOIN pt_meta m ON m.category = t.category AND m.region IS NOT NULL
      JOIN pt_first f ON f.tag = m.tag JOIN vec_of_tag v ON v.text = f.text""",
    "cat_cand": """
      SELECT c.product_id, c.category, s.tag, s.region, s.tag_embedding_text,
             max(round(s.cos * c.weight, 9)) AS confidence
      FROM cat_text c JOIN text_cos s ON s.category = c.category AND s.embedding_text = c.embedding_text
      WHERE round(s.cos * c.weight, 9) > 0 GROUP BY ALL""",
    "part_scores": f"""
      SELECT p_partkey AS product_id, {CATEGORIES}[p_partkey % 16 + 1] AS category,
             coalesce({values_list([*DENIED, 'jacket style_x', 'abstract motif_print'])}[p_partkey % 23 + 1], p_name) AS tag,
             p_size / 100.0 AS confidence FROM part""",
    "rep": """
      SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS pos, 'occasion' AS type, l_returnflag AS value FROM lineitem
      UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'lining', l_linestatus FROM lineitem""",
    "ans": r"""
      SELECT *, CASE WHEN response IS NULL OR trim(response) = '' THEN 'no response'
                     WHEN conv_id % 3 = 2 THEN 'invalid envelope' END AS reject_reason
      FROM (
        SELECT conv_id, turn, text, inner_json, envelope,
               CASE WHEN turn % 4 = 3 THEN NULL WHEN conv_id % 3 = 0 THEN '```json' || chr(10) || envelope || chr(10) || '```'
                    WHEN conv_id % 3 = 1 THEN envelope ELSE '{' || envelope END AS response
        FROM (
          SELECT *, '{"output":[{"type":"reasoning","content":[{}]},{"type":"message","content":[{"text":'
                    || to_json(inner_json)::varchar || '}]}]}' AS envelope
          FROM (SELECT *, json_object('t', turn, 'text', text)::varchar AS inner_json FROM conversations)))""",
    "trend_rows": """
      SELECT p_name || ' & 50%+ off' AS category, n % 2 = 0 AS india, p_brand, p_name, price,
             row_number() OVER (PARTITION BY p_name, n % 2 ORDER BY n) - 1 AS trend_no
      FROM (SELECT p_name, p_brand, min(p_partkey) AS n, max(p_retailprice) AS price FROM part GROUP BY ALL)""",
    "trends": """
      SELECT category, CASE WHEN india THEN 'India' ELSE 'Global' END AS market,
             p_brand || ' Look' AS trend_name, '#' || p_brand AS primary_hashtag,
             'about ' || p_name || ',' || chr(10) || '"quoted"' AS aesthetic_description,
             CASE WHEN india THEN 'trending_tags_india' ELSE 'trending_tags_global' END AS market_key,
             trend_no::int AS trend_no, price AS confidence, '#a|#b, "c" ' || p_brand AS hashtags
      FROM trend_rows""",
    "led": """
      SELECT 'f' || event_id AS jsonl_file, 'b' || event_id AS id,
             CASE event_type WHEN 'signup' THEN 'validating' WHEN 'view' THEN 'in_progress'
               WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'expired'
               ELSE event_type END AS logged FROM events""",
    "states": """
      SELECT jsonl_file, id, status,
             CASE WHEN status IN ('validating', 'in_progress', 'finalizing') THEN 'active'
                  WHEN status = 'completed' THEN 'done'
                  WHEN status IN ('failed', 'cancelled', 'expired') THEN 'ended' ELSE 'unknown' END AS state
      FROM (
        SELECT l.jsonl_file, l.id, coalesce(o.status, l.logged) AS status
        FROM led l LEFT JOIN (
          SELECT 'b' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'finalizing'
                 ELSE 'cancelled' END AS status FROM orders) o ON o.id = l.id)""",
    "doc_norm": normalized("documents", "doc_id", "text", "source"),
    "doc_plain": normalized("documents", "doc_id", "text", None),
    "descriptions": """
      SELECT product_id, string_agg(type || ' values are ' || vals, '. ' ORDER BY pos, type || ' values are ' || vals) || '.' AS product_description
      FROM (
        SELECT product_id, type, string_agg(value, ', ' ORDER BY pos, value) AS vals, min(pos) AS pos
        FROM (SELECT product_id, type, value, min(pos) AS pos FROM described GROUP BY ALL)
        GROUP BY ALL)
      GROUP BY product_id""",
}


def sql(body: str, **local: str) -> str:
    """`body` with the views it needs in front; `local` adds or replaces some."""
    known = {**VIEWS, **local}
    needed: list[str] = []

    def visit(query: str) -> None:
        for name, definition in known.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", query):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body


def top(source: str, by: str, score: str, k: int, tie: str = "product_id") -> str:
    return (f"SELECT * FROM {source} QUALIFY row_number() OVER "
            f"(PARTITION BY {by} ORDER BY {score} DESC NULLS LAST, {tie}) <= {k}")


ALLOWED = in_list(voc.DESCRIPTION_TYPES)
KEPT = f"""
  SELECT c.*, t.description FROM cand c LEFT JOIN thr USING (category)
  LEFT JOIN tags t ON t.tag_embedding_text = c.tag_embedding_text
    AND t.region IS NOT DISTINCT FROM c.region AND t.category = c.category
  WHERE c.confidence >= coalesce(threshold, 0.0) AND c.tag NOT IN {in_list(DENIED)}"""
MAPPING = {
    "kept": f"""
      SELECT c.*, d.description FROM cat_cand c LEFT JOIN thr USING (category)
      LEFT JOIN (SELECT * FROM pt QUALIFY row_number() OVER (
          PARTITION BY tag_embedding_text, region, category ORDER BY pos) = 1) d
        ON d.tag_embedding_text = c.tag_embedding_text AND d.region IS NOT DISTINCT FROM c.region
        AND d.category = c.category
      WHERE c.confidence >= coalesce(threshold, 0.0) AND c.tag NOT IN {in_list(DENIED)}""",
    "best": top("kept", "tag, category", "confidence", 5000),
    "described": f"""SELECT * FROM cat WHERE type IN {ALLOWED} AND value IS NOT NULL
      AND product_id IN (SELECT product_id FROM best)""",
    "vec_of_desc": hashed("descriptions", "product_description"),
    "ranked": """
      SELECT b.*, round(list_cosine_similarity(p.vec, t.vec), 9) AS cosine_similarity
      FROM best b JOIN descriptions d ON d.product_id = b.product_id
      JOIN vec_of_desc p ON p.text = d.product_description
      LEFT JOIN pt_last l ON l.tag = b.tag LEFT JOIN vec_of_tag t ON t.text = l.text""",
}
LI = "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem"
LI_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]

ORACLE: dict[str, str] = {
    "l2_normalize": """
      SELECT vec_id, (unnest(range(64)))::int AS place, round(unnest(list_transform(d, lambda x: x / sqrt(list_inner_product(d, d)))), 6) AS x
      FROM (SELECT vec_id, list_transform(embedding, lambda x: x::double * 2) AS d FROM embeddings)""",
    "mean_pool_by_label": f"""
      SELECT label, (unnest(range(64)))::int AS place, round(unnest(v), 6) AS x
      FROM ({centroid('label', 'mask').replace('SELECT *, label', 'SELECT *, (embedding[1] > 0)::int::double AS mask, label')})""",
    "parse_vector": """
      SELECT vec_id, (unnest(range(64)))::int AS place, unnest(embedding) AS x FROM embeddings""",
    "similarity_scores": sql("""
      SELECT vec_id, tag, round(round(list_inner_product(i.vec, f.vec), 9), 6) AS score
      FROM items i JOIN tag_first f ON round(list_inner_product(i.vec, f.vec), 9) > 0"""),
    "similarity_in_category": sql("""
      SELECT vec_id, category, tag, round(round(cos, 9), 6) AS score FROM pairs WHERE round(cos, 9) > 0"""),
    "weighted_similarity": sql("""
      SELECT vec_id, category, tag, round(round(cos * weight, 9), 6) AS score
      FROM pairs WHERE round(cos * weight, 9) > 0"""),
    "max_score_per_product_tag": sql(
        "SELECT category, product_id, tag, round(confidence, 6) AS confidence FROM cand"),
    "min_score_filter": sql(
        "SELECT category, product_id, tag, round(confidence, 6) AS confidence FROM cand WHERE confidence > 0.1"),
    "candidates_with_region": sql("""
      SELECT product_id, category, tag, region, tag_embedding_text, round(confidence, 6) AS confidence FROM cand"""),
    "attach_tag_meta": sql(f"""
      SELECT e.vec_id, e.category, e.tag, m.region, m.tag_embedding_text
      FROM (SELECT vec_id, {CATEGORIES}[vec_id % 16 + 1] AS category, 'tag_' || (vec_id % 40) AS tag FROM embeddings) e
      LEFT JOIN tag_meta m ON m.category = e.category AND m.tag = e.tag"""),
    "attach_tag_vector": sql("""
      SELECT pos, tag, category, region, place, round(x, 6) AS x FROM (
        SELECT pos, tag, category, region, (unnest(range(64)))::int AS place, unnest(vec) AS x
        FROM pt JOIN vec_of_tag v ON v.text = pt.tag_embedding_text)
      WHERE x <> 0"""),
    "lookup_tag_vector": sql("""
      SELECT c.product_id, c.pos, replace(c.value, ' ', '_') AS tag, l.place, round(l.x, 6) AS x FROM cat c
      LEFT JOIN (SELECT * FROM (SELECT tag, (unnest(range(64)))::int AS place, unnest(vec) AS x
                                FROM pt_last JOIN vec_of_tag v ON v.text = pt_last.text)) l
      ON l.tag = replace(c.value, ' ', '_') WHERE l.x IS NULL OR l.x <> 0"""),
    "prefilter_topk": sql(f"""
      SELECT product_id, category, tag, region, round(confidence, 6) AS confidence
      FROM ({top('cand', 'tag, category', 'confidence', 5000)})"""),
    "top_candidates": sql(f"""
      SELECT product_id, category, tag, round(confidence, 6) AS confidence
      FROM ({top('cat_cand', 'tag, category', 'confidence', 5000)})"""),
    "cosine_rerank_top": sql(f"""
      SELECT vec_id, product_id, category, round(cosine_similarity, 6) AS cosine_similarity
      FROM ({top('cosines', 'category', 'cosine_similarity', 15, 'vec_id')})""",
        cosines=f"""SELECT i.*, round(list_cosine_similarity(i.vec, c.v), 9) AS cosine_similarity
          FROM items i JOIN ({centroid('label')}) c ON c.label = i.label"""),
    "scores_wide_unpivot": sql(
        "SELECT category, product_id, tag, round(confidence, 6) AS confidence FROM cand"),
    "category_threshold": sql("""
      SELECT product_id, s.category, tag, confidence FROM part_scores s LEFT JOIN thr ON thr.category = s.category
      WHERE confidence >= coalesce(threshold, 0.0)"""),
    "unmatched_categories": sql("""
      SELECT category, count(*) AS rows FROM part_scores
      WHERE category NOT IN (SELECT category FROM thr) GROUP BY category"""),
    "threshold_audit": sql("""
      SELECT category, count(*) AS rows_in, count(*) FILTER (confidence >= t) AS rows_kept,
             count(*) FILTER (confidence < t) AS rows_dropped
      FROM (SELECT s.*, coalesce(threshold, 0.0) AS t FROM part_scores s LEFT JOIN thr ON thr.category = s.category)
      GROUP BY category"""),
    "denylist": sql(f"SELECT * FROM part_scores WHERE tag NOT IN {in_list(DENIED)}"),
    "base_threshold": sql("""
      SELECT product_id, round(confidence - 0.75, 6) AS confidence FROM part_scores WHERE confidence - 0.75 > -0.5"""),
    "attach_description": sql(f"""
      SELECT r.*, t.description FROM (
        SELECT vec_id, 'text ' || (vec_id % 60) AS tag_embedding_text, {region('(vec_id % 60)')} AS region, category FROM items) r
      LEFT JOIN tags t ON t.tag_embedding_text = r.tag_embedding_text AND t.region IS NOT DISTINCT FROM r.region
        AND t.category = r.category"""),
    "missing_description_count": sql(f"""
      SELECT count(*) FILTER (description IS NULL OR trim(description) = '') AS missing FROM ({KEPT})"""),
    "thresholded_candidates": sql(f"""
      SELECT product_id, category, tag, region, description, round(confidence, 6) AS confidence FROM ({KEPT})"""),
    "threshold_pushdown": sql("""
      SELECT product_id, c.category, tag, region, round(confidence, 6) AS confidence
      FROM cand c LEFT JOIN thr ON thr.category = c.category WHERE confidence >= coalesce(threshold, 0.0)"""),
    "count_by_category": sql("SELECT category, count(*) AS rows FROM cand GROUP BY category"),
    "attribute_allowlist": sql(f"""
      SELECT product_id, pos, type AS standardize_type_updated, value AS normalised_name FROM cat WHERE type IN {ALLOWED}"""),
    "concat_distinct": sql("""
      SELECT product_id, type AS standardize_type_updated, string_agg(value, ', ' ORDER BY pos, value) AS "values"
      FROM (SELECT product_id, type, value, min(pos) AS pos FROM rep GROUP BY ALL) GROUP BY ALL"""),
    "product_description": sql("SELECT product_id, product_description FROM descriptions",
                               described="SELECT * FROM rep"),
    "catalog_description": sql(
        "SELECT product_id, product_description FROM descriptions",
        described=f"""SELECT * FROM cat WHERE type IN {ALLOWED} AND value IS NOT NULL
          AND product_id IN (SELECT product_id FROM part_scores WHERE confidence >= 0.2)"""),
    "catalog_for_candidates": sql("""
      SELECT product_id, pos FROM cat WHERE product_id IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)"""),
    "count_distinct_products": sql("SELECT count(DISTINCT product_id) AS products FROM rep"),
    "dedupe_first": f"{LI} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LI_ORDER)}) = 1",
    "dedupe_last": (f"{LI} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY "
                    f"{', '.join(c + ' DESC' for c in LI_ORDER)}) = 1"),
    "embedding_text_raw": sql("SELECT product_id, pos, raw FROM cat_raw"),
    "clean_text": f"""
      SELECT doc_id, md5({cleaned('text')}) AS digest, length({cleaned('text')})::int AS n FROM documents""",
    "phrase_rules": sql(f"SELECT product_id, pos, {phrased('lower(value)')} AS text FROM cat_raw"),
    "number_words": f"""
      SELECT token, {number_word('token')} AS word, count(*) AS n
      FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS token FROM documents)
      WHERE {number_like('token')} GROUP BY ALL""",
    "normalize_text": sql("SELECT id AS doc_id, md5(text) AS digest, length(text)::int AS n FROM doc_norm"),
    "catalog_text": sql("SELECT product_id, pos, embedding_text FROM cat_text"),
    "dictionary_text": sql("SELECT id AS raw, text AS embedding_text FROM dict_norm", dict_norm=normalized(
        "(SELECT DISTINCT raw FROM cat_raw)", "raw", "raw", None,
        lambda x: (f"(CASE WHEN list_contains((SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w "
                   f"FROM part)), {x}) THEN 'x' || {x} ELSE {lemma(x)} END)"))),
    "normalize_tag": sql("SELECT id AS tag, text AS preprocessed_tag FROM tag_norm", tag_norm=normalized_tag(
        "part", "p_name || '_' || p_type || '_' || p_size || '_2nd Dresses  small'")),
    "learned_lemmas": f"""
      WITH words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents),
      known AS (SELECT token, {lemma('token')} AS lemma FROM words WHERE left(md5(token), 1) < 'c'),
      rules AS ({learned_rules('known')}), done AS ({learned('words', 'rules')})
      SELECT token, left(md5(token), 1) < 'c' AS known, lemma FROM done""",
    "learned_tags": f"""
      WITH tags AS (SELECT DISTINCT p_name || '_' || p_type || '_2nd' AS tag FROM part),
      words AS (SELECT DISTINCT CASE tok WHEN '2nd' THEN 'second' ELSE tok END AS token, tok = '2nd' AS number FROM (
        SELECT unnest(string_split_regex(lower(tag), '[_ ]+')) AS tok FROM tags)),
      known AS (SELECT token, left(token, length(token) - 1) AS lemma FROM words
                WHERE NOT number AND length(token) BETWEEN 4 AND 6),
      rules AS ({learned_rules('known')}),
      done AS ({learned('(SELECT DISTINCT token FROM words)', 'rules')})
      SELECT tag, string_agg(lemma, ' ' ORDER BY i) AS preprocessed_tag FROM (
        SELECT tag, lemma, min(i) AS i FROM (
          SELECT tag, i, CASE tok WHEN '2nd' THEN 'second' ELSE tok END AS token FROM (
            SELECT tag, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
            FROM (SELECT tag, string_split_regex(lower(tag), '[_ ]+') AS toks FROM tags)))
        JOIN done USING (token) GROUP BY tag, lemma)
      GROUP BY tag""",
    "category_stop_words": sql(f"""
      SELECT category, unnest({stop_list('category')}) AS lemma
      FROM (SELECT DISTINCT concat_ws(' - ', category, value) AS category FROM cat)"""),
    "dedupe_tokens": sql("""
      SELECT d.doc_id, md5(coalesce(s.text, '')) AS digest, length(coalesce(s.text, ''))::int AS n
      FROM documents d LEFT JOIN token_text s ON s.doc_id = d.doc_id""", token_text=f"""
      SELECT doc_id, string_agg(tok, ' ' ORDER BY i) AS text FROM (
        SELECT doc_id, tok, min(i) AS i FROM (
          SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKENS}') AS toks FROM documents))
        GROUP BY ALL) GROUP BY doc_id"""),
    "hash_embed": sql("""
      SELECT embedding_text, rows, place, round(x, 6) AS x FROM (
        SELECT c.embedding_text, c.rows, (unnest(range(64)))::int AS place, unnest(v.vec) AS x
        FROM (SELECT embedding_text, count(*) AS rows FROM cat_text GROUP BY ALL) c
        JOIN vec_of_cat v ON v.text = c.embedding_text)
      WHERE x <> 0"""),
    "token_embed": r"""
      WITH sizes AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: length(w)) AS ids
                     FROM documents WHERE text IS NOT NULL),
      sums AS (SELECT doc_id, list_transform(range(8), lambda k: len(list_filter(ids, lambda i: i % 8 = k))) AS v FROM sizes),
      units AS (SELECT doc_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS norm FROM sums)
      SELECT doc_id, unnest(range(8))::int AS place, round(unnest(v) / norm, 6) AS x FROM units""",
    "catalog_candidates": sql("""
      SELECT product_id, category, tag, region, tag_embedding_text, round(confidence, 6) AS confidence FROM cat_cand"""),
    "trend_product_mapping": sql(f"""
      SELECT product_id, category, tag, region, description, lower(split_part(category, ' - ', 1)) AS gender,
             date '2026-01-16' AS start_date, date '2026-01-23' AS end_date,
             round(confidence, 6) AS confidence, round(cosine_similarity, 6) AS cosine_similarity
      FROM ({top('ranked', 'tag, category', 'cosine_similarity', 1000)})""", **MAPPING),
    "tag_dim": sql("""
      SELECT preprocessed_tag AS tag_value, category, region AS tag_type, tag FROM pt
      WHERE tag IN (SELECT replace(value, ' ', '_') FROM cat WHERE value IS NOT NULL)"""),
    "mapping_tag_dim": sql(f"""
      SELECT preprocessed_tag AS tag_value, category, region AS tag_type, tag FROM pt
      WHERE tag IN (SELECT tag FROM ({top('ranked', 'tag, category', 'cosine_similarity', 1000)}))""", **MAPPING),
    "published_together": sql("""
      SELECT preprocessed_tag AS tag_value, category, region AS tag_type, tag, products
      FROM pt JOIN (SELECT replace(value, ' ', '_') AS tag, count(DISTINCT product_id) AS products FROM cat
                    WHERE value IS NOT NULL GROUP BY 1) USING (tag)"""),
    "derive_gender": sql("""
      SELECT category, lower(split_part(category, ' - ', 1)) AS gender, date '2026-01-16' AS start_date,
             date '2026-01-23' AS end_date, count(*) AS rows FROM part_scores GROUP BY ALL"""),
    "render_prompts": """
      SELECT DISTINCT p_type || ' - ' || p_name AS category,
             'List trends for ' || p_type || ' - ' || p_name || ' as {"a": [' || p_type || ' - ' || p_name || ']}' AS prompt
      FROM part""",
    "build_requests": """
      SELECT conv_id, turn, conv_id || '-' || turn AS custom_id, '/chat/completions' AS url, '1000' AS max_tokens, text,
             CASE WHEN turn % 2 = 0 THEN 'data:image/jpeg;base64,' || base64(role::blob) END AS image
      FROM conversations""",
    "request_lines": "SELECT conv_id || '-' || turn AS custom_id, 'model-x' AS model, text FROM conversations",
    "strip_fence": sql("""
      SELECT conv_id, turn, md5(CASE WHEN conv_id % 3 = 0 AND response IS NOT NULL THEN envelope ELSE response END) AS digest
      FROM ans"""),
    "extract_answer_text": sql("""
      SELECT conv_id, turn, CASE WHEN response IS NOT NULL AND conv_id % 3 < 2 THEN inner_json END AS answer FROM ans"""),
    "valid_answers": sql("SELECT conv_id, turn, turn AS t, text FROM ans WHERE reject_reason IS NULL"),
    "rejected_answers": sql("""
      SELECT reject_reason, count(*) AS n FROM ans WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""),
    "flatten_trends": sql("SELECT * FROM trends"),
    "flatten_trends_messy": sql("""
      SELECT category, market, trend_name, primary_hashtag, aesthetic_description, market_key,
             (trend_no + (length(category) % 7 = 5)::int)::int AS trend_no, confidence,
             CASE WHEN length(category) % 7 = 4 THEN '#x|#y' ELSE hashtags END AS hashtags,
             CASE WHEN length(category) % 7 = 2 THEN '{"mood":"high"}' END AS extra
      FROM trends WHERE length(category) % 7 <> 0"""),
    "trend_file_rejects": sql("""
      SELECT DISTINCT category, NULL::varchar AS market_key, NULL::int AS trend_no, 'file is no object' AS reject_reason, n
      FROM (
        SELECT category, (length('{"trending_tags_india":[') + length('],"trending_tags_global":[') + length(']}') - 3
               + sum(length(to_json({'trend_name': trend_name, 'primary_hashtag': primary_hashtag,
                   'supporting_hashtags': string_split(hashtags, '|'), 'aesthetic_description': aesthetic_description}))
                 + length(',"confidence":') + length(CASE WHEN confidence = round(confidence) THEN confidence::bigint || '.0' ELSE confidence::varchar END))
               + greatest(count(*) FILTER (market = 'India') - 1, 0) + greatest(count(*) FILTER (market = 'Global') - 1, 0))::int AS n
        FROM trends WHERE length(category) % 7 = 0 GROUP BY category)
      UNION ALL SELECT DISTINCT category, 'notes', NULL, 'market is no list', 9 FROM trends WHERE length(category) % 7 = 1
      UNION ALL SELECT DISTINCT category, market_key, 0, 'trend is no object', 4 FROM trends WHERE length(category) % 7 = 5"""),
    "curate_twice": sql("""
      SELECT category, market, CASE WHEN category LIKE 'b%' THEN replace(trend_name, ' Look', ' Mood') ELSE trend_name END AS trend_name,
             primary_hashtag, aesthetic_description, market_key, trend_no
      FROM trends
      WHERE length(category) % 3 = 1 OR (length(category) % 3 = 0 AND length(category) % 2 = 1)"""),
    "thresholds_file": sql("SELECT category, threshold::double AS threshold FROM thr"),
    "trends_csv_by_name": sql("""
      SELECT tag, category, region, description, place, round(x, 6) AS x FROM (
        SELECT tag, category, region, description, (unnest(range(64)))::int AS place, unnest(vec) AS x
        FROM pt JOIN vec_of_tag v ON v.text = pt.tag_embedding_text)
      WHERE x <> 0"""),
    "column_defaults": """
      SELECT p_partkey AS product_id, 'Men - ' || p_type AS category, 1.0::double AS confidence FROM part""",
    "file_names": r"""
      SELECT page_id, base, CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem, safe
      FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS base, replace(url, '/', '_') AS safe FROM pages)""",
    "incremental_catalog": sql("""
      SELECT category, product_id, pos, embedding_text, place, round(x, 6) AS x FROM (
        SELECT c.category, c.product_id, c.pos, c.embedding_text, (unnest(range(64)))::int AS place, unnest(v.vec) AS x
        FROM cat_text c JOIN vec_of_cat v ON v.text = c.embedding_text)
      WHERE x <> 0"""),
    "consolidate_trends": sql("SELECT * EXCLUDE (market_key, trend_no) FROM trends"),
    "curate_trends": sql("""
      SELECT category, market, trend_name, primary_hashtag, aesthetic_description, market_key, trend_no
      FROM trends
      WHERE length(category) % 3 = 1 OR (length(category) % 3 = 0 AND length(category) % 2 = 1)"""),
    "canonical_trends": sql(f"""
      SELECT t.category, lower(t.market) AS region, t.trend_no, replace(lower(t.trend_name), ' ', '_') AS tag,
             n.text AS preprocessed_tag, t.aesthetic_description AS description
      FROM trends t JOIN look_norm n ON n.id = replace(lower(t.trend_name), ' ', '_')""",
        look_norm=normalized_tag("part", "replace(lower(p_brand || ' Look'), ' ', '_')")),
    "label_market": """
      SELECT CASE WHEN event_id % 2 = 0 THEN 'India' ELSE 'Global' END AS market, event_type, count(*) AS n
      FROM events GROUP BY ALL""",
    "union_by_name": """
      SELECT p_name AS name, p_size AS size, NULL::varchar AS segment FROM part
      UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer""",
    "set_union": """
      SELECT unnest(string_split(p_name, ' ')) AS lemma FROM part UNION SELECT lower(p_type) FROM part""",
    "pending_files": """
      SELECT 'f' || o_orderkey AS file_name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "pending_requests": sql("""
      SELECT jsonl_file FROM (SELECT 'f' || o_orderkey AS jsonl_file FROM orders ORDER BY 1 LIMIT 500)
      WHERE jsonl_file NOT IN (SELECT jsonl_file FROM led WHERE logged <> 'expired')"""),
    "batch_state": sql("SELECT * FROM states"),
    "batch_states_tracked": sql("""
      SELECT *, state NOT IN ('done', 'ended') AND id NOT IN (SELECT 'b' || o_orderkey FROM orders) AS overdue FROM states"""),
    "batch_state_counts": sql("""
      SELECT CASE WHEN logged IN ('validating', 'in_progress', 'finalizing') THEN 'active'
                  WHEN logged = 'completed' THEN 'done' ELSE 'ended' END AS state, count(*) AS batches
      FROM led GROUP BY 1"""),
    "ledger_roundtrip": sql("SELECT jsonl_file, id, logged AS status FROM led"),
    "catalog_roundtrip": sql("SELECT category, product_id, pos, value AS normalised_name FROM cat"),
    "filter_category": sql("""
      SELECT category, product_id, pos, value AS normalised_name FROM cat WHERE category = 'Women - Jeans & Jeggings'"""),
    "category_folders": sql("""
      SELECT category, count(*) AS rows, sum(product_id)::bigint AS products FROM (
        SELECT category, product_id FROM part_scores UNION ALL SELECT 'base_level', product_id FROM part_scores)
      GROUP BY category"""),
    "single_table": sql("SELECT product_id, category, tag FROM part_scores"),
    "skip_done_categories": sql("""
      SELECT category, count(*) AS rows FROM part_scores WHERE category NOT LIKE 'Women%' GROUP BY category"""),
    "incremental_texts": sql("""
      SELECT d.doc_id, d.lang, md5(n.text) AS digest FROM documents d JOIN doc_plain n ON n.id = d.doc_id"""),
}
ORACLE["model_embed"] = ORACLE["hash_embed"]
ORACLE["similarity_native_kernel"] = ORACLE["weighted_similarity"]
ORACLE["incremental_vectors"] = ORACLE["incremental_catalog"]
ORACLE["filters_observed"] = """
  WITH n AS (SELECT count(*) AS a, count(*) FILTER (l_discount >= 0.05) AS b,
                    count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS c FROM lineitem)
  SELECT 'discounted' AS filter, a AS rows_in, b AS rows_kept, a - b AS rows_dropped FROM n
  UNION ALL SELECT 'returned', b, c, b - c FROM n"""
ORACLE["bucketed_description"] = ORACLE["catalog_description"]
ORACLE["catalog_candidates_by_row"] = ORACLE["catalog_candidates"]
