"""Lemma rules learned from a table, against a plain version and on words they have not seen."""

from collections import Counter

from trendloom.operators import corpus
from trendloom.operators.lemmas import LONGEST, MIN_WORDS, apply_lemma_rules, fit_lemma_rules

# word, lemma: a table to learn from
SEEN = """
potatoes potato, echoes echo, vetoes veto, shoes shoe, canoes canoe, toes toe, dominoes domino,
passes pass, losses loss, biases bias, viruses virus, focuses focus, uses use, roses rose, vases vase, bases base,
canvases canvas, atlases atlas, iris iris, bonuses bonus, campuses campus,
caches cache, aches ache, headaches headache, moustaches moustache, patches patch, stitches stitch, watches watch,
painted paint, planted plant, tinted tint, hinted hint, dusted dust, twisted twist, matched match, patched patch,
painting paint, planting plant, hinting hint, tinting tint, dusting dust, twisting twist, ring ring, king king,
stretched stretch, latched latch, fetched fetch, ditched ditch, pitched pitch, red red, bed bed, shed shed,
tops top, shirts shirt, skirts skirt, boots boot, socks sock, jeans jean, dress dress, glass glass,
babies baby, parties party, bodies body, movies movie, ladies lady, cities city
"""
PAIRS = [tuple(p.split()) for p in SEEN.replace("\n", " ").split(",")]
UNSEEN = {"tomatoes": "tomato", "heroes": "hero", "mustaches": "mustache", "stitched": "stitch", "printing": "print",
          "printed": "print", "studies": "study", "hatches": "hatch", "belts": "belt", "class": "class"}
MORE = [("heroes", "hero"), ("zeroes", "zero"), ("gases", "gas"), ("buses", "bus"), ("mosquitoes", "mosquito"),
        ("torpedoes", "torpedo")]


def plain_rules(pairs, longest=LONGEST, min_words=MIN_WORDS):
    """Every ending with the rule it takes, nothing left out."""
    votes, lemma_of = {}, {}
    for token, lemma in pairs:
        if token and lemma is not None:
            lemma_of[token] = min(lemma, lemma_of.get(token, lemma))
    for token, lemma in lemma_of.items():
        kept = 0
        while kept < min(len(token), len(lemma)) and token[kept] == lemma[kept]:
            kept += 1
        cut, added = len(token) - kept, lemma[kept:]
        ends = [token[-n:] for n in range(max(cut, 1), min(longest, len(token)) + 1)]
        for ending in [*ends, "^" + token]:
            votes.setdefault(ending, Counter())[cut, added] += 1
    best = {e: max(c.items(), key=lambda x: (x[1], -x[0][0], x[0][1])) for e, c in votes.items()}
    return {e: rule for e, (rule, n) in best.items() if n >= min_words or e[0] == "^"}


def plain_lemma(token, rules, longest=LONGEST):
    for ending in ["^" + token, *[token[-n:] for n in range(min(longest, len(token)), 0, -1)]]:
        if ending in rules:
            cut, added = rules[ending]
            return token[:len(token) - cut] + added
    return token


def table(spark, pairs):
    return spark.createDataFrame(pairs, "token string, lemma string")


def judged(spark, words, rules):
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    return {r["token"]: r["lemma"] for r in apply_lemma_rules(tokens, rules).collect()}


def test_equal_to_the_plain_version(spark):
    pairs = [*PAIRS, *MORE, ("dress", "dres"), ("", "x"), (None, "y"), ("odd", None), ("better", "good"), ("a", "")]
    rules = fit_lemma_rules(table(spark, pairs))
    plain = plain_rules(pairs)
    words = [*[p[0] for p in pairs if p[0]], *UNSEEN, "x", "s", "es", "ss", "größen", "straßes", "^tops", "tops" * 500]
    assert judged(spark, words, rules) == {w: plain_lemma(w, plain) for w in words}
    kept = {r["ending"]: (r["cut"], r["added"]) for r in rules.collect()}
    assert kept.items() <= plain.items() and len(kept) < len(plain) / 2


def test_words_of_the_table_and_words_like_them(spark):
    rules = fit_lemma_rules(table(spark, [*PAIRS, *MORE]))
    words = {**dict(PAIRS), **dict(MORE), **UNSEEN}
    got = judged(spark, words, rules)
    assert {w: got[w] for w in words if got[w] != words[w]} == {}


def test_ties_nulls_and_empty_tables(spark):
    # two words each way: the rule that cuts less wins
    tied = fit_lemma_rules(table(spark, [("axs", "ax"), ("bxs", "bx"), ("cxs", "cxs"), ("dxs", "dxs")]))
    assert judged(spark, ["exs", "axs", "dxs"], tied) == {"exs": "exs", "axs": "ax", "dxs": "dxs"}
    none = fit_lemma_rules(table(spark, []))
    assert none.count() == 0
    assert judged(spark, ["tops", None, ""], none) == {"tops": "tops", None: None, "": ""}
    assert apply_lemma_rules(spark.createDataFrame([], "token string"), tied).count() == 0


def test_texts_and_tags_take_table_and_rules(spark):
    lemmas = table(spark, [*PAIRS, *MORE])
    rules = fit_lemma_rules(lemmas)
    tokens = spark.createDataFrame([("heroes",), ("mustaches",), ("1st",), ("worn",)], "token string")
    got = {r["token"]: r["lemma"] for r in corpus.lemmatize(tokens, table(spark, [("worn", "wear")]), rules).collect()}
    assert got == {"heroes": "hero", "mustaches": "mustache", "1st": "first", "worn": "wear"}
    texts = spark.createDataFrame([("Mustaches, tomatoes",), ("the of",)], "t string")
    done = corpus.normalize_with_dictionary(texts, "t", ["t"], lemmas, rules=rules)
    assert {r["t"]: r["embedding_text"] for r in done.collect()} == {"Mustaches, tomatoes": "mustache tomato", "the of": ""}
    tags = spark.createDataFrame([("2_Mustaches_Printing mustache", 1), ("__", 2), (None, 3)], "tag string, n int")
    rows = corpus.normalize_tags(tags, "tag", lemmas, rules).collect()
    assert {r["n"]: r["preprocessed_tag"] for r in rows} == {1: "two mustache print", 2: "", 3: None}


def test_tags_without_tables_as_by_the_column_form(spark):
    from trendloom.functions.text import normalize_tag

    tags = spark.createDataFrame([("Red_dresses 2nd  waist",), ("",), ("10 boxes_boxes",)], "tag string")
    assert sorted(corpus.normalize_tags(tags, "tag").collect()) == sorted(
        tags.select("tag", normalize_tag("tag").alias("preprocessed_tag")).collect())
