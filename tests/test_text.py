"""Text rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from trendloom.functions import answers, text as tx, vocabulary as voc
from trendloom.operators import corpus


@pytest.mark.parametrize("raw, expected", [
    ("yellow top", "yellow-top"), ("v necklace", "v-necklace"), ("crew neck", "crew-neck"),
])
def test_phrases_match_inside_words(value, raw, expected):
    assert value(tx.apply_phrases(F.lit(raw))) == expected


def test_phrases_on_word_boundaries(value):
    assert value(tx.apply_phrases(F.lit("yellow top v neck"), word_boundary=True)) == "yellow top v-neck"


def test_phrase_order_matters(value):
    assert value(tx.apply_phrases(F.lit("a b"), [("a b", "b c"), ("b c", "done")])) == "done"


@pytest.mark.parametrize("raw, expected", [
    ("2 piece", "two piece"), ("3rd", "third"), ("waist length", "waist length"),
    ("black and", "black"), ("black and.", "black and"), ("black and white", "black and white"),
    ("Dresses & frocks dresses", "dress and frock"), ("80s women's 2000s", "80s woman 2000s"),
    ("red!! (red) - blue", "red blue"), ("the of", ""), ("", ""), ("and", ""),
    ("100% cotton + silk", "100 cotton + silk"), ("snake_print", "snake print"),
])
def test_normalize_text(value, raw, expected):
    assert value(tx.normalize_text(F.lit(raw))) == expected


def test_category_words_are_dropped_unless_protected(value):
    stop = tx.category_stop_words(F.lit("Women - Jeans & Joggers 2P"))
    assert set(value(stop)) == {"woman", "jean", "jogger", "man", "child", "kid", "boy", "girl", "baby"}
    assert value(tx.normalize_text(F.lit("joggers jeans kids red"), stop)) == "jean red"


@pytest.mark.parametrize("word, lemma", [
    ("dresses", "dress"), ("babies", "baby"), ("jeans", "jean"), ("dress", "dress"), ("plus", "plus"),
    ("boxes", "box"), ("women", "woman"), ("me", "me"), ("80s", "80s"), ("gas", "gas"), ("hoodies", "hoodie"),
    ("sizes", "size"), ("prizes", "prize"), ("niches", "niche"), ("lens", "lens"), ("onesies", "onesie"), ("cookies", "cookie"),
    ("bikinis", "bikini"), ("saris", "sari"), ("khakis", "khaki"), ("menus", "menu"), ("printed", "print"), ("striped", "stripe"),
    ("watches", "watch"), ("brushes", "brush"), ("glasses", "glass"), ("sneakers", "sneaker"), ("tops", "top"), ("sarees", "saree"),
    ("accessories", "accessory"), ("bodies", "body"), ("parties", "party"), ("scarves", "scarf"), ("shoes", "shoe"),
    ("sleeves", "sleeve"), ("blouses", "blouse"), ("bras", "bra"), ("crocs", "croc"), ("leggings", "legging"),
    ("shorts", "short"), ("trousers", "trouser"), ("tights", "tight"), ("socks", "sock"), ("gloves", "glove"), ("buzzes", "buzz"),
    ("waltzes", "waltz"), ("clutches", "clutch"), ("patches", "patch"), ("beaches", "beach"), ("stitches", "stitch"),
    ("sashes", "sash"), ("laces", "lace"), ("bangles", "bangle"), ("ties", "tie"), ("series", "series"), ("us", "us"),
    ("kurtis", "kurti"), ("maxis", "maxi"), ("minis", "mini"), ("embroidered", "embroider"), ("quilted", "quilt"),
    ("pleated", "pleat"), ("cropped", "crop"), ("hooded", "hood"), ("red", "red"), ("canvas", "canvas"), ("bias", "bias"),
    ("gowns", "gown"), ("robes", "robe"), ("pies", "pie"), ("axes", "axe"), ("cargo", "cargo"), ("denim", "denim"),
])
def test_rule_lemma(value, word, lemma):
    assert value(tx.rule_lemma(F.lit(word))) == lemma


@pytest.mark.parametrize("word, like", [
    ("12", True), ("1st", True), ("waist", True), ("length", True), ("ten", True), ("red", False), ("12a", False)])
def test_is_number_like(value, word, like):
    assert value(tx.is_number_like(F.lit(word))) is like


@pytest.mark.parametrize("v, t, expected", [
    ("Sleeveless", "sleeve length", "Sleeveless"), (" sleeveless\t", "cut", " sleeveless\t"),
    ("Red", "color", "Red color"), ("Summer", "Season ", "Summer"), ("Long", "sleeve length", "Long sleeve length")])
def test_embedding_text_raw(value, v, t, expected):
    assert value(tx.embedding_text_raw(F.lit(v), F.lit(t))) == expected


def test_normalize_tag(value):
    assert value(tx.normalize_tag(F.lit(" 2_Piece_sets  2 SETS "))) == "two piece set"


def test_small_functions(value):
    assert value(tx.label_market(F.lit("trending_tags_INDIA"))) == "India"
    assert value(tx.label_market(F.lit("trending_tags_global"))) == "Global"
    assert value(tx.derive_gender(F.lit("Women - Kurta Suit Sets"))) == "women"
    assert value(tx.safe_name(F.lit("Men - Tshirts"))) == "Men_-_Tshirts"
    assert value(tx.file_stem(tx.decoded_path(F.lit("file:/a/Women%20-%20Jeans%20&%20Jeggings.json")))) \
        == "Women - Jeans & Jeggings"
    assert value(tx.file_stem(tx.decoded_path(F.lit("/a/x+y.v2.json")))) == "x+y.v2"
    assert value(tx.is_blank(F.lit(" \t\n"))) is True
    assert value(tx.is_blank(F.lit(None).cast("string"))) is True
    assert value(tx.is_blank(F.lit(" a"))) is False


def test_code_fence(value):
    assert value(answers.strip_code_fence(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert value(answers.strip_code_fence(F.lit('x ```\n1\n``` y ```2```'))) == "1"
    assert value(answers.strip_code_fence(F.lit("\n {} \t"))) == "{}"


def test_answer_text(value):
    by_index = '{"output":[{"type":"r"},{"type":"message","content":[{"text":"{}"}]}]}'
    first = '{"output":[{"type":"message","content":[{"text":"[]"}]}]}'
    assert value(answers.extract_answer_text(F.lit(by_index))) == "{}"
    assert value(answers.extract_answer_text(F.lit(first))) is None
    assert value(answers.extract_answer_text(F.lit(first), by_type=True)) == "[]"


def test_dictionary_and_rules_agree_without_entries(spark):
    texts = spark.createDataFrame(
        [("Dresses & frocks dresses",), ("2 piece sets and",), ("the of",), ("Half Sleeve tops",)], "t string")
    lemmas = spark.createDataFrame([("zzz", "z")], "token string, lemma string")
    by_table = corpus.normalize_with_dictionary(texts, "t", ["t"], lemmas)
    by_rule = texts.select("t", tx.normalize_text("t").alias("embedding_text"))
    assert sorted(by_table.collect()) == sorted(by_rule.collect())


def test_dictionary_wins(spark):
    tokens = spark.createDataFrame([("worn",), ("dresses",), ("1st",)], "token string")
    lemmas = spark.createDataFrame([("worn", "wear"), ("1st", "no")], "token string, lemma string")
    got = {r["token"]: r["lemma"] for r in corpus.lemmatize(tokens, lemmas).collect()}
    assert got == {"worn": "wear", "dresses": "dress", "1st": "first"}


def test_texts_repeat_no_word(spark):
    rows = spark.createDataFrame([("a red Red dress dresses top tops 2 two",)], "t string")
    words = rows.select(tx.normalize_text("t").alias("t")).first()["t"].split()
    assert len(words) == len(set(words))


def test_fixed_values():
    assert len(voc.PHRASES) == 45 and len(voc.NUMBER_WORDS) == 24
    assert len(voc.DESCRIPTION_TYPES) == 22 and len(voc.CATEGORIES) == 16 and len(voc.THRESHOLDS) == 16
