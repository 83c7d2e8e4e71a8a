"""Text work on a whole corpus: dictionary lemmas, distinct texts, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.encoders import Encoder
from trendloom.functions.text import (apply_phrases, clean_attribute_text, drop_trailing_conjunction,
                                      is_kept, is_number_like, number_to_word, rule_lemma, tokenize)
from trendloom.functions.expr import let, literal_array, strip
from trendloom.operators.lemmas import apply_lemma_rules
from trendloom.operators.sizing import derive_once, lookup_join, row_partitions


def explode_tokens(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, pos, token): each token of the cleaned text once, no trailing conjunction."""
    cleaned = apply_phrases(clean_attribute_text(text))
    tokens = let(tokenize(cleaned), lambda t: F.array_distinct(drop_trailing_conjunction(t)))
    return texts.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def _table_lemma(tokens: DataFrame, lemmas: DataFrame | None, rules: DataFrame | None) -> tuple[DataFrame, Column]:
    """Tokens with the columns that the lemma is made of, and the lemma: entry, learned rule or suffix rule."""
    found = rule_lemma("token")
    if rules is not None:
        tokens = apply_lemma_rules(tokens, rules, out="__ruled")
        found = F.col("__ruled")
    if lemmas is not None:
        entries = lemmas.select("token", F.col("lemma").alias("__lemma"))
        tokens = lookup_join(tokens, entries, ["token"])
        found = F.coalesce("__lemma", found)
    return tokens, found


def lemmatize(tokens: DataFrame, lemmas: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Lemma of each token: number word, dictionary entry, or suffix rule.

    `lemmas(token, lemma)` is one row per token. `rules` are those of
    `lemmas.fit_lemma_rules` and stand in for the fixed suffix rules.
    """
    tokens, found = _table_lemma(tokens, lemmas, rules)
    lemma = F.when(is_number_like("token"), number_to_word("token")).otherwise(found)
    return tokens.withColumn("lemma", lemma).drop("__lemma", "__ruled")


def normalize_tags(tags: DataFrame, tag: str, lemmas: DataFrame | None = None, rules: DataFrame | None = None,
                   out: str = "preprocessed_tag") -> DataFrame:
    """Add the words of each tag as `text.normalize_tag` gives them, with lemmas from a table or learned rules.

    Each distinct tag is worked out once; a null tag has none.
    """
    def derive(distinct: DataFrame) -> DataFrame:
        text = strip(F.lower(F.replace(F.col(tag), F.lit("_"), F.lit(" "))))
        split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        words = distinct.select(tag, F.posexplode(F.transform(split, number_to_word)).alias("pos", "token"))
        words, found = _table_lemma(words, lemmas, rules)
        done = reassemble(words.select(tag, "pos", found.alias("lemma")), [tag], out)
        return lookup_join(distinct, done, [tag]).withColumn(out, F.coalesce(out, F.lit("")))

    return derive_once(tags, [tag], derive)


def keep_tokens(tokens: DataFrame, stop_words: Sequence[str] = tuple(voc.STOP_WORDS),
                category_stop: str | None = None) -> DataFrame:
    """Rows whose lemma belongs in the text; `category_stop` names an array column."""
    stop = F.col(category_stop) if category_stop else literal_array([])
    return tokens.where(is_kept(F.col("token"), F.col("lemma"), stop, stop_words))


def reassemble(tokens: DataFrame, keys: Sequence[str], out: str = "embedding_text") -> DataFrame:
    """Text of the lemmas of each key, repeats dropped before they meet."""
    once = tokens.groupBy(*keys, "lemma").agg(F.min("pos").alias("pos"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "lemma")))
    return once.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda p: p["lemma"]), " ").alias(out))


def normalize_with_dictionary(texts: DataFrame, text: str, keys: Sequence[str], lemmas: DataFrame,
                              stop_words: Sequence[str] = tuple(voc.STOP_WORDS),
                              category_stop: str | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Normalised text per key with lemmas from a table, and from learned `rules` if given; empty where nothing is kept.

    Meant for distinct texts: `keys` identify a text.
    """
    carried = [*keys, category_stop] if category_stop else list(keys)
    tokens = lemmatize(explode_tokens(texts, text, carried), lemmas, rules)
    done = reassemble(keep_tokens(tokens, stop_words, category_stop), keys)
    return (texts.select(*keys).join(done, list(keys), "left")
            .withColumn("embedding_text", F.coalesce("embedding_text", F.lit(""))))


def encode_distinct(df: DataFrame, text: str, encoder: Encoder, out: str = "text_embedding",
                    partitions: int | None = None) -> DataFrame:
    """Vector of each distinct text, missing texts left out."""
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    texts = texts.repartition(partitions or row_partitions(df), text)
    return texts.select(text, encoder(F.col(text)).alias(out))


def embed_texts(df: DataFrame, text: str, encoder: Encoder, out: str = "text_embedding",
                partitions: int | None = None) -> DataFrame:
    """Add the vector of a text column; each distinct text is encoded once."""
    return derive_once(df, [text], lambda texts: texts.select(text, encoder(F.col(text)).alias(out)),
                       partitions)
