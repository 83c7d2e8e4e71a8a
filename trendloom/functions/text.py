"""Text rules for catalog attributes and tags, as native expressions.

No rule needs a shuffle: a text is tokenised, lemmatised, filtered and put
together again inside its own row. `operators.corpus` has the form that
looks lemmas up in a dictionary table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.expr import as_column, let, literal_array, literal_map, strip

TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\p{L}\p{M}\p{N}]"
PUNCTUATION_PATTERN = r"^\p{P}$"


def embedding_text_raw(value: Column | str, type_: Column | str) -> Column:
    """The value alone where it reads as a text of its own, else value and type."""
    value, type_ = as_column(value), as_column(type_)
    alone = F.lower(strip(value)).isin(voc.VALUE_ONLY_VALUES) | F.lower(strip(type_)).isin(
        voc.VALUE_ONLY_TYPES
    )
    return F.when(alone, value).otherwise(F.concat_ws(" ", value, type_))


def clean_attribute_text(c: Column | str) -> Column:
    lowered = F.lower(F.replace(as_column(c), F.lit("_"), F.lit("-")))
    return F.replace(lowered, F.lit("&"), F.lit("and"))


def apply_phrases(
    c: Column | str,
    rules: Sequence[tuple[str, str]] = tuple(voc.PHRASES),
    word_boundary: bool = False,
) -> Column:
    """Replace each phrase in turn. By default a phrase also matches inside a word.

    Texts without the end of any phrase are passed on after one search.
    """

    def replaced(out: Column) -> Column:
        for phrase, replacement in rules:
            if word_boundary:
                pattern = rf"(?<![\p{{L}}\p{{N}}])\Q{phrase}\E(?![\p{{L}}\p{{N}}])"
                out = F.regexp_replace(out, pattern, replacement)
            else:
                out = F.replace(out, F.lit(phrase), F.lit(replacement))
        return out

    # a phrase starts a search at its first blank, which few positions pass
    ends = dict.fromkeys(p[max(p.find(" "), 0):] for p, _ in rules)
    any_end = "|".join(re.escape(e) for e in ends)
    if all(e.startswith(" ") for e in ends):
        any_end = " (?:" + "|".join(re.escape(e[1:]) for e in ends) + ")"
    return let(as_column(c), lambda x: F.when(x.rlike(any_end), replaced(x)).otherwise(x))


def number_to_word(c: Column | str) -> Column:
    c = as_column(c)
    return F.coalesce(F.try_element_at(literal_map(voc.NUMBER_WORDS), c), c)


def is_number_like(c: Column | str) -> Column:
    """Digits, known number words, and anything with an ordinal ending (so `waist` too)."""
    c = as_column(c)
    ordinal = F.lit(False)
    for ending in voc.ORDINAL_ENDINGS:
        ordinal = ordinal | c.endswith(ending)
    starts_with_digit = (c >= "0") & (c < ":")
    return ordinal | c.isin(list(voc.NUMBER_WORDS)) | (starts_with_digit & c.rlike("^[0-9]+$"))


def tokenize(c: Column | str) -> Column:
    """Runs of letters and digits; any other visible character stands alone."""
    return F.regexp_extract_all(as_column(c), F.lit(TOKEN_PATTERN), F.lit(0))


def rule_lemma(c: Column | str) -> Column:
    """Singular of an English word by suffix, irregular forms looked up first."""
    c = as_column(c)
    return (
        F.when(c.isin(list(voc.IRREGULAR_LEMMAS)),
               F.try_element_at(literal_map(voc.IRREGULAR_LEMMAS), c))
        .when(~c.endswith("s"), c)
        .when(c.rlike("^[a-z]{2,}ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("^[a-z]+(ss|x|zz|tz|ch|sh)es$"), F.regexp_replace(c, "es$", ""))
        .when(c.rlike("(ss|us|is)$"), c)
        .when(c.rlike("^[a-z]{3,}s$"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def token_lemma(c: Column | str) -> Column:
    """Number word for number-like tokens, lemma for all others."""
    c = as_column(c)
    return F.when(is_number_like(c), number_to_word(c)).otherwise(rule_lemma(c))


def drop_trailing_conjunction(tokens: Column) -> Column:
    return F.when(
        F.try_element_at(tokens, F.lit(-1)).isin("and", "or"),
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
    ).otherwise(tokens)


def is_kept(token: Column, lemma: Column, category_stop: Column,
            stop_words: Sequence[str] = tuple(voc.STOP_WORDS)) -> Column:
    """Protected words stay, punctuation goes, the rest has to miss both stop lists."""
    protected = lemma.isin(sorted({*voc.NUMBER_WORDS.values(), *voc.PROTECTED_WORDS}))
    stopped = (
        token.isin(list(stop_words)) | lemma.isin(list(stop_words))
        | F.array_contains(category_stop, lemma)
    )
    # only a token of one character can be punctuation
    visible = (F.length(token) > 1) | ~token.rlike(PUNCTUATION_PATTERN)
    return protected | (~stopped & visible)


def dedupe_tokens(tokens: Column, sep: str = " ") -> Column:
    """First occurrence of each token, joined."""
    return F.array_join(F.array_distinct(tokens), sep)


def category_stop_words(category: Column | str,
                        extra: Sequence[str] = tuple(voc.CATEGORY_STOP_EXTRA)) -> Column:
    """Stop list of a category: the lemmas of its own words and a few fixed ones.

    A function of the category name alone, so it needs neither a job over the
    catalog nor a join.
    """
    words = F.regexp_extract_all(F.lower(as_column(category)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    alphabetic = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    own = F.transform(alphabetic, rule_lemma)
    return F.array_distinct(F.array_union(own, F.transform(literal_array(extra), rule_lemma)))


def normalize_text(c: Column | str, category_stop: Column | None = None,
                   stop_words: Sequence[str] = tuple(voc.STOP_WORDS)) -> Column:
    """Cleaned, phrase-joined, lemmatised and filtered text without repeated words."""
    stop = literal_array([]) if category_stop is None else category_stop

    def words(tokens: Column, stop: Column) -> Column:
        pairs = F.transform(
            tokens, lambda t: F.struct(t.alias("token"), token_lemma(t).alias("lemma")))
        kept = F.filter(pairs, lambda p: is_kept(p["token"], p["lemma"], stop, stop_words))
        return F.transform(kept, lambda p: p["lemma"])

    def body(tokens: Column) -> Column:
        # what becomes of a token depends on the token alone, so repeats can go first
        once = F.array_distinct(drop_trailing_conjunction(tokens))
        return let(stop, lambda s: words(once, s))

    return dedupe_tokens(let(tokenize(apply_phrases(clean_attribute_text(c))), body))


def normalize_tag(c: Column | str) -> Column:
    """Words of a tag: numbers spelled out, lemmatised, first occurrence kept."""
    text = strip(F.lower(F.replace(as_column(c), F.lit("_"), F.lit(" "))))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return dedupe_tokens(F.transform(words, lambda w: rule_lemma(number_to_word(w))))


def label_market(key: Column | str) -> Column:
    return F.when(F.lower(as_column(key)).contains("india"), "India").otherwise("Global")


def derive_gender(category: Column | str) -> Column:
    return F.lower(F.split_part(as_column(category), F.lit(" - "), F.lit(1)))


def decoded_path(path: Column | str) -> Column:
    """File metadata is URL-encoded, except that a literal plus stays a plus."""
    return F.url_decode(F.replace(as_column(path), F.lit("+"), F.lit("%2B")))


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def safe_name(c: Column | str) -> Column:
    return F.replace(as_column(c), F.lit(" "), F.lit("_"))


def is_blank(c: Column | str) -> Column:
    c = as_column(c)
    return c.isNull() | (strip(c) == "")
