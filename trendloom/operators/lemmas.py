"""Lemmas of words that no table holds, by rules for endings learned from a table that holds others.

A rule says how many characters of a word are cut off and what takes their
place. Rules hang on endings, as in a trie read from the back: the longest
ending of a word that has a rule decides, and the words of the table
themselves, behind a `^`, are the longest of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trendloom.operators.sizing import derive_once, lookup_join
from trendloom.session import cut_lineage

#: Characters of the longest ending that is not a whole word.
LONGEST = 6
#: Words that have to share an ending before it gets a rule.
MIN_WORDS = 2


def _endings(word: Column, shortest: Column, longest: int) -> Column:
    """The whole word behind its mark, and its endings of `shortest` to `longest` characters."""
    last = F.least(F.char_length(word), F.lit(longest))
    lengths = F.when(shortest <= last, F.sequence(shortest, last)).otherwise(F.array().cast("array<int>"))
    return F.array_append(F.transform(lengths, lambda n: F.right(word, n)), F.concat(F.lit("^"), word))


def _strongest(words: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rule of the longest ending that has one, for rows (keys, ending); `__rule` is null where none has."""
    found = lookup_join(words, rules.select("ending", "cut", "added"), ["ending"])
    rule = F.when(F.col("cut").isNotNull(), F.struct("cut", "added"))
    length = F.when(F.col("cut").isNotNull(), F.char_length("ending"))
    return found.groupBy(*keys).agg(F.max_by(rule, length).alias("__rule"))


def fit_lemma_rules(lemmas: DataFrame, longest: int = LONGEST, min_words: int = MIN_WORDS) -> DataFrame:
    """Rules (ending, cut, added, words) out of `lemmas(token, lemma)`.

    Every ending takes the rule that most of its words follow; of equally
    frequent ones the one that cuts less, then the later text in order. An
    ending does not vote on rules that cut beyond it, needs `min_words` words,
    and is left out where the next shorter ending says the same. Of a token
    with several lemmas the least counts; rows with a null or an empty token
    are passed over, and an empty table gives no rules.
    """
    pairs = (lemmas.select("token", "lemma").where("token <> '' AND lemma IS NOT NULL")
             .groupBy("token").agg(F.min("lemma").alias("lemma")))
    token, lemma = F.col("token"), F.col("lemma")
    lengths = F.sequence(F.lit(0), F.least(F.char_length(token), F.char_length(lemma)))
    kept = F.array_max(F.filter(lengths, lambda n: F.left(token, n) == F.left(lemma, n)))
    cut = pairs.select("token", "lemma", kept.alias("kept"))
    edits = cut.select("token", (F.char_length("token") - F.col("kept")).alias("cut"),
                       F.expr("substring(lemma, kept + 1)").alias("added"))
    shortest = F.greatest(F.col("cut"), F.lit(1))
    votes = edits.select("cut", "added", F.explode(_endings(F.col("token"), shortest, longest)).alias("ending"))
    counts = votes.groupBy("ending", "cut", "added").agg(F.count(F.lit(1)).alias("words"))
    strength = F.struct("words", -F.col("cut"), "added")
    best = (counts.groupBy("ending").agg(F.max_by(F.struct("cut", "added", "words"), strength).alias("rule"))
            .select("ending", "rule.*").where((F.col("words") >= min_words) | F.col("ending").startswith("^")))
    best = cut_lineage(best, "lemma_rules")
    # what the next shorter ending says: without its first character, which is the mark of a whole word
    word = F.col("ending").startswith("^")
    inner = F.expr("substring(ending, 2)")
    shorter = best.select(F.col("ending").alias("__of"), F.explode(
        F.filter(_endings(inner, F.lit(1), longest), lambda e: ~e.startswith("^"))).alias("ending"))
    parent = _strongest(shorter, best.where(~word), ["__of"]).withColumnRenamed("__of", "ending")
    said = F.col("__rule")
    same = F.when(said.isNull(), (F.col("cut") == 0) & (F.col("added") == "")).otherwise(
        (said["cut"] == F.col("cut")) & (said["added"] == F.col("added")))
    return lookup_join(best, parent, ["ending"]).where(~same).select("ending", "cut", "added", "words")


def apply_lemma_rules(tokens: DataFrame, rules: DataFrame, token: str = "token", out: str = "lemma",
                      longest: int = LONGEST) -> DataFrame:
    """Add the lemma of each token: by the longest ending that has a rule, else the token as it is.

    Each distinct token is looked up once. A null token has a null lemma.
    `longest` is that of the rules.
    """
    def derive(words: DataFrame) -> DataFrame:
        word = F.col(token)
        ends = words.select(token, F.explode(_endings(word, F.lit(1), longest)).alias("ending"))
        ruled = _strongest(ends, rules, [token])
        left = F.left(word, F.char_length(word) - F.col("__rule.cut"))
        return ruled.select(token, F.when(F.col("__rule").isNull(), word).otherwise(
            F.concat(left, F.col("__rule.added"))).alias(out))

    return derive_once(tokens, [token], derive)
