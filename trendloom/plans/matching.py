"""Catalog embedding, candidate search, thresholds and the final mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from trendloom.functions import vocabulary as voc
from trendloom.functions.encoders import Encoder
from trendloom.functions.text import category_stop_words, embedding_text_raw, normalize_text
from trendloom.functions.vectors import cosine_from_norms, norm, stable, to_doubles
from trendloom.operators import filters
from trendloom.operators.aggregates import max_score, observed_filters
from trendloom.operators.best import best_of_texts, best_pairs
from trendloom.operators.corpus import embed_texts, normalize_with_dictionary
from trendloom.operators.describe import concat_description
from trendloom.operators.joins import (attach_description, attach_product_vector, attach_threshold, global_tag_vectors,
                                       lookup_tag_vector, semi_by, tag_meta, tags_in_output)
from trendloom.operators.ranking import top_k
from trendloom.operators.similarity import similarity_join
from trendloom.operators.sizing import derive_once, lookup_join, skew_join
from trendloom.plans.trends import tag_dimension
from trendloom.session import cut_lineage
from trendloom.sources.together import write_together
from trendloom.sources.writers import write_table

POS = ("pos",)


_RAW = "__raw"


def _with_raw_text(catalog: DataFrame) -> DataFrame:
    """Attribute rows with their text as written; rows without a value are dropped."""
    rows = catalog.where(
        F.col("normalised_name").isNotNull() & F.col("standardize_type_updated").isNotNull())
    return rows.withColumn(_RAW, embedding_text_raw("normalised_name", "standardize_type_updated"))


def _normalized(texts: DataFrame, lemmas: DataFrame | None = None,
                stop_words: Sequence[str] = tuple(voc.STOP_WORDS)) -> DataFrame:
    stop = category_stop_words("category")
    if lemmas is None:
        return texts.withColumn("embedding_text", normalize_text(_RAW, stop, stop_words))
    texts = texts.withColumn("__stop", stop)
    return normalize_with_dictionary(texts, _RAW, ["category", _RAW], lemmas, stop_words, "__stop")


def catalog_texts(catalog: DataFrame, partitions: int | None = None, lemmas: DataFrame | None = None,
                  stop_words: Sequence[str] = tuple(voc.STOP_WORDS)) -> DataFrame:
    """Add the normalised text of each attribute row, worked out once per text and category.

    `lemmas(token, lemma)` goes before the rules for plurals and verb forms.
    """
    return derive_once(_with_raw_text(catalog), ["category", _RAW],
                       lambda texts: _normalized(texts, lemmas, stop_words), partitions).drop(_RAW)


def embed_catalog(catalog: DataFrame, encoder: Encoder, partitions: int | None = None,
                  lemmas: DataFrame | None = None, stop_words: Sequence[str] = tuple(voc.STOP_WORDS)) -> DataFrame:
    """Catalog rows with their text and its vector, both joined back in one go."""

    def derive(texts: DataFrame) -> DataFrame:
        texts = cut_lineage(_normalized(texts, lemmas, stop_words))
        return embed_texts(texts, "embedding_text", encoder, partitions=partitions)

    return derive_once(_with_raw_text(catalog), ["category", _RAW], derive, partitions).drop(_RAW)


def embed_rows(catalog: DataFrame, encoder: Encoder) -> DataFrame:
    """`embed_catalog` row by row, without joins, as a stream of arriving files needs it."""
    rows = _normalized(_with_raw_text(catalog)).drop(_RAW)
    return rows.withColumn("text_embedding", encoder(F.col("embedding_text")))


def category_tags(trends: DataFrame, order_by: Sequence[str] = POS,
                  thresholds: DataFrame | None = None) -> DataFrame:
    """Tags to score per category, with the metadata their candidates will carry.

    A tag's vector is that of its first entry in any category; region and
    text are those of its first entry in this one. Entries without a region
    are dropped only then. `floor` is the category's threshold, if given.
    """
    meta = tag_meta(trends, order_by)
    tags = meta.where(F.col("region").isNotNull()).join(
        global_tag_vectors(trends, order_by), ["tag"])
    if thresholds is None:
        return tags.withColumn("floor", F.lit(None).cast("double"))
    return (tags.join(thresholds.select("category", F.col("threshold").alias("floor")), ["category"], "left")
            .withColumn("floor", F.coalesce("floor", F.lit(0.0))))


def _candidates(scores: DataFrame, tags: DataFrame, *more: str) -> DataFrame:
    meta = tags.select("category", "tag", "region", "tag_embedding_text", *more)
    return lookup_join(max_score(scores), meta, ["category", "tag"], "inner").select(
        "product_id", "confidence", "tag", "region", "tag_embedding_text", "category", *more)


def prefilter(items: DataFrame, trends: DataFrame, above: float = 0.0,
              order_by: Sequence[str] = POS, thresholds: DataFrame | None = None,
              kernel: str = "arrow", k: int | None = None) -> DataFrame:
    """Best weighted score per product and tag out of catalog rows with vectors.

    Only tags of the row's own category are scored. Cutting at `above`, and
    at the thresholds where they are given, before the maximum is taken
    leaves the same candidates as cutting after it. With `k` the arrow kernel
    leaves out what is not among the k best products of a tag in its category,
    so `top_k` with no more than k gives the same as without.
    """
    filters.require_columns(items, "product_id", "category", "text_embedding")
    tags = cut_lineage(category_tags(trends, order_by, thresholds))
    items = filters.default_confidence(items)
    if kernel == "arrow":
        scores = best_pairs(items, tags, weight="confidence", above=above, floor="floor", k=k)
    else:
        scores = similarity_join(items, tags, ["product_id"], weight="confidence", above=above, floor="floor", kernel=kernel)
    return _candidates(scores, tags)


def prefilter_texts(catalog: DataFrame, trends: DataFrame, encoder: Encoder,
                    order_by: Sequence[str] = POS, thresholds: DataFrame | None = None,
                    partitions: int | None = None, kernel: str = "arrow", k: int | None = None) -> DataFrame:
    """The candidates of `prefilter`, without a vector per catalog row.

    Each distinct text of a category is encoded and scored once; catalog rows
    meet the finished scores. Weights keep their sign apart from their size:
    a negative weight times a negative cosine is positive.
    """
    key = ["category", "embedding_text", "sign"]
    weight = F.col("confidence").cast("double")
    # the catalog with its texts is worked out once; what follows reads four columns of it
    rows = cut_lineage(
        filters.default_confidence(catalog)
        .where(F.col("product_id").isNotNull() & F.col("embedding_text").isNotNull() & (weight != 0))
        .select("category", "embedding_text", F.signum(weight).alias("sign"), "product_id",
                F.abs(weight).alias("weight")), "texts")
    tags = cut_lineage(category_tags(trends, order_by, thresholds))
    texts = embed_texts(rows.select(*key).distinct(), "embedding_text", encoder, partitions=partitions)
    texts = texts.withColumn(
        "text_embedding", F.transform(to_doubles("text_embedding"), lambda x: x * F.col("sign")))
    if kernel == "arrow":
        bounded = tags.withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        return _candidates(best_of_texts(rows, texts, bounded, key, floor="floor", k=k,
                                         join=lambda a, b, on: skew_join(a, b, on, "inner")), tags)
    scored = similarity_join(texts, tags, key, above=0.0, kernel=kernel, digits=None)
    packed = scored.groupBy(*key).agg(F.collect_list(F.struct("tag", "score")).alias("scores"))
    floors = tags.select("category", "floor").distinct()
    packed = lookup_join(packed, floors, ["category"])
    pairs = skew_join(rows, packed, key, "inner").select(
        "category", "product_id", "weight", "floor", F.inline("scores"))
    # rounding keeps the order, so it can wait for the maximum; the cut before
    # it leaves room for what rounding adds
    scores = pairs.withColumn("score", F.col("score") * F.col("weight")).where(
        "score > 0 and score >= coalesce(floor, 0.0) - 1e-6")
    found = _candidates(scores, tags, "floor").withColumn("confidence", stable("confidence"))
    return found.where("confidence > 0 and confidence >= coalesce(floor, 0.0)").drop("floor")


def apply_thresholds(candidates: DataFrame, thresholds: DataFrame | None, trends: DataFrame) -> DataFrame:
    """Candidates at or above their category's threshold, described, denied tags out."""
    kept = filters.filter_category_threshold(candidates, thresholds)
    return attach_description(filters.filter_denylist(kept), trends)


def apply_thresholds_observed(candidates: DataFrame, thresholds: DataFrame | None,
                              trends: DataFrame) -> tuple[DataFrame, Observation]:
    """`apply_thresholds`, with the rows that each filter keeps counted by the run that uses the result.

    See `filter_report` for reading the counts.
    """
    bound = candidates.withColumn("threshold", F.lit(None).cast("double")) if thresholds is None else attach_threshold(
        candidates, thresholds)
    kept, seen = observed_filters(bound, [
        ("category threshold", F.lit(True) if thresholds is None else F.col("confidence") >= F.col("threshold")),
        ("denied tags", filters.not_denied())], "thresholds")
    return attach_description(kept.drop("threshold"), trends), seen


def describe_products(catalog: DataFrame, candidates: DataFrame, together: bool = False) -> DataFrame:
    """Description of each candidate product out of the allowed attribute types.

    `together`: the catalog is a table bucketed by product (`write_bucketed`); it is not shuffled then.
    """
    rows = filters.filter_attribute_types(catalog).select(
        "product_id", "standardize_type_updated", "normalised_name", "pos")
    return concat_description(semi_by(rows, candidates, "product_id"), together=together)


def publish(mapping: DataFrame, trends: DataFrame, mapping_path: str, tags_path: str) -> None:
    """Write the mapping, and the rows of the tags that occur in it, as the two tables others read."""
    write_table(mapping, mapping_path)
    written = mapping.sparkSession.read.schema(mapping.schema).parquet(mapping_path)
    write_table(tags_in_output(tag_dimension(trends), written), tags_path)


def publish_together(mapping: DataFrame, trends: DataFrame, root: str) -> str:
    """`publish`, for readers of `read_together(spark, root)`, who see both tables change at once."""
    return write_together(mapping.sparkSession, {
        "mapping": mapping, "tags": lambda written: tags_in_output(tag_dimension(trends), written["mapping"])}, root)


def map_trends(candidates: DataFrame, catalog: DataFrame, trends: DataFrame, encoder: Encoder,
               start_date: str, end_date: str, first_k: int = 5000, final_k: int = 1000,
               order_by: Sequence[str] = POS, together: bool = False) -> DataFrame:
    """The best products per tag and category, ranked by description against tag.

    `together`: the catalog is bucketed by product, see `describe_products`. Pass filtered candidates to have thresholds and denied tags reach the
    mapping, or all of them to leave both out.
    """
    best = cut_lineage(top_k(candidates, k=first_k))
    described = describe_products(catalog, best, together)
    # saved, as a filter on the vector would have the encoder run for itself
    products = cut_lineage(described.where("product_id is not null and product_description is not null").select(
        "product_id", encoder(F.col("product_description")).cast("array<double>").alias("embeddings")), "products")
    products = products.withColumn("__product_norm", norm("embeddings"))
    vec = to_doubles("embedding")
    tags = trends.withColumn("__tag", F.struct(vec.alias("vec"), norm(vec).alias("norm")))
    ranked = lookup_tag_vector(attach_product_vector(best, products), tags, order_by, "__tag")
    ranked = ranked.withColumn("cosine_similarity", stable(cosine_from_norms(
        F.col("__tag.vec"), F.col("embeddings"), F.col("__tag.norm"), F.col("__product_norm"))))
    ranked = ranked.drop("embeddings", "__tag", "__product_norm")
    final = top_k(ranked, score="cosine_similarity", k=final_k)
    return filters.with_gender(filters.stamp_validity(final, start_date, end_date))
