"""One query per operator or step: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendloom.functions import answers as ans, text as tx, vectors as vec
from trendloom.functions import vocabulary as voc
from trendloom.operators import aggregates as agg, corpus, filters, joins, ranking, requests, reshape
from trendloom.operators.describe import concat_description
from trendloom.operators.lemmas import apply_lemma_rules, fit_lemma_rules
from trendloom.operators.similarity import similarity_join
from trendloom.operators.sizing import semi_by, spread_scan
from trendloom.plans import matching, trends as trend_plans
from trendloom.schemas import TAGS_CSV
from trendloom.session import cut_lineage, scratch_path
from trendloom.sources import readers, together, writers
from trendloom.streaming.incremental import embed_arrivals, incremental_embed, skip_done
from trendloom.streaming.ledger import ledger_news, status_news, track_batches, tracked_states
from trendloom.workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# --- vectors and similarity ---------------------------------------------------


@query
def l2_normalize(spark, sf):
    e = views.table(spark, sf, "embeddings")
    doubled = F.transform(vec.to_doubles("embedding"), lambda x: x * 2)
    unit = e.select("vec_id", F.posexplode(vec.l2_normalize(doubled)).alias("place", "x"))
    return unit.select("vec_id", "place", r6("x"))


@query
def mean_pool_by_label(spark, sf):
    e = views.table(spark, sf, "embeddings")
    e = e.withColumn("mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    pooled = agg.mean_pool(e, ["label"], "embedding", mask="mask")
    return pooled.select("label", F.posexplode("embedding").alias("place", "x")).select(
        "label", "place", r6("x"))


@query
def parse_vector(spark, sf):
    e = views.table(spark, sf, "embeddings")
    text = F.concat(F.lit("["), F.array_join(e["embedding"].cast("array<string>"), ", "), F.lit("]"))
    parsed = e.select("vec_id", vec.parse_vector(text).alias("v"))
    places = parsed.select("vec_id", F.posexplode("v").alias("place", "x"))
    return places.withColumn("x", F.col("x").cast("float"))


@query
def similarity_scores(spark, sf):
    """Items against all tags of all categories."""
    tags = joins.global_tag_vectors(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["vec_id"], on=None)
    return pairs.select("vec_id", "tag", r6("score"))


@query
def similarity_in_category(spark, sf):
    tags = matching.category_tags(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["vec_id"])
    return pairs.select("vec_id", "category", "tag", r6("score"))


@query
def similarity_native_kernel(spark, sf):
    tags = matching.category_tags(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["vec_id"], weight="confidence", kernel="native")
    return pairs.select("vec_id", "category", "tag", r6("score"))


@query
def weighted_similarity(spark, sf):
    tags = matching.category_tags(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["vec_id"], weight="confidence")
    return pairs.select("vec_id", "category", "tag", r6("score"))


@query
def max_score_per_product_tag(spark, sf):
    tags = matching.category_tags(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["product_id"], weight="confidence")
    return agg.max_score(pairs).select("category", "product_id", "tag", r6("confidence"))


@query
def min_score_filter(spark, sf):
    tags = matching.category_tags(views.tags(spark, sf))
    pairs = similarity_join(views.items(spark, sf), tags, ["product_id"], weight="confidence")
    kept = filters.filter_min_score(agg.max_score(pairs), 0.1)
    return kept.select("category", "product_id", "tag", r6("confidence"))


def _candidates(spark, sf, k=None):
    return matching.prefilter(views.items(spark, sf), views.tags(spark, sf), k=k)


@query
def candidates_with_region(spark, sf):
    return _candidates(spark, sf).select(
        "product_id", "category", "tag", "region", "tag_embedding_text", r6("confidence"))


@query
def attach_tag_meta(spark, sf):
    scores = views.tag_groups(spark, sf).select(
        "vec_id", views.pick(voc.CATEGORIES, F.col("vec_id") % 16).alias("category"),
        F.concat(F.lit("tag_"), (F.col("vec_id") % 40).cast("string")).alias("tag"))
    return joins.attach_tag_meta(scores, views.tags(spark, sf))


@query
def attach_tag_vector(spark, sf):
    trends = views.part_trends(spark, sf).drop("embedding")
    done = trend_plans.embed_trends(trends, views.ENCODER)
    places = done.select("pos", "tag", "category", "region", F.posexplode("embedding").alias("place", "x"))
    return places.where("x != 0").withColumn("x", F.round("x", 6))


@query
def lookup_tag_vector(spark, sf):
    rows = views.catalog(spark, sf).select("product_id", "pos", F.replace(
        F.col("normalised_name"), F.lit(" "), F.lit("_")).alias("tag"))
    found = joins.lookup_tag_vector(rows, views.part_trends(spark, sf))
    places = found.select("product_id", "pos", "tag", F.posexplode_outer("embedding").alias("place", "x"))
    return places.where("x is null or x != 0").withColumn("x", F.round("x", 6))


@query
def prefilter_topk(spark, sf):
    best = ranking.top_k(_candidates(spark, sf, 5000), k=5000)
    return ranking.sort_mapping(best.select("product_id", "category", "tag", "region", "confidence"),
                                "confidence").withColumn("confidence", F.round("confidence", 6))


@query
def top_candidates(spark, sf):
    """Best 5000 products per tag and category of the whole catalog, by text."""
    best = ranking.top_k(_text_candidates(spark, sf, 5000), k=5000)
    return best.select("product_id", "category", "tag", r6("confidence"))


@query
def cosine_rerank_top(spark, sf):
    """Items against the centroid of their label, not weighted, best 15 per category."""
    rows = views.items(spark, sf).join(
        views.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    centroids = agg.mean_pool(views.tag_groups(spark, sf), ["label"], "embedding", out="t_vec")
    both = joins.lookup_join(rows, centroids, ["label"])
    scored = both.withColumn("cosine_similarity", vec.stable(
        vec.cosine(vec.to_doubles("text_embedding"), F.col("t_vec"))))
    best = ranking.top_k(scored, ["category"], "cosine_similarity", 15, "vec_id")
    return best.select("vec_id", "product_id", "category", r6("cosine_similarity"))


@query
def scores_wide_unpivot(spark, sf):
    scores = _candidates(spark, sf).select("category", "product_id", "tag", "confidence")
    wide = reshape.scores_to_wide(scores, keys=["category", "product_id"])
    return reshape.melt_scores(wide, ["category", "product_id"]).select(
        "category", "product_id", "tag", r6("confidence"))


# --- thresholds, denylist, audits ---------------------------------------------


def _part_scores(spark, sf):
    """One score per part and category, some parts under a denied tag."""
    key = F.col("p_partkey")
    names = [*voc.DENIED_TAGS, *[t.replace("_", " ") for t in voc.DENIED_TAGS], "jacket style_x",
             "abstract motif_print"]
    return views.table(spark, sf, "part").select(
        key.alias("product_id"), views.pick(voc.CATEGORIES, key % 16).alias("category"),
        F.coalesce(views.pick(names, key % 23), F.col("p_name")).alias("tag"),
        (F.col("p_size") / 100.0).alias("confidence"))


@query
def category_threshold(spark, sf):
    return filters.filter_category_threshold(_part_scores(spark, sf), views.thresholds(spark))


@query
def unmatched_categories(spark, sf):
    return filters.unmatched_categories(_part_scores(spark, sf), views.thresholds(spark))


@query
def threshold_audit(spark, sf):
    joined = joins.attach_threshold(_part_scores(spark, sf), views.thresholds(spark))
    return agg.filter_audit(
        joined, F.col("confidence") >= F.col("threshold"), ["category"])


@query
def denylist(spark, sf):
    return filters.filter_denylist(_part_scores(spark, sf))


@query
def base_threshold(spark, sf):
    scores = _part_scores(spark, sf).withColumn("confidence", F.col("confidence") - 0.75)
    return filters.filter_base_threshold(scores, -0.5).select("product_id", r6("confidence"))


@query
def attach_description(spark, sf):
    number = F.col("vec_id") % 60
    rows = views.items(spark, sf).select(
        "vec_id", F.concat(F.lit("text "), number.cast("string")).alias("tag_embedding_text"),
        views.region_of(number).alias("region"), "category")
    return joins.attach_description(rows, views.tags(spark, sf))


@query
def missing_description_count(spark, sf):
    done = matching.apply_thresholds(_candidates(spark, sf), views.thresholds(spark), views.tags(spark, sf))
    return agg.count_missing(done, "description")


@query
def thresholded_candidates(spark, sf):
    done = matching.apply_thresholds(_candidates(spark, sf), views.thresholds(spark), views.tags(spark, sf))
    return done.select("product_id", "category", "tag", "region", "description", r6("confidence"))


@query
def threshold_pushdown(spark, sf):
    """Thresholds applied inside the scoring: the same candidates, fewer rows."""
    done = matching.prefilter(views.items(spark, sf), views.tags(spark, sf), thresholds=views.thresholds(spark))
    return done.select("product_id", "category", "tag", "region", r6("confidence"))


@query
def count_by_category(spark, sf):
    return agg.count_by_category(_candidates(spark, sf))


# --- descriptions --------------------------------------------------------------


@query
def attribute_allowlist(spark, sf):
    return filters.filter_attribute_types(views.catalog(spark, sf)).select(
        "product_id", "pos", "standardize_type_updated", "normalised_name")


@query
def concat_distinct(spark, sf):
    return agg.concat_distinct(views.repeated_attributes(spark, sf),
                               ["product_id", "standardize_type_updated"], "normalised_name", "pos")


@query
def product_description(spark, sf):
    return concat_description(views.repeated_attributes(spark, sf))


@query
def catalog_description(spark, sf):
    cheap = _part_scores(spark, sf).where("confidence >= 0.2")
    return matching.describe_products(views.catalog(spark, sf), cheap)


@query
def bucketed_description(spark, sf):
    """The descriptions out of a catalog table bucketed by product, which is read without a shuffle."""
    name = f"catalog_{uuid.uuid4().hex}"
    together = writers.write_bucketed(views.catalog(spark, sf), name, scratch_path(spark, name), buckets=16)
    cheap = _part_scores(spark, sf).where("confidence >= 0.2")
    return matching.describe_products(spark.table(name), cheap, together)


@query
def catalog_for_candidates(spark, sf):
    discounted = views.table(spark, sf, "lineitem").where("l_discount >= 0.1").select(
        F.col("l_partkey").alias("product_id"))
    return semi_by(views.catalog(spark, sf), discounted, "product_id").select("product_id", "pos")


@query
def count_distinct_products(spark, sf):
    return agg.count_distinct_products(views.repeated_attributes(spark, sf))


@query
def dedupe_first(spark, sf):
    li = views.table(spark, sf, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    return ranking.dedupe_first(li, ["l_partkey"], order).drop("l_shipdate")


@query
def dedupe_last(spark, sf):
    li = views.table(spark, sf, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    return ranking.first_last_per_key(li, ["l_partkey"], order, "last").drop("l_shipdate")


# --- text ------------------------------------------------------------------------


@query
def embedding_text_raw(spark, sf):
    raw = tx.embedding_text_raw("normalised_name", "standardize_type_updated")
    return views.catalog(spark, sf).where("normalised_name is not null").select(
        "product_id", "pos", raw.alias("raw"))


@query
def clean_text(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(tx.clean_attribute_text("text")).alias("digest"),
                       F.length(tx.clean_attribute_text("text")).alias("n"))


@query
def phrase_rules(spark, sf):
    rows = views.catalog(spark, sf).where("normalised_name is not null")
    return rows.select("product_id", "pos", tx.apply_phrases(F.lower("normalised_name")).alias("text"))


@query
def number_words(spark, sf):
    words = spread_scan(views.table(spark, sf, "documents")).select(
        "doc_id", F.explode(tx.tokenize(F.lower("text"))).alias("token"))
    numbers = words.where(tx.is_number_like("token"))
    return numbers.groupBy("token", tx.number_to_word("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def normalize_text(spark, sf):
    docs = spread_scan(views.table(spark, sf, "documents"))
    done = docs.select("doc_id", tx.normalize_text("text", tx.category_stop_words("source")).alias("text"))
    return done.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query
def catalog_text(spark, sf):
    return matching.catalog_texts(views.catalog(spark, sf)).select("product_id", "pos", "embedding_text")


@query
def dictionary_text(spark, sf):
    """Distinct catalog texts with lemmas from a table made of the part names."""
    raw = tx.embedding_text_raw("normalised_name", "standardize_type_updated")
    texts = views.catalog(spark, sf).where("normalised_name is not null").select(
        raw.alias("raw")).distinct()
    words = views.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    lemmas = words.select("token", F.concat(F.lit("x"), "token").alias("lemma"))
    return corpus.normalize_with_dictionary(texts, "raw", ["raw"], lemmas)


@query
def learned_lemmas(spark, sf):
    """Lemmas of all words of the documents by rules learned from three quarters of them."""
    docs = spread_scan(views.table(spark, sf, "documents"))
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    words = docs.select(F.explode(words).alias("token")).distinct()
    words = cut_lineage(words.withColumn("known", F.left(F.md5("token"), F.lit(1)) < "c"), "words")
    rules = fit_lemma_rules(words.where("known").select("token", tx.rule_lemma("token").alias("lemma")))
    return apply_lemma_rules(words, rules)


@query
def learned_tags(spark, sf):
    """Part names as tags, with lemmas from a table of their words where those are short, and learned rules beyond."""
    tags = views.table(spark, sf, "part").select(
        F.concat_ws("_", "p_name", "p_type", F.lit("2nd")).alias("tag")).distinct()
    words = tags.select(F.explode(F.split(F.lower("tag"), "[_ ]+")).alias("token")).distinct()
    lemmas = words.where("length(token) BETWEEN 4 AND 6").select("token", F.expr("left(token, length(token) - 1)").alias("lemma"))
    return corpus.normalize_tags(tags, "tag", lemmas, fit_lemma_rules(lemmas))


@query
def normalize_tag(spark, sf):
    rows = views.table(spark, sf, "part").select(
        F.concat_ws("_", "p_name", "p_type", F.col("p_size").cast("string"), F.lit("2nd Dresses  small")).alias("tag"))
    return rows.distinct().select("tag", tx.normalize_tag("tag").alias("preprocessed_tag"))


@query
def category_stop_words(spark, sf):
    names = views.catalog(spark, sf).select(F.concat_ws(" - ", "category", "normalised_name").alias("category"))
    return names.distinct().select("category", F.explode(tx.category_stop_words("category")).alias("lemma"))


@query
def dedupe_tokens(spark, sf):
    docs = spread_scan(views.table(spark, sf, "documents"))
    done = docs.select("doc_id", tx.dedupe_tokens(tx.tokenize(F.lower("text"))).alias("text"))
    return done.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


# --- encoding and the mapping ------------------------------------------------------


@query
def hash_embed(spark, sf):
    rows = corpus.embed_texts(matching.catalog_texts(views.catalog(spark, sf)), "embedding_text", views.ENCODER)
    texts = rows.groupBy("embedding_text").agg(
        F.count(F.lit(1)).alias("rows"), F.first("text_embedding").alias("v"))
    places = texts.select("embedding_text", "rows", F.posexplode("v").alias("place", "x"))
    return places.where("x != 0").select("embedding_text", "rows", "place", r6("x"))


@query
def model_embed(spark, sf):
    """The vectors of `hash_embed` out of a model that does not bring them to unit length."""
    rows = matching.catalog_texts(views.catalog(spark, sf)).groupBy("embedding_text").agg(F.count(F.lit(1)).alias("rows"))
    texts = corpus.embed_texts(rows, "embedding_text", views.MODEL, "v")
    places = texts.select("embedding_text", "rows", F.posexplode("v").alias("place", "x"))
    return places.where("x != 0").select("embedding_text", "rows", "place", r6("x"))


@query
def token_embed(spark, sf):
    """Vectors of whole documents out of a model of token ids, batched by length."""
    docs = corpus.embed_texts(views.table(spark, sf, "documents").select("doc_id", "text"), "text", views.TOKEN_MODEL, "v")
    return docs.select("doc_id", F.posexplode("v").alias("place", "x")).select("doc_id", "place", r6("x"))


def _text_candidates(spark, sf, k=None):
    rows = matching.catalog_texts(views.catalog(spark, sf))
    return matching.prefilter_texts(rows, views.part_trends(spark, sf), views.ENCODER, k=k)


@query
def catalog_candidates(spark, sf):
    """Candidates of the text catalog, each distinct text scored once."""
    return _text_candidates(spark, sf).select(
        "product_id", "category", "tag", "region", "tag_embedding_text", r6("confidence"))


@query
def catalog_candidates_by_row(spark, sf):
    """The same candidates, with a vector on each catalog row."""
    rows = matching.embed_catalog(views.catalog(spark, sf), views.ENCODER)
    done = matching.prefilter(rows, views.part_trends(spark, sf))
    return done.select("product_id", "category", "tag", "region", "tag_embedding_text", r6("confidence"))


def _mapping(spark, sf):
    rows = matching.catalog_texts(views.catalog(spark, sf))
    trends = cut_lineage(views.part_trends(spark, sf))
    thresholds = views.thresholds(spark)
    found = matching.prefilter_texts(rows, trends, views.ENCODER, thresholds=thresholds, k=5000)
    kept = matching.apply_thresholds(found, thresholds, ranking.dedupe_first(
        trends, ["tag_embedding_text", "region", "category"], ["pos"]))
    return matching.map_trends(kept, views.catalog(spark, sf), trends, views.ENCODER,
                               "2026-01-16", "2026-01-23"), trends


@query
def trend_product_mapping(spark, sf):
    mapping, _ = _mapping(spark, sf)
    return mapping.select("product_id", "category", "tag", "region", "description", "gender", "start_date",
                          "end_date", r6("confidence"), r6("cosine_similarity"))


@query
def tag_dim(spark, sf):
    """Tag rows whose name is also an attribute value somewhere in the catalog."""
    dim = trend_plans.tag_dimension(views.part_trends(spark, sf).withColumn("embedding", F.lit(None)))
    used = views.catalog(spark, sf).select(F.replace("normalised_name", F.lit(" "), F.lit("_")).alias("tag"))
    return joins.tags_in_output(dim, used).select("tag_value", "category", "tag_type", "tag")


@query
def mapping_tag_dim(spark, sf):
    """The tag table that is published with the mapping, read back."""
    mapping, trends = _mapping(spark, sf)
    folder = scratch_path(spark, "published")
    matching.publish(mapping, trends, f"{folder}/mapping", f"{folder}/tags")
    tags = spark.read.parquet(f"{folder}/tags")
    return tags.select("tag_value", "category", "tag_type", "tag")


@query
def published_together(spark, sf):
    """Tags and the products they are mapped to, from the pair of tables of the second of two runs."""
    trends = views.part_trends(spark, sf).withColumn("embedding", F.lit(None).cast("array<double>"))
    rows = views.catalog(spark, sf).select(
        "product_id", "category", F.replace("normalised_name", F.lit(" "), F.lit("_")).alias("tag"))
    root = scratch_path(spark, "together")
    matching.publish_together(rows.where("category = 'Women - Kurtas'"), trends, root)
    matching.publish_together(rows, trends, root)
    now = together.read_together(spark, root)
    products = now["mapping"].groupBy(F.col("tag").alias("name")).agg(F.count_distinct("product_id").alias("products"))
    return now["tags"].join(products, F.col("tag") == F.col("name")).select(
        "tag_value", "category", "tag_type", "tag", "products")


@query
def derive_gender(spark, sf):
    rows = filters.with_gender(filters.stamp_validity(_part_scores(spark, sf), "2026-01-16", "2026-01-23"))
    return rows.groupBy("category", "gender", "start_date", "end_date").agg(F.count(F.lit(1)).alias("rows"))


# --- trends, requests, answers -------------------------------------------------------


@query
def render_prompts(spark, sf):
    categories = views.table(spark, sf, "part").select(
        F.concat_ws(" - ", "p_type", "p_name").alias("category")).distinct()
    return requests.render_prompts(categories, "List trends for {category} as {{\"a\": [{category}]}}")


@query
def build_requests(spark, sf):
    turns = views.table(spark, sf, "conversations")
    image = F.when(F.col("turn") % 2 == 0, F.base64(F.encode(F.col("role"), "utf-8")))
    request = requests.build_request(F.concat_ws("-", "conv_id", "turn"), F.col("text"), F.lit("model-x"), image)
    path = "$.body.messages[0].content"
    return turns.select(
        "conv_id", "turn", request.alias("r")).select(
        "conv_id", "turn",
        F.get_json_object("r", "$.custom_id").alias("custom_id"),
        F.get_json_object("r", "$.url").alias("url"),
        F.get_json_object("r", "$.body.max_tokens").alias("max_tokens"),
        F.coalesce(F.get_json_object("r", f"{path}[0].text"), F.get_json_object("r", path)).alias("text"),
        F.get_json_object("r", f"{path}[1].image_url.url").alias("image"))


@query
def request_lines(spark, sf):
    """Requests written as JSON lines and read back."""
    turns = views.table(spark, sf, "conversations")
    path = scratch_path(spark, "requests")
    writers.write_requests(turns, path, requests.build_request(
        F.concat_ws("-", "conv_id", "turn"), "text", F.lit("model-x")))
    back = spark.read.schema(
        "custom_id string, body struct<model: string, messages: array<struct<role: string, content: string>>>"
    ).json(path)
    return back.select("custom_id", F.col("body.model").alias("model"),
                       F.get("body.messages", F.lit(0))["content"].alias("text"))


@query
def strip_fence(spark, sf):
    return views.answers(spark, sf).select(
        "conv_id", "turn", F.md5(ans.strip_code_fence("response")).alias("digest"))


@query
def extract_answer_text(spark, sf):
    return views.answers(spark, sf).select("conv_id", "turn", ans.extract_answer_text(
        ans.strip_code_fence("response"), by_type=True).alias("answer"))


@query
def valid_answers(spark, sf):
    good, _ = requests.split_valid_json(views.answers(spark, sf))
    return good.select("conv_id", "turn", F.get_json_object("trends_json", "$.t").cast("long").alias("t"),
                       F.get_json_object("trends_json", "$.text").alias("text"))


@query
def rejected_answers(spark, sf):
    _, rejects = requests.split_valid_json(views.answers(spark, sf))
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


_TREND_COLUMNS = ["category", "market", "trend_name", "primary_hashtag", "aesthetic_description"]


@query
def flatten_trends(spark, sf):
    flat = reshape.flatten_markets(views.trend_files(spark, sf))
    return flat.select(*_TREND_COLUMNS, "market_key", "trend_no", "confidence",
                       F.array_join("supporting_hashtags", "|").alias("hashtags"))


@query
def flatten_trends_messy(spark, sf):
    """Trends out of files of which six in seven have some defect."""
    flat = reshape.flatten_markets(views.messy_trend_files(spark, sf))
    return flat.select(*_TREND_COLUMNS, "market_key", "trend_no", "confidence",
                       F.array_join("supporting_hashtags", "|").alias("hashtags"), F.to_json("extra").alias("extra"))


@query
def trend_file_rejects(spark, sf):
    rejects = reshape.market_rejects(views.messy_trend_files(spark, sf))
    return rejects.select("category", "market_key", "trend_no", "reject_reason", F.length("refused").alias("n"))


@query
def curate_twice(spark, sf):
    """All answers curated, then some of them again, with other texts: the rest stays as it was."""
    folder = scratch_path(spark, "curated")
    answers = views.trend_answers(spark, sf)
    trend_plans.curate_trends(answers, folder)
    again = answers.where(F.col("category").startswith("b")).withColumn(
        "response", F.replace("response", F.lit(" Look"), F.lit(" Mood")))
    trend_plans.curate_trends(again, folder)
    return trend_plans.flat_trends(spark, folder).select(*_TREND_COLUMNS, "market_key", "trend_no")


@query
def thresholds_file(spark, sf):
    """Thresholds read from a file whose columns stand in another order."""
    path = scratch_path(spark, "thresholds")
    views.threshold_rows(spark).select("status", "threshold", "category").write.option("header", True).csv(path)
    return readers.read_thresholds(spark, path)


@query
def trends_csv_by_name(spark, sf):
    """Processed trends with vectors in text form, written in another order of columns."""
    path = scratch_path(spark, "tags-csv")
    trends = views.part_trends(spark, sf)
    vector = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), " "), F.lit("]"))
    trends.select(vector.alias("embedding"), "pos", *reversed([c for c in TAGS_CSV.names if c != "embedding"])).write.option(
        "header", True).option("escape", '"').csv(path)
    back = readers.read_trends_csv(spark, path, TAGS_CSV)
    places = back.select("tag", "category", "region", "description", F.posexplode("embedding").alias("place", "x"))
    return places.where("x != 0").withColumn("x", F.round("x", 6))


@query
def consolidate_trends(spark, sf):
    """Trend files written, read back, flattened, written as CSV and read back."""
    folder, csv = scratch_path(spark, "trend-json"), scratch_path(spark, "trend-csv")
    writers.write_trend_json(views.trend_files(spark, sf), folder, "value")
    trend_plans.consolidate_trends(spark, folder, csv)
    back = readers.read_trends_csv(spark, csv)
    hashtags = F.array_join(F.from_json("supporting_hashtags", "array<string>"), "|")
    return back.select(*_TREND_COLUMNS, F.col("confidence").try_cast("double").alias("confidence"),
                       hashtags.alias("hashtags"))


@query
def curate_trends(spark, sf):
    """Answers turned into trend files; the trends the folder then holds."""
    folder = scratch_path(spark, "curated")
    trend_plans.curate_trends(views.trend_answers(spark, sf), folder)
    return trend_plans.flat_trends(spark, folder).select(*_TREND_COLUMNS, "market_key", "trend_no")


@query
def canonical_trends(spark, sf):
    flat = reshape.flatten_markets(views.trend_files(spark, sf))
    return trend_plans.canonicalize_trends(flat).select(
        "category", "region", "trend_no", "tag", "preprocessed_tag", "description")


@query
def label_market(spark, sf):
    e = views.table(spark, sf, "events")
    key = F.when(e["event_id"] % 2 == 0, F.concat(F.lit("trends_INDIA_"), "event_type")).otherwise(e["event_type"])
    return e.select(tx.label_market(key).alias("market"), "event_type").groupBy("market", "event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query
def union_by_name(spark, sf):
    parts = views.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    customers = views.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return reshape.union_all([parts, customers])


@query
def set_union(spark, sf):
    words = views.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("lemma"))
    types = views.table(spark, sf, "part").select(F.lower("p_type").alias("lemma"))
    return reshape.set_union(words, types)


# --- files, ledger, increments ----------------------------------------------------------


@query
def pending_files(spark, sf):
    files = views.table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_name"))
    done = views.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file_name"))
    return joins.pending(files, done)


@query
def pending_requests(spark, sf):
    """The first 500 request files by name, less those already submitted."""
    files = views.table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("jsonl_file"))
    submitted = views.ledger(spark, sf).where("batch.status != 'expired'")
    return joins.pending(ranking.limit_files(files, 500), submitted, "jsonl_file")


@query
def batch_state(spark, sf):
    return requests.batch_state(views.ledger(spark, sf), views.batch_status(spark, sf))


@query
def batch_states_tracked(spark, sf):
    """`batch_state` out of messages that arrive in two parts; batches that were left open long ago are overdue."""
    src, out, log = (scratch_path(spark, n) for n in ("messages", "changes", "progress"))
    logged = views.table(spark, sf, "events").select(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("id"), "ts")
    lines = ledger_news(views.ledger(spark, sf).join(logged, F.col("batch.id") == logged["id"]), F.col("ts").cast("timestamp"))
    heard = status_news(views.batch_status(spark, sf), F.lit("2999-01-01").cast("timestamp"))
    news = lines.unionByName(heard)
    for part in (0, 1):
        mine = F.pmod(F.crc32("id") + F.col("jsonl_file").isNull().cast("int"), F.lit(2)) == part
        news.where(mine).write.mode("append").parquet(src)
        track_batches(spark, src, out, log, timedelta(hours=1))
    return tracked_states(spark, out)


@query
def batch_state_counts(spark, sf):
    return requests.state_counts(requests.batch_state(views.ledger(spark, sf)))


@query
def ledger_roundtrip(spark, sf):
    """Ledger appended twice and read back, with malformed lines among its own."""
    path = scratch_path(spark, "ledger")
    rows = views.ledger(spark, sf)
    writers.append_ledger(rows.where("batch.status != 'failed'"), path)
    writers.append_ledger(rows.where("batch.status = 'failed'"), path)
    broken = rows.select(F.concat(F.lit('{"jsonl_file": '), "jsonl_file").alias("value"))
    broken.write.mode("append").text(path)
    back = readers.read_ledger(spark, path)
    return back.select("jsonl_file", "batch.id", "batch.status")


@query
def catalog_roundtrip(spark, sf):
    """Catalog written by category, read back with the category from the folder."""
    root = scratch_path(spark, "catalog")
    writers.write_partitioned(views.catalog(spark, sf), root)
    return readers.read_catalog(spark, root).select("category", "product_id", "pos", "normalised_name")


@query
def filter_category(spark, sf):
    return filters.filter_category(views.catalog(spark, sf), "Women - Jeans & Jeggings").select(
        "category", "product_id", "pos", "normalised_name")


@query
def category_folders(spark, sf):
    """Candidate files below category folders, and one beside them."""
    root = scratch_path(spark, "folders")
    scores = _part_scores(spark, sf)
    writers.write_partitioned(scores, root)
    scores.select("product_id", "tag", "confidence").write.mode("append").parquet(root)
    back = readers.read_category_dirs(spark, root)
    return back.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("product_id").alias("products"))


@query
def single_table(spark, sf):
    path = scratch_path(spark, "table")
    writers.write_table(_part_scores(spark, sf), path)
    return spark.read.parquet(path).select("product_id", "category", "tag")


@query
def skip_done_categories(spark, sf):
    """Categories that have output already are left out of a rerun."""
    root = scratch_path(spark, "done")
    scores = _part_scores(spark, sf)
    writers.write_partitioned(scores.where(F.col("category").startswith("Women")), root)
    return skip_done(scores, root).groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


@query
def column_defaults(spark, sf):
    """Scores without category and confidence get both."""
    bare = views.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_type")
    done = filters.add_missing_category(bare, F.concat(F.lit("Men - "), F.col("p_type")))
    done = filters.default_confidence(done)
    return filters.require_columns(done, "category", "confidence").select("product_id", "category", "confidence")


@query
def file_names(spark, sf):
    """Base names, stems and safe names of the pages' addresses."""
    url = F.col("url")
    return views.table(spark, sf, "pages").select(
        "page_id", tx.base_name(url).alias("base"), tx.file_stem(url).alias("stem"),
        tx.safe_name(F.replace(url, F.lit("/"), F.lit(" "))).alias("safe"))


@query
def incremental_catalog(spark, sf):
    """Catalog files arriving twice, read, embedded row by row and written by category."""
    src, out, log = (scratch_path(spark, n) for n in ("arrivals", "embedded", "progress"))
    catalog = views.catalog(spark, sf)
    for part in (0, 1):
        catalog.where(F.col("product_id") % 2 == part).write.mode("append").partitionBy("category").parquet(src)
        incremental_embed(spark, src, out, log, lambda df: matching.embed_rows(df, views.MODEL), catalog.schema)
    places = readers.read_catalog(spark, out).select(
        "category", "product_id", "pos", "embedding_text", F.posexplode("text_embedding").alias("place", "x"))
    return places.where("x != 0").withColumn("x", F.round("x", 6))


@query
def incremental_vectors(spark, sf):
    """Catalog files arriving twice; a text that is known from the first arrival is not encoded again."""
    src, out, vectors, log = (scratch_path(spark, n) for n in ("arrivals", "embedded", "vectors", "progress"))
    catalog = views.catalog(spark, sf)
    for part in (0, 1):
        catalog.where(F.col("product_id") % 2 == part).write.mode("append").partitionBy("category").parquet(src)
        embed_arrivals(spark, src, out, vectors, log, matching.catalog_texts, views.MODEL, catalog.schema)
    places = readers.read_catalog(spark, out).select(
        "category", "product_id", "pos", "embedding_text", F.posexplode("text_embedding").alias("place", "x"))
    return places.where("x != 0").withColumn("x", F.round("x", 6))


@query
def filters_observed(spark, sf):
    """Rows in, kept and dropped by each of two filters, counted while the kept rows are written."""
    kept, seen = agg.observed_filters(views.table(spark, sf, "lineitem"), [
        ("discounted", F.col("l_discount") >= 0.05), ("returned", F.col("l_returnflag") == "R")])
    cut_lineage(kept.select("l_orderkey"), "kept")
    rows = [tuple(r.values()) for r in agg.filter_report(seen)]
    return spark.createDataFrame(rows, "filter string, rows_in bigint, rows_kept bigint, rows_dropped bigint")


@query
def incremental_texts(spark, sf):
    """Documents arriving as files, each processed once over two runs."""
    src, out = scratch_path(spark, "arrivals"), scratch_path(spark, "embedded")
    log = scratch_path(spark, "progress")
    docs = spread_scan(views.table(spark, sf, "documents")).select("doc_id", "lang", "text")

    def transform(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "lang", F.md5(tx.normalize_text("text")).alias("digest"))

    for part in (0, 1):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).write.mode("append").parquet(src)
        incremental_embed(spark, src, out, log, transform, docs.schema, partition_by="lang")
    return spark.read.parquet(out).select("doc_id", "lang", "digest")
