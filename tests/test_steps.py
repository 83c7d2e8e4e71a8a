"""Files, increments and the steps of the weekly run."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trendloom import session
from trendloom.functions.encoders import hash_encoder, model_encoder
from trendloom.functions.text import normalize_text
from trendloom.operators import aggregates as agg, filters, joins, requests
from trendloom.operators.similarity import similarity_join
from trendloom.plans import matching, trends as trend_plans
from trendloom.schemas import TAGS_CSV
from trendloom.sources import readers, writers
from trendloom.streaming.incremental import incremental_embed, skip_done

ENCODER = hash_encoder(32)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- files ------------------------------------------------------------------------


def test_trend_files_by_name_and_by_folder(spark, tmp_path):
    (tmp_path / "Women - Jeans & Jeggings.json").write_text('{\n "trending_tags_india": []}')
    (tmp_path / "50%+ off.json").write_text("{}")
    (tmp_path / "notes.md").write_text("no")
    (tmp_path / "Men - a%2Fb.json").write_text("[]")
    (tmp_path / "x.txt").write_text("{}")
    got = {r["category"]: r["value"] for r in readers.read_trend_json(spark, str(tmp_path)).collect()}
    assert got == {"Women - Jeans & Jeggings": '{\n "trending_tags_india": []}', "50%+ off": "{}", "Men - a/b": "[]"}


def test_thresholds_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    assert readers.read_thresholds(spark, str(path)) is None
    path.write_text("category,threshold,status\nMen - Tshirts, 0.20,done\nBad,x,done\n")
    assert rows(readers.read_thresholds(spark, str(path))) == [("Men - Tshirts", 0.2)]
    other = tmp_path / "u.csv"
    other.write_text("threshold,extra,category\n0.35,1,Men - Shorts\n")
    assert rows(readers.read_thresholds(spark, str(other))) == [("Men - Shorts", 0.35)]
    other = tmp_path / "v.csv"
    other.write_text("threshold,name\n0.35,Men - Shorts\n")
    with pytest.raises(ValueError, match="category"):
        readers.read_thresholds(spark, str(other))


def test_trend_files_are_replaced_one_by_one(spark, tmp_path):
    folder = tmp_path / "trends"

    def write(*pairs):
        writers.write_trend_json(spark.createDataFrame(list(pairs), "category string, trends_json string"), str(folder))

    write(("Men - a/b", '{"x": 1}'), ("50%+ off: é", "{}"))
    write(("Men - a/b", '{"x": 2}'), ("New", "[]"))
    spark.createDataFrame([], "category string, trends_json string").transform(lambda df: writers.write_trend_json(df, str(folder)) or df)
    got = {r["category"]: r["value"].strip() for r in readers.read_trend_json(spark, str(folder)).collect()}
    assert got == {"Men - a/b": '{"x": 2}', "50%+ off: é": "{}", "New": "[]"}
    assert len([p for p in folder.iterdir() if p.suffix == ".json"]) == 3
    for bad in ([("A", "{}"), ("A", "[]")], [(None, "{}")]):
        with pytest.raises(ValueError):
            write(*bad)
    assert readers.read_trend_json(spark, str(folder)).count() == 3


def test_trends_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('tag,category,region,description,preprocessed_tag,tag_embedding_text,embedding\n'
                    'a_b,Men,india,"two\nlines ""q""",a b,a b,"[1.0, 2.0]"\n')
    row = readers.read_trends_csv(spark, str(path), TAGS_CSV).first()
    assert row["description"] == 'two\nlines "q"' and row["embedding"] == [1.0, 2.0]


def test_catalog_pruning_and_pushdown(spark, tmp_path, capsys):
    df = spark.range(40).selectExpr(
        "id product_id", "concat('Men - ', id % 3) category",
        "case when id % 2 = 0 then 'style' else 'size' end standardize_type_updated", "'v' normalised_name", "id pos")
    writers.write_partitioned(df, str(tmp_path / "c"))
    (tmp_path / "c" / "_notes").mkdir()
    catalog = readers.read_catalog(spark, str(tmp_path / "c"))
    assert rows(catalog.select(*df.columns)) == rows(df)
    filters.filter_attribute_types(filters.filter_category(catalog, "Men - 1")).select("product_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(category" in plan and "In(standardize_type_updated" in plan
    assert "ReadSchema: struct<product_id:bigint,standardize_type_updated:string>" in plan


def test_only_written_categories_are_replaced(spark, tmp_path):
    root = str(tmp_path / "c")
    writers.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x long, category string"), root)
    writers.write_partitioned(spark.createDataFrame([(9, "a")], "x long, category string"), root)
    back = readers.read_catalog(spark, root)
    assert rows(back) == [(2, "b"), (9, "a")]
    more = spark.createDataFrame([(5, "a"), (6, "c")], "x long, category string")
    assert rows(skip_done(more, root).select("x")) == [(6,)]
    assert skip_done(more, str(tmp_path / "missing")).count() == 2


def test_category_is_the_first_folder(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x long")
    one.write.parquet(str(tmp_path / "r" / "Men - Coats & Co" / "deep" / "er"))
    one.write.mode("append").parquet(str(tmp_path / "r"))
    got = readers.read_category_dirs(spark, str(tmp_path / "r"))
    assert rows(got.select("category")) == [("Men - Coats & Co",), ("base_level",)]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entry = spark.createDataFrame([("f1", ("b1", "validating", None, None))],
                                  "jsonl_file string, batch struct<id: string, status: string, "
                                  "output_file_id: string, error_file_id: string>")
    writers.append_ledger(entry, path)
    writers.append_ledger(entry.withColumn("jsonl_file", F.lit("f2")), path)
    (tmp_path / "ledger" / "extra.json").write_text('\n{"jsonl_file": "f3"\nnot json\n{"other": 1}\n')
    back = readers.read_ledger(spark, path)
    assert rows(back.select("jsonl_file", "batch.id")) == [("f1", "b1"), ("f2", "b1")]
    assert back.count() == 2


def test_request_lines_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb")], "id long, text string")
    writers.write_requests(df, str(tmp_path / "q"), requests.build_request("id", "text", F.lit("m")))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "q")).collect()]
    assert json.loads(lines[0])["body"]["messages"][0]["content"] == "a\nb"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a b.jsonl").write_text("x")
    (tmp_path / "files" / "c.txt").write_text("x")
    assert [r["file_name"] for r in readers.list_files(spark, str(tmp_path / "files"), "*.jsonl").collect()] == ["a b.jsonl"]


# --- increments -------------------------------------------------------------------


def test_second_run_adds_nothing(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    docs = spark.createDataFrame([(1, "a", "Red dresses"), (2, "b", "tops & sets")], "id long, category string, t string")
    docs.write.partitionBy("category").parquet(src)

    def transform(df):
        return df.withColumn("embedding_text", normalize_text("t"))

    for _ in range(2):
        incremental_embed(spark, src, out, log, transform, docs.schema)
        assert spark.read.parquet(out).count() == 2
    docs.selectExpr("id + 10 id", "category", "t").write.mode("append").partitionBy("category").parquet(src)
    incremental_embed(spark, src, out, log, transform, docs.schema, max_files=1)
    assert {r["id"]: r["embedding_text"] for r in spark.read.parquet(out).collect()} == {
        1: "red dress", 2: "top and set", 11: "red dress", 12: "top and set"}
    assert spark.read.parquet(out).count() == 4


def test_arriving_catalog_files_are_embedded_like_the_whole(spark, tmp_path, catalog):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    for part in ("product_id < 40", "product_id >= 40"):
        catalog.where(part).write.mode("append").partitionBy("category").parquet(src)
        incremental_embed(spark, src, out, log, lambda df: matching.embed_rows(df, ENCODER), catalog.schema)
    columns = ["product_id", "category", "pos", "confidence", "embedding_text", "text_embedding"]
    assert rows(spark.read.parquet(out).select(*columns)) == rows(
        matching.embed_catalog(catalog, ENCODER).select(*columns))


def test_checkpoint_folder_is_the_named_one(spark):
    root = session.checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(root)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


# --- the weekly run ------------------------------------------------------------------


def answer(india, world):
    text = json.dumps({"trending_tags_india": india, "trending_tags_global": world})
    return json.dumps({"output": [{"type": "reasoning"}, {"type": "message", "content": [{"text": text}]}]})


@pytest.fixture(scope="module")
def week(spark, tmp_path_factory):
    """Answers -> files -> CSV -> trends with vectors."""
    folder = tmp_path_factory.mktemp("week")
    red = {"trend_name": "Red Dresses", "aesthetic_description": "red ones", "confidence": 4.0, "region": "India",
           "supporting_hashtags": ["#r", "#d"]}
    blue = {"trend_name": "Blue Tops", "aesthetic_description": " ", "confidence": 3.0}
    answers = spark.createDataFrame([
        ("Women - Dresses", answer([red], [blue])), ("Men - Tshirts", f"```json\n{answer([], [red, blue])}\n```"),
        ("Women - Tops", "{")], "category string, response string")
    rejects = trend_plans.curate_trends(answers, str(folder / "json"))
    flat = trend_plans.consolidate_trends(spark, str(folder / "json"), str(folder / "csv"))
    return folder, rejects, flat, session.cut_lineage(trend_plans.canonicalize_trends(flat, ENCODER))


@pytest.fixture(scope="module")
def catalog(spark):
    data, values = [], ["Red", "Blue", "Green", None]
    for i in range(200):
        category = ["Women - Dresses", "Men - Tshirts", "Women - Kurtas"][i % 3]
        for pos, (type_, value) in enumerate([
                ("color", values[i % 4]), ("product title", f"{values[(i + 1) % 4]} dress number {i % 7}"),
                ("style", "Tops"), ("size", "XL")], 1):
            data.append((i % 90, category, type_, value, ((i * pos) % 5 - 1) / 2.0, pos))
    return spark.createDataFrame(data, "product_id long, category string, standardize_type_updated string, "
                                       "normalised_name string, confidence double, pos long")


ORDER = ("category", "market_key", "trend_no")


def test_answers_become_trends(spark, week):
    folder, rejects, flat, trends = week
    assert rows(rejects.select("category", "reject_reason")) == [("Women - Tops", "invalid envelope")]
    assert rows(flat.select("category", "market", "trend_name")) == [
        ("Men - Tshirts", "Global", "Blue Tops"), ("Men - Tshirts", "Global", "Red Dresses"),
        ("Women - Dresses", "Global", "Blue Tops"), ("Women - Dresses", "India", "Red Dresses")]
    assert flat.columns[:2] == ["category", "market"]
    back = readers.read_trends_csv(spark, str(folder / "csv"))
    assert rows(back.select("trend_name", "supporting_hashtags").distinct()) == [
        ("Blue Tops", None), ("Red Dresses", '["#r","#d"]')]
    assert rows(trends.select("tag", "preprocessed_tag", "region").distinct()) == [
        ("blue_tops", "blue top", "global"), ("red_dresses", "red dress", "india")]
    assert trends.where("embedding is null").count() == 0


def test_in_category_scoring_equals_scoring_all_and_filtering(week, catalog):
    trends = week[3]
    items = matching.embed_catalog(catalog, ENCODER)
    direct = matching.prefilter(items, trends, order_by=ORDER)
    every = similarity_join(items, matching.global_tag_vectors(trends, ORDER), ["product_id", "category"],
                            weight="confidence", on=None)
    whole = joins.attach_tag_meta(agg.max_score(every), trends, ORDER).where("region is not null")
    columns = ["product_id", "category", "tag", "region", "confidence"]
    assert rows(direct.select(*columns)) == rows(whole.select(*columns))


@pytest.mark.parametrize("kernel", ["arrow", "native"])
def test_scoring_texts_equals_scoring_rows(spark, week, catalog, kernel):
    trends = week[3]
    thresholds = spark.createDataFrame([("Women - Dresses", 0.5), ("Men - Tshirts", 0.2)], "category string, threshold double")
    by_row = matching.prefilter(matching.embed_catalog(catalog, ENCODER), trends, order_by=ORDER, kernel=kernel)
    by_text = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER, kernel=kernel)
    assert by_row.count() > 50
    assert rows(by_text) == rows(by_row)
    pushed = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER, thresholds)
    assert rows(pushed) == rows(filters.filter_category_threshold(by_row, thresholds))
    pushed = matching.prefilter(matching.embed_catalog(catalog, ENCODER), trends, order_by=ORDER, thresholds=thresholds)
    assert rows(pushed) == rows(filters.filter_category_threshold(by_row, thresholds))


def test_mapping(week, catalog):
    trends = week[3]
    found = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER)
    kept = matching.apply_thresholds(found, None, trends)
    mapping = matching.map_trends(kept, catalog, trends, ENCODER, "2026-01-16", "2026-01-23",
                                  first_k=30, final_k=5, order_by=ORDER)
    out = mapping.collect()
    assert out and max(r["cosine_similarity"] for r in out) <= 1.0
    groups = {}
    for r in out:
        groups.setdefault((r["tag"], r["category"]), []).append(r)
        assert str(r["start_date"]) == "2026-01-16" and r["gender"] in ("women", "men")
    assert all(len(g) <= 5 for g in groups.values())
    described = {r["product_id"]: r["product_description"] for r in matching.describe_products(catalog, kept).collect()}
    assert all("size values" not in d and d.endswith(".") for d in described.values())
    # one product by hand
    sample = out[0]

    def embed(text):
        return mapping.sparkSession.range(1).select(ENCODER(F.lit(text)).alias("v")).first()["v"]

    a, b = embed(described[sample["product_id"]]), embed(sample["tag_embedding_text"])
    assert math.isclose(sum(x * y for x, y in zip(a, b)), sample["cosine_similarity"], abs_tol=1e-8)


def test_python_runs_only_in_encoders_and_the_arrow_kernel(week, catalog, capsys):
    trends = week[3]
    found = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER, kernel="native")
    matching.map_trends(matching.apply_thresholds(found, None, trends), catalog, trends, ENCODER,
                        "2026-01-16", "2026-01-23", order_by=ORDER).explain()
    plan = capsys.readouterr().out
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_own_lemmas_and_stop_words_reach_the_catalog(spark):
    catalog = spark.createDataFrame(
        [(1, "Men - Coats", "title", "Worn red gizmos for him", 1.0, 1), (2, "Men - Coats", "title", None, 1.0, 2)],
        "product_id long, category string, standardize_type_updated string, normalised_name string, confidence double, pos long")
    lemmas = spark.createDataFrame([("worn", "wear"), ("gizmos", "gadget")], "token string, lemma string")
    plain = matching.catalog_texts(catalog).first()["embedding_text"].split()
    own = matching.catalog_texts(catalog, lemmas=lemmas, stop_words=("red", "for")).first()["embedding_text"].split()
    assert "gizmo" in plain and "red" in plain
    assert own[:2] == ["wear", "gadget"] and "red" not in own and "him" in own
    assert matching.catalog_texts(catalog, stop_words=("red",)).first()["embedding_text"].split()[1] == "gizmo"
    vectors = matching.embed_catalog(catalog, ENCODER, lemmas=lemmas, stop_words=("red", "for"))
    assert vectors.first()["embedding_text"].split() == own


def test_mapping_encodes_each_product_once(spark, week, catalog, capsys):
    trends = week[3]
    seen = spark.sparkContext.accumulator(0)

    def make():
        import numpy as np

        def predict(texts):
            seen.add(len(texts))
            return np.array([[len(t), 1.0] + [0.0] * 30 for t in texts])
        return predict

    found = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER)
    mapping = matching.map_trends(found, catalog, trends, model_encoder(make), "2026-01-16", "2026-01-23", order_by=ORDER)
    mapping.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out  # the vectors are a table by then
    assert mapping.count() > 0
    # a worker that runs several tasks keeps its model, and counts for the first of them only
    assert 0 < seen.value <= matching.describe_products(catalog, found).count()


def test_published_tables(spark, week, catalog, tmp_path):
    trends = week[3]
    found = matching.prefilter_texts(matching.catalog_texts(catalog), trends, ENCODER, ORDER)
    mapping = matching.map_trends(found, catalog, trends, ENCODER, "2026-01-16", "2026-01-23", order_by=ORDER)
    matching.publish(mapping, trends, str(tmp_path / "mapping"), str(tmp_path / "tags"))
    tags = {r["tag"] for r in spark.read.parquet(str(tmp_path / "mapping")).collect()}
    assert tags and {r["tag"] for r in spark.read.parquet(str(tmp_path / "tags")).collect()} == tags


def test_tag_dimension(week, catalog):
    from trendloom.operators.joins import tags_in_output

    trends = week[3]
    dim = trend_plans.tag_dimension(trends)
    assert dim.columns == ["tag_value", "category", "tag_type", "vector", "tag"]
    mapping = trends.where("tag = 'red_dresses'").select("tag")
    assert {r["tag_value"] for r in tags_in_output(dim, mapping).collect()} == {"red dress"}
