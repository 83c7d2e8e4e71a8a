import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import TABLES
from tests.oracle_check import compare, connect
from trendloom.llm import oracle, queries, simhash
from trendloom.llm.queries import tokenizer


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.schema
    steps = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TABLES)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        steps.append({r.doc_id: r for r in rows})
        assert len(steps[-1]) == len(rows) > 0
    start, known, single, cut, clean, ids = steps
    assert columns == spark.read.parquet(str(tmp_path / "benchmark_decontamination")).schema
    assert len(known) >= 0.98 * len(start) and all(known[d] == start[d] for d in known)
    assert set(single) == {c for _, _, c in brute.near_duplicates([(d, r.text) for d, r in known.items()])}
    assert len(single) < len(known) and all(single[d] == known[d] for d in single)
    expected = {d: (n, gone, kept) for d, n, gone, kept in brute.repeats([(d, r.text) for d, r in single.items()])}
    assert set(cut) == set(single)
    for d, r in cut.items():
        words = brute.SPACE.findall(r.text)
        assert (len(words), brute.sha(" ".join(words))) == (expected[d][0] - expected[d][1], expected[d][2])
        assert r.n_chars == len(r.text) and (expected[d][1] or r == single[d])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    hit = {r[0]: r[2] for r in brute.contamination([(d, r.text) for d, r in cut.items()], items)}
    assert any(hit.values()) and set(clean) == set(cut)
    for d, r in clean.items():
        before, after = (len(brute.NORMAL.findall(x.text.translate(brute.LOWER))) for x in (cut[d], r))
        assert before - after == hit[d] and (hit[d] or r == cut[d])
    assert not any(r[2] for r in brute.contamination([(d, r.text) for d, r in clean.items()], items))
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    assert {d: r.ids for d, r in ids.items()} == {
        d: library.encode(r.text, add_special_tokens=False).ids for d, r in clean.items()}


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES)
        assert docs.count() == 0


def test_odd_rows_go_through(spark, documents):
    from tests.llm.conftest import ODD

    docs = documents([*ODD, (None, "words without an id")])
    for name, stage in corpus_pipeline.STAGES[1:]:
        before, docs = docs, stage(spark, docs, TABLES)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "bpe_encoding":
            assert docs.schema == before.schema


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_columns_of_any_name(spark, sample, stage):
    """Names of our own, with dots, and a twin in capitals come through as they are."""
    odd = ["a.b", "row", "n", "hit", "c0", "DOC_ID", "Text"]
    rows = [(*r, "x.y", 7, 8, 9, "z", "twin", "Twin") for r in sample.limit(60).collect()]
    rows += [rows[3], rows[3], (None, None, None, None, None, *rows[0][5:])]
    docs = spark.createDataFrame(rows, sample.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") +
                                 ", `a.b` string, row int, n int, hit int, c0 string, DOC_ID string, Text string")
    out = stage(spark, docs, TABLES)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and {tuple(r)[5:] for r in found} == {("x.y", 7, 8, 9, "z", "twin", "Twin")}


def test_one_of_each(spark, documents):
    docs = documents([(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (None, "a b c d"), (9, None), (8, ""), (7, "x y z w v")])
    kept = simhash.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "A B C D"), (7, "x y z w v"), (8, "")]


def test_registered():
    names = [q.split("_")[0] for q in queries.QUERIES]
    assert names == [f"op{i}" for i in range(1, 14)]
    assert set(entry.queries()) >= {*queries.QUERIES, "pipeline"} and set(entry.oracle_sql()) >= set(oracle.ORACLE)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query(spark, name):
    assert compare(spark, connect(TABLES), name, queries.QUERIES[name], oracle.ORACLE[name], TABLES) is None
