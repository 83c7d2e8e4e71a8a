import math
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from trendloom.llm import quality, queries
from trendloom.llm.quality import fit_curve, learn_quality, score_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return learn_quality(*tables, but_held_out=True)


def test_held_out_quality(spark, tables):
    docs, labels = tables
    found = {r.doc_id: r for r in queries.op11_quality_classifier(spark, SF).collect()}
    assert set(found) == {r.doc_id for r in docs.select("doc_id").collect()}
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert len(judged) > 50
    assert np.mean([r.predicted == q for r, q in judged]) >= 0.95
    good, bad = ([r.score for r, q in judged if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert np.mean([(r.score - q) ** 2 for r, q in judged]) < 0.06


def test_scores_as_plain_compression(tables, model):
    import zstandard

    docs = tables[0].limit(40)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in score_quality(docs, model).collect():
        sizes = []
        for content in (model.bad, model.good):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(sum(len(zstandard.ZstdCompressor(
                level=6, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress(texts[r.doc_id][i:i + 256] + bytes(64))) for i in range(0, len(texts[r.doc_id]), 256)))
        x = (sizes[0] - sizes[1]) / (len(texts[r.doc_id]) + 16)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.offset))))


def test_held_out_labels_teach_nothing(spark, tables, model):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality")
    assert learn_quality(docs, turned, but_held_out=True) == model


def test_odd_texts_and_names(spark, documents, model):
    docs = documents([*ODD, (None, "the"), (5, "one")]).withColumnRenamed("fp", "a.b").withColumnRenamed("n_words", "score")
    found = score_quality(docs, model).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in found)
    at = {r.doc_id: r.score for r in found}
    assert at[1] == at[2] == model.score(0.0)
    assert score_quality(docs.limit(0), model).count() == 0


def test_labels_that_teach_nothing(spark, documents):
    kinds = "doc_id bigint, quality int, id string"
    docs = documents([(1, "a b"), (2, None), (None, "x"), (3, "")])
    for rows in ([], [(1, 1, ""), (1, 0, "")], [(2, 1, ""), (None, 0, ""), (1, None, ""), (3, 0, ""), (9, 1, ""), (1, 7, "")]):
        empty = learn_quality(docs, spark.createDataFrame(rows, kinds))
        assert empty == (b"", b"", 0.0, 0.0)
        assert {r.score for r in score_quality(docs, empty).collect()} == {0.5}


def test_sample_is_bounded(tables):
    small = learn_quality(*tables, documents=6, characters=50, curve_documents=4)
    assert len(small.bad.decode()) <= 6 * 51 and len(small.good.decode()) <= 6 * 51
    assert quality.SAMPLE_DOCUMENTS == 400


def test_curve():
    x = np.linspace(-1, 1, 400)
    drawn = np.random.default_rng(1).random(400) < 1 / (1 + np.exp(-(5 * x + 1)))
    slope, offset = fit_curve(x, drawn)
    assert slope == pytest.approx(5, abs=1.5) and offset == pytest.approx(1, abs=0.7)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert p.mean() == pytest.approx(drawn.mean(), abs=0.01)  # calibrated on the whole
    assert fit_curve([], []) == (0.0, 0.0)
    apart, _ = fit_curve([-1, -1, 1, 1], [0, 0, 1, 1])
    assert 1 < apart < 100
    assert fit_curve([0.0, 0.0], [1, 0])[1] == pytest.approx(0)
