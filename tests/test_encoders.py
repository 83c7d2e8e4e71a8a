"""The encoder of token ids: truncation, batches by length, order, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions.encoders import length_batches, token_encoder


def words_to_lengths():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def sum_model():
    """(sum of ids, tokens): tells what a text was cut to and that its padding was masked."""
    return lambda ids, mask: np.stack([(ids * mask).sum(axis=1), mask.sum(axis=1)], axis=1)


def shape_model():
    """(1, 2^rows, 2^width of the batch, 2^tokens), to read the batches off the vectors."""
    def model(ids, mask):
        rows, width = ids.shape
        return np.stack([np.array([1.0, rows, width, n]) for n in mask.sum(axis=1)])
    return model


def encoded(spark, texts, encoder, partitions=1):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(partitions, "i")
    return {r["i"]: r["v"] for r in rows.select("i", encoder(F.col("t")).alias("v")).collect()}


def unit(*v):
    v = np.array(v, float)
    return (v / np.linalg.norm(v)).tolist()


@pytest.mark.parametrize("partitions", [1, 3])
@pytest.mark.parametrize("batch_tokens", [1, 7, 4096])
def test_rows_keep_their_vectors(spark, partitions, batch_tokens):
    texts = ["a bb", None, "", "x " * 900, "ccc", "a bb", "dd " * 40, None, "e f g h"]
    got = encoded(spark, texts, token_encoder(words_to_lengths, sum_model, None, batch_tokens), partitions)
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
        elif not text:
            assert got[i] == [0.0, 0.0]
        else:
            ids = [len(w) for w in text.split()]
            assert got[i] == pytest.approx(unit(sum(ids), len(ids)))


def test_texts_are_cut_by_tokens(spark):
    texts = ["a " * 511 + "tail end", "longer-than-that " * 3, "b " * 2000]
    got = encoded(spark, texts, token_encoder(words_to_lengths, sum_model))
    assert got[0] == pytest.approx(unit(511 + 4, 512))
    assert got[1] == pytest.approx(unit(16 * 3, 3))
    assert got[2] == pytest.approx(unit(512, 512))


def test_batches_by_length_pad_little(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(3, 1.2, 4000).astype(int) + 1, 512)
    batches = length_batches(lengths, 4096)
    assert sorted(np.concatenate(batches)) == list(range(4000))
    assert all(len(b) * lengths[b].max() <= 4096 for b in batches)
    padded = sum(len(b) * lengths[b].max() - lengths[b].sum() for b in batches)
    in_order = sum(64 * lengths[i:i + 64].max() - lengths[i:i + 64].sum() for i in range(0, 4000, 64))
    assert padded < in_order / 10

    texts = ["w " * n for n in lengths[:600]]
    by_tokens = encoded(spark, texts, token_encoder(words_to_lengths, shape_model, None, 1024))
    shapes = {i: [x / v[0] for x in v] for i, v in by_tokens.items()}
    assert all(n == pytest.approx(lengths[i]) and rows * width <= 1024.5 for i, (_, rows, width, n) in shapes.items())
    waste = sum(width - n for _, _, width, n in shapes.values())
    assert waste < sum(lengths[:600]) / 5


def test_long_texts_and_no_texts():
    assert length_batches([], 10) == []
    assert [b.tolist() for b in length_batches([50, 0, 3, 60], 10)] == [[1, 2], [0], [3]]


def test_faults_are_named(spark):
    with pytest.raises(ValueError):
        token_encoder(words_to_lengths, sum_model, max_tokens=0)
    with pytest.raises(Exception, match="2 texts gave an array of shape"):
        encoded(spark, ["a", "b"], token_encoder(words_to_lengths, lambda: lambda ids, mask: np.ones((1, 2))))
