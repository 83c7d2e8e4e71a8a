"""Text encoders: each one is a callable from a text Column to a vector Column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trendloom.functions.expr import let
from trendloom.functions.vectors import l2_normalize

Encoder = Callable[[Column], Column]

#: Texts that are given to a tokenizer at once.
_TOKENIZED = 256


def hash_encoder(dim: int = 64) -> Encoder:
    """Signed bag of words, hashed to `dim` places and brought to unit length.

    Needs no model and stays in the JVM. The md5 of a word gives its place
    (first four hex digits) and its sign (fifth digit even or odd).
    """

    def feature(word: Column) -> Column:
        digest = F.md5(word)
        place = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % F.lit(dim)
        sign = F.lit(1.0) - F.lit(2.0) * (F.conv(F.substring(digest, 5, 1), 16, 10).cast("int") % 2)
        return F.struct(place.alias("place"), sign.alias("sign"))

    def encode(text: Column) -> Column:
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

        def spread(features: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda i: F.aggregate(
                    features, F.lit(0.0),
                    lambda acc, f: acc + F.when(f["place"] == i, f["sign"]).otherwise(F.lit(0.0))),
            )

        counts = let(F.transform(words, feature), spread)
        return F.when(text.isNotNull(), let(counts, l2_normalize))

    return encode


def unit_rows(rows, count: int) -> np.ndarray:
    """What a model gave for `count` texts, at unit length; a row of zeros stays."""
    rows = np.asarray(rows, np.float64)
    if rows.ndim != 2 or len(rows) != count:
        raise ValueError(f"{count} texts gave an array of shape {rows.shape}")
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def model_encoder(make_predict_fn: Callable, batch_size: int = 512, max_chars: int | None = None) -> Encoder:
    """Encoder around a model that maps a batch of texts to a matrix, a row per text.

    `make_predict_fn` runs once per Python worker, loads the model there and
    returns the function called with each batch. Vectors come out at unit
    length, whatever the model gives. The model never sees a null: it gets an
    empty text instead, and the vector is null. A text goes to the model
    whole, or cut at `max_chars` characters if the model takes no more.
    """
    def make_unit_predict():
        model = make_predict_fn()
        return lambda texts: unit_rows(model(texts), len(texts))

    predict = predict_batch_udf(make_unit_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)

    def encode(text: Column) -> Column:
        given = F.coalesce(text, F.lit(""))
        if max_chars is not None:
            given = F.substring(given, 1, max_chars)
        return F.when(text.isNotNull(), predict(given))

    return encode


def length_batches(lengths: Sequence[int], batch_tokens: int) -> list[np.ndarray]:
    """Places of the texts of each batch, shortest texts first.

    A batch is as wide as its longest text; its width times its rows stays
    within `batch_tokens`, but for a text that is longer by itself.
    """
    order = np.argsort(np.asarray(lengths, np.int64), kind="stable")
    batches, start = [], 0
    for end in range(1, len(order) + 1):
        # the texts ascend, so the next one would set the width
        if end == len(order) or lengths[order[end]] * (end + 1 - start) > batch_tokens:
            batches.append(order[start:end])
            start = end
    return batches


def token_encoder(make_tokenizer: Callable, make_model: Callable, max_tokens: int | None = 512,
                  batch_tokens: int = 16384) -> Encoder:
    """Encoder around a tokenizer and a model of token ids.

    `make_tokenizer` gives a function from a list of texts to a list of id
    lists, `make_model` one from a matrix of ids and a mask of the same shape
    (0 and id 0 where a text has ended) to a matrix with a row per text. Both
    run once per Python worker. A text is cut at `max_tokens` of its tokens,
    or not at all with None. Texts of like length share a batch, within one
    Arrow batch of rows at a time, so little is padded; vectors come back in
    the order of the rows and at unit length. A null text has no vector and
    reaches neither; a text without tokens is a row without a set mask.
    """
    if max_tokens is not None and max_tokens < 1 or batch_tokens < 1:
        raise ValueError("max_tokens and batch_tokens have to be 1 or more")

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize, model = make_tokenizer(), make_model()
        for texts in batches:
            places = np.flatnonzero(texts.notna().to_numpy())
            ids: list[np.ndarray] = []
            for start in range(0, len(places), _TOKENIZED):
                some = tokenize([texts.iloc[p] for p in places[start:start + _TOKENIZED]])
                ids += [np.array(t[:max_tokens], np.int32) for t in some]
            vectors: list = [None] * len(texts)
            for batch in length_batches([len(t) for t in ids], batch_tokens):
                matrix = np.zeros((len(batch), len(ids[batch[-1]])), np.int64)
                mask = np.zeros(matrix.shape, np.int8)
                for row, at in enumerate(batch):
                    matrix[row, :len(ids[at])] = ids[at]
                    mask[row, :len(ids[at])] = 1
                for at, vector in zip(batch, unit_rows(model(matrix, mask), len(batch)), strict=True):
                    vectors[places[at]] = vector
            yield pd.Series(vectors, dtype=object)

    return encode
