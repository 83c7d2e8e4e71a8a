"""Quality classification by compression.

Bounded samples of text labelled good and of text labelled bad are the
raw-content dictionaries of two zstd compressors. A text that the good
dictionary makes smaller than the bad one is likely good: the difference of
the two sizes, over the text's length, becomes a probability by a logistic
curve that is fitted to labelled texts outside the dictionaries. Over the
length and not over the sizes' sum, as words said over and over leave next to
nothing in either, and so are held for bad as they should be.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from trendloom.llm.common import by_place, cut_lineage, map_texts
from trendloom.llm.language import Classifier, held_out
from trendloom.operators.ranking import top_k

#: Of each label, documents whose slices make its dictionary, and the length of a slice in characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 400, 1000
#: Of each label, further documents that the curve is fitted to.
CURVE_DOCUMENTS = 2000
#: Bytes that are compressed at a time, each run on its own.
PIECE = 256
#: Added to a text's bytes, so that a few letters alone prove little.
SHORT = 16
#: Least score of a text that is predicted good.
THRESHOLD = 0.7


class QualityModel(NamedTuple):
    """Dictionary contents, and the curve: score = 1 / (1 + exp(-(slope * difference + offset)))."""

    bad: bytes
    good: bytes
    slope: float
    offset: float

    def score(self, difference: float) -> float:
        at = self.slope * difference + self.offset
        return 1 / (1 + math.exp(-at)) if at >= 0 else 1 - 1 / (1 + math.exp(at))


@lru_cache(maxsize=2)
def _compressors(bad: bytes, good: bytes) -> Classifier:
    return Classifier((("bad", bad), ("good", good)), piece=PIECE)


def difference(data: bytes | None, bad: bytes, good: bytes) -> float:
    """(size with the bad dictionary - size with the good one) for each byte of text; zero without text."""
    if not data:
        return 0.0
    worse, better = _compressors(bad, good).sizes(data)
    return (worse - better) / (len(data) + SHORT)


def fit_curve(differences: Iterable[float], labels: Iterable[int], rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of greatest likelihood.

    A small penalty on the slope keeps it finite where the labels are told
    apart wholly. Without rows the curve is flat at one half.
    """
    x, y = np.array(list(differences), float), np.array(list(labels), float)
    if not len(x):
        return 0.0, 0.0
    scale = float(np.abs(x).max()) or 1.0
    x = x / scale
    slope = offset = 0.0
    ridge = 0.01

    def loss(a, b):
        return float(np.logaddexp(0, a * x + b).sum() - (y * (a * x + b)).sum()) + ridge * (a * a + b * b) / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -500, 500)))
        w = p * (1 - p)
        gradient = np.array([((p - y) * x).sum() + ridge * slope, (p - y).sum() + ridge * offset])
        second = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(second, gradient)
        size, now = 1.0, loss(slope, offset)
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > now:
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(size * step).max() < 1e-9:
            break
    return float(slope / scale), float(offset)


def learn_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label_id: str = "doc_id", quality: str = "quality", but_held_out: bool = False,
                  documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS,
                  curve_documents: int = CURVE_DOCUMENTS) -> QualityModel:
    """A model of the labels 1 (good) and 0 (bad) of `labels`.

    Of each label the documents whose ids have the least hashes are taken: two
    of three, up to `documents`, for the dictionary, with a slice at a place
    that the hash names, the others, up to `curve_documents` and a half of
    `documents`, for the curve. No more than those
    reach the driver: slices of the former, a number each of the latter. An id
    with both labels, a null id or label, a null or empty text teach nothing,
    nor do held-out ids if `but_held_out`. A label without documents has an
    empty dictionary.
    """
    labels, (label_id, quality) = by_place(labels, label_id, quality)
    docs, (doc_id, text) = by_place(docs, doc_id, text)
    known = labels.select(F.col(label_id).cast("bigint").alias("id"), F.col(quality).cast("int").alias("label")).na.drop()
    known = known.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.where("label = other").drop("other")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    if but_held_out:
        known, texts = known.where(~held_out("id")), texts.where(~held_out("id"))
    number = F.xxhash64("id")
    first = Window.partitionBy("label").orderBy("number", "id")
    least = known.join(texts.select("id").distinct(), "id", "left_semi").withColumn("number", number)
    # each task sends no more of a label than are wanted
    least = top_k(least.withColumn("least", F.bitwise_not("number")), ["label"], "least", documents + curve_documents, "id")
    least = least.withColumn("rank", F.row_number().over(first))
    # every third one is for the curve, so that few labels are shared out too
    taught = (F.col("rank") % 3 != 0) & (F.col("rank") <= documents + documents // 2)
    # a bounded number of ids: a small table that the texts are looked up in, wherever they lie
    least = F.broadcast(cut_lineage(least.select("id", "label", "rank"), "sample"))
    place = F.pmod(number, F.greatest(F.char_length("text") - characters, F.lit(1))).cast("int") + 1
    rows = texts.join(least, "id")
    slices = rows.where(taught).select(
        "label", "rank", "id", F.substring("text", place, F.lit(characters)).alias("slice"))
    # an id may have several texts; of each, no more than one is taken
    slices = slices.groupBy("label", "rank").agg(F.min("slice").alias("slice")).orderBy("label", "rank").collect()
    bad, good = (b"\n".join(r["slice"].encode() for r in slices if r["label"] == k) for k in (0, 1))
    held = docs.sparkSession.sparkContext.broadcast((bad, good))

    def measure(batch):
        for key, label, data in batch:
            yield key, label, difference(data, *held.value)

    found = map_texts(rows.where(~taught).select("id", "label", "text"), measure,
                      "id bigint, label int, difference double")
    found = found.groupBy("id", "label").agg(F.min("difference").alias("difference")).orderBy("id").collect()
    return QualityModel(bad, good, *fit_curve([r["difference"] for r in found], [r["label"] for r in found]))


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (1 from `threshold` on), one row per input row.

    Only the text is looked at, the whole of it. A null or empty text has no
    difference of sizes, and so the curve's score at zero. Repeated rows have a
    row each; other columns, whatever their names, have no effect.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        known = held.value
        for key, out, data in rows:
            score = known.score(difference(data, known.bad, known.good))
            yield key, out, score, int(score >= threshold)

    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.col(text).alias("text"))
    return map_texts(docs, run, "doc_id bigint, held_out boolean, score double, predicted int")
