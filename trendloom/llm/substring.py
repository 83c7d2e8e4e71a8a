"""Substring dedup by an index of all word windows, in place of a relative Lempel-Ziv parse.

The index, cut in blocks by the window's hash, has the place where each window
starts first. Windows that are found at an earlier place are duplicates, and
runs of them are the duplicate spans. No source is carried: neighbouring
windows of a span may come from different documents, nothing is parsed
greedily, and no span is a copy from one place. Every window is looked up, so
the spans are exact but for collisions of 64-bit hashes.

Only windows that can repeat are looked up. Each window has a minimiser, the
least hash of its short word runs; equal windows have equal minimisers, so
windows whose minimiser occurs at one place only are in no other document.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import by_place, cut_lineage, map_arrays, map_texts, release_finished, row_key, small_batches
from trendloom.llm.words import (SPACE_WORD, covered, cut_words, sliding_minimum, space_words,
                                 window_hashes, word_hashes)

WINDOW = 20
#: Words of the runs whose hashes serve as minimisers.
RUN = 5


def minimisers(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Run hashes, and the least of them for each window."""
    runs = window_hashes(hashes, run)
    return runs, sliding_minimum(runs, window - run + 1)


def anchors(data: bytes | None, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """Hashes of the runs that are the minimiser of some window, once per place."""
    words = space_words(data)
    if len(words) < window:
        return np.zeros(0, np.uint64)
    runs, least = minimisers(word_hashes(words), window, run)
    # a run is one if some window around it has nothing less
    span = window - run + 1
    edge = np.zeros(span - 1, np.uint64)
    most = ~sliding_minimum(~np.concatenate([edge, least, edge]), span)
    return runs[most == runs]


def candidates(words: list[bytes], repeated, window: int = WINDOW, run: int = RUN):
    """Starts of the windows whose minimiser is one of `repeated`, and the word hashes."""
    hashes = word_hashes(words)
    _, least = minimisers(hashes, window, run)
    known = np.sort(np.asarray(repeated, np.int64).view(np.uint64))
    near = np.minimum(np.searchsorted(known, least), len(known) - 1)
    return np.nonzero(known[near] == least)[0], hashes


def factors(starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans (start, length in words) of windows in a row, given the starts of windows found earlier.

    A span is as long as windows follow one another; two spans may overlap by
    less than a window where the windows across their boundary occur nowhere earlier.
    """
    if not len(starts):
        return []
    breaks = np.nonzero(np.diff(starts) > 1)[0] + 1
    return [(int(part[0]), len(part) - 1 + window) for part in np.split(starts, breaks)]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("__id"), row_key(doc_id, text).alias("__key"),
                       F.col(f"`{text}`").alias("__text"), F.struct(*rest).alias("__row"))


def _repeated_anchors(docs: DataFrame, window: int, run: int) -> DataFrame:
    """__k, repeated: for each document the minimisers that occur at another place too."""
    def places(key, data):
        found = anchors(data, window, run)
        return np.full(len(found), key, np.int64), found.view(np.int64)

    found = cut_lineage(map_arrays(docs.select("__key", "__text"), places, "k bigint, v bigint"), "anchors")
    # a table of its own, so that the join has plain shuffles on both sides and Spark can split a run found everywhere
    twice = cut_lineage(found.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "twice")
    shared = found.join(twice, "v", "left_semi").groupBy("k").agg(F.collect_set("v").alias("repeated"))
    return cut_lineage(shared.withColumnRenamed("k", "__k"), "repeated")


def _with_first_places(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Rows of `docs` with `repeated` and `firsts`: window starts of the document that are first of their kind.

    Both joins take the rows from one shuffle.
    """
    repeated = _repeated_anchors(docs, window, run)
    release_finished(docs.sparkSession)

    def look_up(key, doc, data, _, known):
        words = space_words(data)
        at, hashes = candidates(words, known, window, run)
        found = window_hashes(hashes, window)[at].view(np.int64)
        # without an id a document comes before all others
        number = np.full(len(at), -(1 << 63) if doc is None else doc, np.int64)
        return found, number, np.full(len(at), key, np.int64), at.astype(np.int32)

    columns = ["__key", "__id", "__text", "__row"]
    small = repeated.hint("shuffle_hash")
    rows = docs.select(*columns)
    found = map_arrays(rows.join(small, F.col("__key") == F.col("__k")).select(*columns, "repeated"), look_up,
                       "h bigint, doc bigint, k bigint, place int")
    firsts = (found.groupBy("h").agg(F.min(F.struct("doc", "k", "place")).alias("first"))
              .groupBy(F.col("first.k").alias("__f")).agg(F.collect_list("first.place").alias("firsts")))
    return (rows.join(small, F.col("__key") == F.col("__k"), "left")
            .join(firsts.hint("shuffle_hash"), F.col("__key") == F.col("__f"), "left")
            .select(*columns, "repeated", "firsts"))


def _spans(words: list[bytes], repeated, firsts, window: int, run: int) -> list[tuple[int, int]]:
    if not repeated:
        return []
    at, _ = candidates(words, repeated, window, run)
    return factors(np.setdiff1d(at, np.asarray(firsts or [], np.int64)), window)


def _gone(words: list[bytes], spans: list[tuple[int, int]]) -> np.ndarray:
    if not spans:
        return np.zeros(len(words), bool)
    places = np.array(spans)
    return covered(places[:, 0], places[:, 1], len(words))


def repeated_words(docs: DataFrame, window: int = WINDOW, run: int = RUN, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, starts, lengths (the spans), one row per input row.

    A word goes if a window of `window` words around it also starts earlier: in
    a document of smaller id, or earlier in the same one. A null text has no
    words; fewer words than a window are kept. A null id counts as the smallest.
    Repeated rows are the same document and get the same result; different
    texts of one id are ordered by the hash of their text.
    """
    def parse(rows):
        for doc, data, repeated, firsts in rows:
            words = space_words(data)
            spans = _spans(words, repeated, firsts, window, run)
            gone = _gone(words, spans)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if spans else b" ".join(words)
            yield (doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                   [s[0] for s in spans], [s[1] for s in spans])

    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _with_first_places(_keyed(docs, "doc_id", "text").withColumn("__row", F.lit(None).cast("int")), window, run)
    return map_texts(found.select("__id", "__text", "repeated", "firsts"), parse,
                     "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
                     "starts array<int>, lengths array<int>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, doc_id: str = "doc_id",
                   text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` without the words of duplicate spans; `n_chars`, if there, is counted anew for changed texts."""
    names = docs.columns
    counted = f"c{names.index(n_chars)}" if n_chars in names else None
    docs, (doc_id, text) = by_place(docs, doc_id, text)
    found = _with_first_places(_keyed(docs, doc_id, text), window, run)

    def parse(rows):
        for data, repeated, firsts in rows:
            words = space_words(data)
            spans = _spans(words, repeated, firsts, window, run)
            yield cut_words(data, _gone(words, spans), SPACE_WORD) if spans else None

    small_batches(docs.sparkSession)
    schema = found.select("__row").schema.add("__new", "string")

    def run_batches(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.binary()).to_pylist()
            lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("repeated", "firsts")]
            new = list(parse(zip(texts, *lists, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("__row")), pa.array(new, pa.binary()).cast(pa.string())],
                names=["__row", "__new"])

    cut = found.mapInArrow(run_batches, schema)
    changed = F.col("__new").isNotNull()
    out = []
    for c in docs.columns:
        old = F.col("__row").getField(c)
        if c == text:
            old = F.coalesce("__new", old)
        elif c == counted:
            old = F.when(changed, F.char_length("__new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return cut.select(*out).toDF(*names)
