"""Ranked search: the best documents of the whole corpus for each of a set of queries.

A task indexes a bounded number of postings at a time. Each posting list has a
sparse table for range maxima. A query is a best-first search over intervals
of documents in order of their ids: the sum of the lists' maxima bounds every
score within, the interval of the greatest bound is split at the document
where the greatest of those maxima lies, and that document is scored. What
cannot beat the k-th best so far is never looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from trendloom.llm.common import arrow_schema, by_place, cut_lineage, rows_batch, small_batches
from trendloom.llm.decontaminate import BLOCK_BYTES, item_blocks
from trendloom.llm.words import normal_words
from trendloom.operators.ranking import top_k

TOP = 20
#: Postings that a task indexes together; a document is never cut, and has no more than the queries' different terms.
POSTINGS = 1 << 20
#: Intervals that are split at a time.
_TOGETHER = 8
_NO_ID = 1 << 63


class Query(NamedTuple):
    """A query's terms by number, and how often it has each."""

    terms: np.ndarray
    times: np.ndarray


class Corpus(NamedTuple):
    """Documents with a term, their terms in all, and the weight of each term of the queries."""

    documents: int
    words: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What an occurrence in a query adds to the score of a document of `n` terms that has it `tf` times."""
        m = 100 - 25 + 25 * n * self.documents // self.words
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Posting lists of some documents, by place in the order of their ids, with range-maximum tables."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        """ids: in ascending order; docs: places in ids."""
        some = impacts > 0
        terms, docs, impacts = terms[some].astype(np.int64), docs[some], impacts[some]
        order = np.lexsort((docs, terms))
        self.ids, self.size = ids, len(ids)
        self.docs, self.impacts = docs[order], impacts[order]
        # a term and a place as one number: where a list passes a document is a binary search over all lists at once
        self.places = terms[order] * self.size + self.docs
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        longest = int(np.diff(self.starts).max(initial=0))
        levels = [np.arange(len(self.docs), dtype=np.int32)]
        while (half := 1 << (len(levels) - 1)) * 2 <= longest:
            left, right = levels[-1][:-half], levels[-1][half:]
            best = np.where(self.impacts[right] > self.impacts[left], right, left)
            levels.append(best)
        #: levels[j][i]: place of the greatest of the 2**j impacts from i on, the first of equal ones
        self.levels = np.zeros((len(levels), len(self.docs)), np.int32)
        for j, level in enumerate(levels):
            self.levels[j, :len(level)] = level
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1

    def greatest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the greatest impact of each range of a list; the ranges are not empty."""
        level = self.log[end - begin]
        left = self.levels[level, begin]
        right = self.levels[level, end - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def search(self, query: Query, best: list[tuple[int, int]], top: int) -> int:
        """Put the documents that belong to the `top` best into the heap `best` of (score, -id).

        Returns how many documents were scored.
        """
        have = self.starts[query.terms + 1] > self.starts[query.terms]
        terms, times = query.terms[have], query.times[have]
        if not len(terms):
            return 0
        impacts, ids, base = self.impacts, self.ids, terms * self.size

        def late(bound: int, place: int) -> bool:
            """Nothing of an interval that begins at `place` can be among the best."""
            if len(best) < top:
                return False
            least = best[0]
            return bound < least[0] or bound == least[0] and -int(ids[place]) <= least[1]

        def bounded(low, high, begin, end):
            """Intervals, one a row, with their bounds and the place of the greatest term's greatest impact."""
            some = end > begin
            found = np.zeros(begin.shape, np.int64)
            found[some] = self.greatest(begin[some], end[some])
            value = np.where(some, impacts[found] * times, 0)
            bounds = value.sum(axis=1).tolist()
            where = self.docs[found[np.arange(len(found)), value.argmax(axis=1)]].tolist()
            return [(-b, lo, hi, split, begin[i], end[i])
                    for i, (b, lo, hi, split) in enumerate(zip(bounds, low, high, where, strict=True)) if b > 0]

        queue = bounded([0], [self.size], self.starts[terms][None], self.starts[terms + 1][None])
        scored = 0
        while queue:
            taken = []
            while queue and len(taken) < _TOGETHER:
                if late(-queue[0][0], queue[0][1]):
                    queue = []  # all others are bounded by no more, or begin later
                else:
                    taken.append(heapq.heappop(queue))
            if not taken:
                break
            splits = np.array([t[3] for t in taken])
            begin, end = np.stack([t[4] for t in taken]), np.stack([t[5] for t in taken])
            wanted = base + splits[:, None]
            middle = np.clip(np.searchsorted(self.places, wanted), begin, end)
            has = middle < end
            has[has] = self.places[middle[has]] == wanted[has]
            scores = np.where(has, impacts[np.where(has, middle, 0)] * times, 0).sum(axis=1).tolist()
            scored += len(taken)
            for place, score in zip(splits.tolist(), scores, strict=True):
                entry = (score, -int(ids[place]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            low = [t[1] for t in taken] + (splits + 1).tolist()
            high = splits.tolist() + [t[2] for t in taken]
            for part in bounded(low, high, np.concatenate([begin, middle + has]), np.concatenate([middle, end])):
                if not late(-part[0], part[1]):
                    heapq.heappush(queue, part)
        return scored


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: documents with a term, and what they have of the vocabulary."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        find = known.value.get
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = normal_words(data)
                if words:
                    found = np.array([t for t in map(find, words) if t is not None], np.int32)
                    different, counts = np.unique(found, return_counts=True)
                    ids.append(key)
                    sizes.append(len(words))
                    terms.append(different)
                    tfs.append(counts.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *part])))
                     for part in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _index(rows: list, corpus: Corpus, n_terms: int) -> Block:
    """A block of Arrow batches of postings."""
    import pyarrow as pa

    table = pa.Table.from_batches(rows)
    ids = table.column(0).fill_null(0).to_numpy().astype(object)
    nulls = table.column(0).is_null().to_numpy()
    ids[nulls] = _NO_ID
    n = table.column(1).to_numpy()
    counts = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column(2).chunks])
    terms, tfs = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]).astype(np.int64) for k in (2, 3))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    owner = np.repeat(np.arange(len(ids)), counts)
    return Block(ids[order], terms, place[owner], corpus.impacts(terms, tfs, n[owner]), n_terms)


def _best_of_tasks(postings: DataFrame, queries: list[Query], corpus: Corpus, top: int, size: int) -> DataFrame:
    """item, doc_id, score, late: at most `top` rows of each query from each task. late: the id is null."""
    held = postings.sparkSession.sparkContext.broadcast((queries, corpus))
    schema = "item int, doc_id bigint, score bigint, late boolean"

    def run(batches):
        queries, corpus = held.value
        kinds = arrow_schema(schema)
        best: list[list] = [[] for _ in queries]
        rows, count = [], 0

        def look():
            block = _index(rows, corpus, len(corpus.weights))
            for query, found in zip(queries, best, strict=True):
                block.search(query, found, top)

        for batch in batches:
            rows.append(batch)
            count += len(batch.column(2).flatten())
            if count >= size:
                look()
                rows, count = [], 0
        if any(b.num_rows for b in rows):
            look()
        for item, found in enumerate(best):
            if found:
                yield rows_batch([(item, None if key == -_NO_ID else -key, score, key == -_NO_ID) for score, key in found], kinds)

    return postings.mapInArrow(run, schema)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                   postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of greatest score for each item, scores above 0 only.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. Equal scores are ordered by doc_id, a null id last; every row
    of `docs` is a document, also where id and text repeat, and every row of
    `items` a query. An item that is null or has no terms, or none that occur,
    has no rows. Item texts are taken to the tasks in blocks of `block_bytes`
    bytes, one pass over the documents each; a task holds the best of each
    query, and the index of about `postings` postings.
    """
    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    kind = dict(by_place(items, item_id)[0].dtypes)[by_place(items, item_id)[1][0]]
    found = [_ranked(docs, [tuple(r) for r in block.collect()], top, postings)
             for block in item_blocks(items, item_id, item_text, block_bytes)]
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionByName(part)
    return merged.withColumn("item_id", F.col("item_id").cast(kind))


def _ranked(docs: DataFrame, items: list[tuple], top: int, size: int) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(normal_words(text.encode())) for _, text in items]
    names = sorted(set().union(*counts))
    vocabulary = {t: i for i, t in enumerate(names)}
    queries = [Query(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
    found = cut_lineage(_postings(docs, vocabulary), "postings")
    documents, words = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    best = cut_lineage(_best_of_tasks(found, queries, Corpus(documents, max(words, 1), weights), top, size), "best")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "late", "doc_id")
    ranked = top_k(best, ["item"], "score", top, ["late", "doc_id"]).withColumn("rank", F.row_number().over(first))
    asked = spark.createDataFrame([(i, None if r[0] is None else str(r[0])) for i, r in enumerate(items)], "number int, item_id string")
    return ranked.join(F.broadcast(asked), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")
