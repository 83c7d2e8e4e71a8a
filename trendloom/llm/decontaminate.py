"""Benchmark decontamination: documents that hold passages of test items.

The n-grams of the normalised items form a hash set that is broadcast. Each
document's token windows are scanned against it, hits are verified word by
word, and hit spans or whole documents can be removed.

The set is broadcast only within a stated number of bytes. More items are
taken in blocks of that size, one pass over the documents each, and the
passes' results are merged per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import by_place, change_rows, cut_lineage, map_texts, row_key
from trendloom.llm.words import NORMAL_WORD, covered, cut_words, normal_words, window_hashes, word_hashes

WINDOW = 10
#: Bytes of item texts whose windows are broadcast at a time.
BLOCK_BYTES = 16 << 20
_FLAG_BITS = 20

_FOUND = "doc_id bigint, row bigint, n_words bigint, starts array<int>, lengths array<int>, items array<string>"


class Windows:
    """Windows of a block of items: exact word sequences by length, with quick filters."""

    def __init__(self, items: list[tuple], size: int) -> None:
        self.items: dict[bytes, set[str]] = {}
        by_length: dict[int, list[int]] = {}
        for item_id, text in items:
            words = normal_words(text)
            length = min(size, len(words))
            if not length:
                continue
            for i, h in enumerate(window_hashes(word_hashes(words), length).tolist()):
                by_length.setdefault(length, []).append(h)
                self.items.setdefault(b" ".join(words[i:i + length]), set()).add(
                    "" if item_id is None else str(item_id))
        self.hashes = {n: np.unique(np.array(h, np.uint64)) for n, h in by_length.items()}
        self.flags = {}
        for n, h in self.hashes.items():
            self.flags[n] = np.zeros(1 << _FLAG_BITS, bool)
            self.flags[n][(h & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)] = True

    def find(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and lengths of the windows that occur in `words`, and their items."""
        starts, lengths, found = [], [], set()
        if not self.items or not words:
            return starts, lengths, found
        hashed = word_hashes(words)
        for n, known in self.hashes.items():
            h = window_hashes(hashed, n)
            at = np.nonzero(self.flags[n][(h & np.uint64((1 << _FLAG_BITS) - 1)).astype(np.int64)])[0]
            near = np.searchsorted(known, h[at])
            at = at[known[np.minimum(near, len(known) - 1)] == h[at]]
            for i in at.tolist():
                if items := self.items.get(b" ".join(words[i:i + n])):
                    starts.append(i)
                    lengths.append(n)
                    found |= items
        return starts, lengths, found


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """Items with a text, in parts of about `block_bytes` bytes, split by the hash of the text."""
    items, (id_col, text_col) = by_place(items, id_col, text_col)
    items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // block_bytes) or 1
    if parts == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i) for i in range(parts)]


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Windows of items in each document: doc_id, row, n_words, starts, lengths, items.

    One row per input row, whatever the number of blocks. A null text has no
    words; an item of fewer words than the window is one window; an item
    without words occurs nowhere; an item without id counts under an empty id.
    Other columns are ignored, whatever their names.
    """
    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(doc_id, text).alias("row"),
                       F.col(text).alias("text"))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    found = _found(docs, blocks, window)
    if len(blocks) == 1:
        return found
    # repeated rows were scanned once
    found = cut_lineage(found.drop("doc_id").withColumnRenamed("row", "__row"), "merged")
    return docs.select("doc_id", "row").join(found, F.col("row") == F.col("__row")).select(
        "doc_id", "row", "n_words", "starts", "lengths", "items")


def _found(docs: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """Windows of all blocks in `docs` (doc_id, row, text), each looked for in the text as it stands.

    One row per input row with one block, one per distinct row with more.
    """
    sc = docs.sparkSession.sparkContext
    if len(blocks) > 1:
        docs = cut_lineage(docs.dropDuplicates(["row"]), "distinct")
    found = []
    for block in blocks:
        windows = sc.broadcast(Windows([(r[0], r[1].encode()) for r in block.collect()], window))

        def scan(rows, windows=windows):
            for key, row, data in rows:
                words = normal_words(data)
                starts, lengths, names = windows.value.find(words)
                yield key, row, len(words), starts, lengths, sorted(names)

        part = map_texts(docs, scan, _FOUND)
        found.append(part if len(blocks) == 1 else cut_lineage(part, "passages"))
    if len(found) == 1:
        return found[0]
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionByName(part)
    # as many rows of a document as there are blocks, each with its own hits only
    return merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("lengths")).alias("lengths"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).select("doc_id", "row", "n_words", "starts", "lengths", "items")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: how many of its words are hit, by which items.

    doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see
    `find_passages` for nulls, short items and repeated rows.
    """
    def digest(rows):
        for key, n, starts, lengths, names in rows:
            hit = int(covered(np.array(starts), np.array(lengths), n).sum()) if starts else 0
            joined = ",".join(sorted(names))
            yield (key, n, hit, len(names), hashlib.sha256(joined.encode()).hexdigest(), hit > 0)

    found = find_passages(docs, items, **options).drop("row")
    return map_texts(found, digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, "
                                    "items_sha256 string, contaminated boolean")


def remove_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    block_bytes: int = BLOCK_BYTES, whole_documents: bool = False,
                    n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` without the words that windows of items cover, or without the documents that hold any.

    All columns stay; `n_chars`, if there, is counted anew for texts that
    change. A text of which nothing but punctuation is left becomes that.
    """
    blocks = item_blocks(items, item_id, item_text, block_bytes)

    def cut(data, words, starts, lengths):
        if whole_documents or not starts:
            return not starts, data
        return True, cut_words(data, covered(np.array(starts), np.array(lengths), len(words)), NORMAL_WORD)

    if len(blocks) == 1:
        windows = docs.sparkSession.sparkContext.broadcast(
            Windows([(r[0], r[1].encode()) for r in blocks[0].collect()], window))

        def change(data):
            words = normal_words(data)
            starts, lengths, _ = windows.value.find(words)
            return cut(data, words, starts, lengths)

        return change_rows(docs, text, change, n_chars)

    # a cut breaks windows and makes others, so the hits of all blocks are gathered before it
    rows, (body,) = by_place(docs, text)
    texts = rows.select(F.lit(None).cast("bigint").alias("doc_id"), row_key(body).alias("row"), F.col(body).alias("text"))
    found = _found(texts, blocks, window).where(F.size("starts") > 0).select(F.col("row").alias("hit"), "starts", "lengths")
    rows = rows.withColumn("row", row_key(body)).join(cut_lineage(found, "hits"), F.col("row") == F.col("hit"), "left")
    count = f"c{docs.columns.index(n_chars)}" if n_chars in docs.columns else None
    changed = change_rows(rows.drop("row", "hit"), body, lambda data, starts, lengths: cut(
        data, normal_words(data), starts, lengths), count, ("starts", "lengths"))
    return changed.toDF(*docs.columns)
