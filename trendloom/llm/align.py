"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are deduplicated exactly, by a shuffle on the whole text. Each distinct
text is encoded by both tokenizers and the tokens aligned by their byte
ranges; its pairs of linked ids are counted and weighted by the number of
documents that have the text. The counts of the corpus go back to the texts,
and the measures of the texts to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.bpe import byte_letters
from trendloom.llm.common import by_place, cut_lineage, small_batches

#: Longer chunks of a text are aligned each time they occur.
_MEMO_LENGTH = 48
_MEMO_CHUNKS = 1 << 18
#: Different id pairs of a corpus up to which their counts are broadcast (about 32 bytes each); more are shuffled.
BROADCAST_PAIRS = 1 << 20

_BORDER = re.compile(r"(?<=[^ ])(?= \S)")
_ODD_SPACE = re.compile(r" \s")
_LATIN = re.compile("[\n!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
# fixed value: how byte-level vocabularies of this kind split a text
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Chunk(NamedTuple):
    """Alignment of a piece of a text that both tokenizers treat by itself; `codes`: 64-bit numbers of the linked pairs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    codes: bytes


def align_tokens(ids_a: list[int], ids_b: list[int], size_a: list[int], size_b: list[int], width: int) -> Chunk:
    """Walk through the tokens of both, which cover the same bytes and are none empty.

    Tokens are linked where their bytes overlap, and a group ends where a token of each does.
    """
    codes = []
    rest_b = iter(ids_b)
    b = next(rest_b)
    left = size_b[b]  # bytes of b that no token of A has covered yet
    groups = ""
    behind = f"|{b}"  # the group's tokens of B, and before it those of A
    mark = ""
    for a in ids_a:
        row, need = a * width, size_a[a]
        groups += f"{mark}{a}"
        mark = ","
        codes.append(row + b)
        while need > left:
            need -= left
            b = next(rest_b)
            left = size_b[b]
            behind += f",{b}"
            codes.append(row + b)
        left -= need
        if not left:
            groups += behind
            b = next(rest_b, None)
            if b is None:
                break
            left = size_b[b]
            behind = f"|{b}"
            mark = ";"
    return Chunk(len(ids_a), len(ids_b), groups.count("|"), groups, array("q", codes).tobytes())


class Aligner:
    """Both tokenizers, and the alignment of chunks they have met.

    Neither forms a token across a single space that stands between other
    characters, but only from that space on: the byte-level one splits there
    by its pattern, and no piece of the other has a space behind a letter.
    So a text is the row of its chunks, and the chunks' results are remembered.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_letter = {c: i for i, c in enumerate(byte_letters())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [t.encode() if t in added else bytes(of_letter[c] for c in t) for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any(" " in p.lstrip(" ") for p in (x.decode(errors="replace") for x in self.bytes_b)):
            raise ValueError("pieces go on behind a space, so texts have no borders at spaces")
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.width = len(pieces)
        self.quick = self._quick(path_a, added)
        self.known: dict[str, Chunk | None] = {}

    def _quick(self, path: str, added: set[str]):
        """The same vocabulary in a library that is faster on single words, if its ids are in order of the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = [spec["model"]["vocab"][a + b] for a, b in merges]
        if spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "use_regex": True} or ranks != sorted(ranks):
            return None
        ids = {t: i for i, t in enumerate(self.bytes_a) if t and t.decode(errors="replace") not in added}
        return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def _chunk(self, chunk: str, ids_b: list[int]) -> Chunk | None:
        text = " " + chunk
        whole = text.encode()
        if self.quick and _LATIN.fullmatch(chunk):
            ids_a = self.quick(text)
        else:
            ids_a = self.a.encode(text, add_special_tokens=False).ids
            if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole:
                return None
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        return align_tokens(ids_a, ids_b, self.size_a, self.size_b, self.width)

    def align(self, texts: list[str | None]) -> list[list[Chunk] | None]:
        """The chunks of each text, in order; None if it is null, empty, or either tokenizer alters its bytes."""
        split: list[list[str]] = []
        for text in texts:
            chunks = text.split(" ") if text else []
            if "" in chunks or chunks and _ODD_SPACE.search(text):
                chunks = _BORDER.split(text)
                chunks[1:] = [c[1:] for c in chunks[1:]]
            split.append(chunks)
        if len(self.known) >= _MEMO_CHUNKS:
            self.known.clear()
        known = self.known
        new = list({c: None for chunks in split for c in chunks if c not in known})
        known.update(zip(new, map(self._chunk, new, self.b.encode(new, num_threads=1)), strict=True))
        out = []
        for chunks in split:
            found = list(map(known.__getitem__, chunks))
            out.append(None if not found or None in found else found)
        for c in new:
            if len(c) > _MEMO_LENGTH:
                del known[c]
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_SIZES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _measured(chunks: list[Chunk] | None) -> tuple:
    """Counts, digest, and the different codes of linked ids with their numbers."""
    if chunks is None:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_a, n_b, n_groups, groups, codes = zip(*chunks, strict=True)
    links = np.frombuffer(b"".join(codes), np.int64)
    different, counts = np.unique(links, return_counts=True)
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return sum(n_a), sum(n_b), sum(n_groups), len(links), digest, different, counts


def _key(text: Column) -> Column:
    """Tells texts apart: their SHA-256, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def align_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row per distinct text: key, copies, n_a, n_b, n_groups, n_links, groups_sha256, codes, counts.

    `codes` are the different linked pairs, id of A times the size of B's
    vocabulary plus id of B, and `counts` how many links of the text hold
    each. Null and empty texts are left out. Copies are counted in each task
    before the shuffle, so that a text that all documents share costs no task
    more than one row of each.
    """
    docs, (text,) = by_place(docs, text)
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(_key(F.col("text")).alias("key"), "copies", "text")

    def run(batches):
        import pyarrow as pa

        known = aligner(path_a, path_b)
        for batch in batches:
            rows = list(map(_measured, known.align(batch.column(2).to_pylist())))
            sizes = list(zip(*(r[:5] for r in rows), strict=True)) or [()] * 5
            ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)])))
                     for k in (5, 6)]
            arrays = [pa.array(s, pa.string() if i == 4 else pa.int64()) for i, s in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays, *lists],
                names=["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts"])

    return texts.mapInArrow(run, f"key binary, copies bigint, {_SIZES}, codes array<bigint>, counts array<bigint>")


def _links(texts: DataFrame, *more: str) -> DataFrame:
    """code, n: the linked pairs of each text, a row each."""
    return texts.select(*more, F.inline(F.arrays_zip("codes", "counts"))).withColumnsRenamed({"codes": "code", "counts": "n"})


def pair_counts(texts: DataFrame, width: int) -> DataFrame:
    """code, id_a, id_b, total, best: corpus-wide links of each id pair, and whether none of its B id has more.

    Links of a text count once for each of its copies.
    """
    totals = _links(texts, "copies").groupBy("code").agg(F.sum(F.col("n") * F.col("copies")).alias("total"))
    totals = totals.select("code", F.expr(f"code div {width}").alias("id_a"), (F.col("code") % width).alias("id_b"), "total")
    totals = cut_lineage(totals, "totals")
    most = totals.groupBy(F.col("id_b").alias("b")).agg(F.max("total").alias("most"))
    return totals.join(most, F.col("id_b") == F.col("b")).select(
        "code", "id_a", "id_b", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
                    broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input row.

    `path_a` is a byte-level file of the tokenizers library that encodes a
    space and the text, `path_b` a piece model that adds that space itself.
    A text that is null, empty or altered by either has no tokens: zeros and an
    empty digest. Rows with a null or repeated id have rows of their own.
    Pair counts are broadcast up to `broadcast_pairs` of them, and shuffled beyond.
    """
    placed, (doc_id, text) = by_place(docs, doc_id, text)
    width = _width(path_b)
    texts = cut_lineage(align_texts(placed, path_a, path_b, text), "aligned")
    pairs = cut_lineage(pair_counts(texts, width).select("code", "total", "best"), "pairs")
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    judged = _links(texts, "key").join(pairs, "code").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    measures = texts.drop("copies", "codes", "counts").join(judged.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    # a table of its own, so that a text of very many documents is a plain join's skew, which Spark splits
    measures = cut_lineage(measures.drop("k"), "measures")
    rows = placed.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                         _key(F.when(F.col(text) != "", F.col(text))).alias("of"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.join(measures, F.col("of") == F.col("key"), "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


@lru_cache(maxsize=4)
def _width(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
