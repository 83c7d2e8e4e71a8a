"""Byte-pair encoding and decoding after a vocabulary file of a public tokenizer.

The symbols of a word form a doubly linked list; a priority queue holds the
ranks of the merges that its neighbours allow. The least is taken; entries
whose pair has changed since are stale and skipped. Decoding puts the
vocabulary's strings together.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import Memo, map_texts, small_batches

#: Longer chunks of a text are encoded each time they occur.
_MEMO_LENGTH = 48


def byte_letters() -> str:
    """The printable letter that stands for each byte in vocabularies over bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(letters[b] for b in range(256))


_SHIFT = 21


def pair(left: int, right: int) -> int:
    """Two symbols, or a rank and a symbol, as one number."""
    return left << _SHIFT | right


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply merges, least rank first and leftmost among equals, until none is left.

    merges: pair(left, right) to pair(rank, merged).
    """
    size = len(symbols)
    after = [*range(1, size), -1]
    before = list(range(-1, size - 1))
    find, push = merges.get, heapq.heappush
    # an entry is the rank and the place of the left symbol
    queue = [found >> _SHIFT << 40 | i for i in range(size - 1)
             if (found := find(symbols[i] << _SHIFT | symbols[i + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        i = entry & (1 << 40) - 1
        right = after[i]
        if symbols[i] < 0 or right < 0:
            continue
        found = find(symbols[i] << _SHIFT | symbols[right])
        if found is None or found >> _SHIFT != entry >> 40:
            continue  # one of the two has been merged since
        symbols[i], symbols[right] = found & (1 << _SHIFT) - 1, -1
        after[i] = right = after[right]
        if right >= 0:
            before[right] = i
            if (found := find(symbols[i] << _SHIFT | symbols[right])) is not None:
                push(queue, found >> _SHIFT << 40 | i)
        left = before[i]
        if left >= 0 and (found := find(symbols[left] << _SHIFT | symbols[i])) is not None:
            push(queue, found >> _SHIFT << 40 | left)
    return [s for s in symbols if s >= 0]


class WordEncoder:
    """What a tokenizer file of this kind describes: NFC, white space and lower case;
    a split by pattern; bytes as letters; merges with a word-end suffix."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if (steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]
                or byte_level["type"] != "ByteLevel" or byte_level["use_regex"] or spec["decoder"]
                or model["unk_token"] or model["continuing_subword_prefix"]):
            raise ValueError("a tokenizer file of another kind")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {pair(self.vocab[a], self.vocab[b]): pair(rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        names = {i: t for t, i in (self.vocab | self.added).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.kind = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # beyond ASCII, letters are what the library's tables say, so its own steps normalise and split
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.spaces = re.compile(r"[\t-\r]")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.letters = byte_letters()
        self.chunks = Memo(self._chunk, 1 << 18)

    def _word(self, word: str) -> bytes:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        ids = merge_symbols([self.vocab[c] for c in letters if c in self.vocab], self.merges)
        return np.array(ids, self.kind).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self.pattern.findall(chunk) if chunk.isascii() else [w for w, _ in self.split.pre_tokenize_str(chunk)]
        if len(words) == 1 and words[0] == chunk:
            return self._word(chunk)
        return b"".join([self.chunks[w] if len(w) <= _MEMO_LENGTH else self._word(w) for w in words])

    def _plain(self, text: str) -> bytes:
        plain = self.spaces.sub(" ", text.lower()) if text.isascii() else self.normalizer.normalize_str(text)
        chunks = plain.split(" ")
        find = self.chunks.__getitem__
        if len(max(chunks, key=len)) <= _MEMO_LENGTH:
            return b"".join(map(find, chunks))
        return b"".join(find(c) if len(c) <= _MEMO_LENGTH else self._chunk(c) for c in chunks)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens in it become those tokens."""
        parts, at = [], 0
        for match in self.special.finditer(text):
            parts += [self._plain(text[at:match.start()]), np.array([self.added[match[0]]], self.kind).tobytes()]
            at = match.end()
        parts.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), self.kind)

    def decode(self, ids) -> str:
        """Vocabulary strings, joined as the file says: it names no decoder, so by one space."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of numbers), decoded; a null text is empty. One row per input row."""
    def run(rows):
        encoder = word_encoder(path)
        for key, data in rows:
            ids = encoder.encode((data or b"").decode()).tolist()
            yield key, ids, encoder.decode(ids)

    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(docs, run, "doc_id bigint, ids array<int>, decoded string")


def token_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: what goes on to training. A null text is empty; one row per input row."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encoder = word_encoder(path)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def encoding_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what `encode_documents` gives, worked out on the spot.

    `path` is a tokenizer file that every executor has. A null text is empty
    and has no ids; repeated rows have a row each.
    """
    def run(rows):
        encoder = word_encoder(path)
        numbers = [str(i) for i in range(len(encoder.names))]
        for key, data in rows:
            ids = encoder.encode((data or b"").decode()).tolist()
            joined = " ".join(map(numbers.__getitem__, ids))
            yield (key, len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                   hashlib.sha256(encoder.decode(ids).encode()).hexdigest())

    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
