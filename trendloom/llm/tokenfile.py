"""Token ids in binary files: frequency-ranked, byte-aligned, of variable length.

An id is written as its rank among all ids of the corpus, the most frequent
first, in one to four bytes. The lengths stand apart in control bytes, four
ids to a byte; reading looks them up in a table and fills all ids at once.

A file is a run of chunks, in order of doc_id. Chunk: four little-endian
64-bit counts (documents, ids, control bytes, data bytes), then the
documents' ids (64 bits each), null marks (a byte each), numbers of ids (64
bits each), control bytes, data.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trendloom.llm.bpe import byte_letters
from trendloom.llm.common import Memo, arrow_schema, cut_lineage, release_finished, rows_batch, small_batches
from trendloom.llm.files import new_file, new_folder, open_input, open_output
from trendloom.operators.sizing import row_partitions

END_ID = 2
#: Ids after which a chunk ends; a longer document makes a longer chunk.
CHUNK_IDS = 1 << 20
#: Bytes of text that are cut into words at a time; a longer text is cut by itself.
SLICE_BYTES = 1 << 23
_HEAD = struct.Struct("<4q")
_MEMO_LENGTH = 48
_MARKS = string.punctuation
_TOKEN_ID = attrgetter("id")

#: Lengths of the four numbers that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Which bytes of a 32-bit number of each length are there.
_PRESENT = np.arange(4) < np.arange(5)[:, None]


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    codes = (numbers > 0xFF).astype(np.uint8)
    codes += numbers > 0xFFFF
    codes += numbers > 0xFFFFFF
    data = numbers.view(np.uint8).reshape(-1, 4)[_PRESENT[codes + 1]]
    four = np.zeros((-(-len(codes) // 4), 4), np.uint8)
    four.ravel()[:len(codes)] = codes
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers that `pack` was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    out = np.zeros((count, 4), np.uint8)
    out[_PRESENT[lengths]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def plain(word: str) -> bool:
    """Whether `word` is letters of ASCII and Latin-1 only, which are letters in all versions of Unicode."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xFF")


def without_marks(word: str) -> str:
    """`word` without the marks at its end, if plain letters are left; else all of it."""
    letters = word.rstrip(_MARKS)
    return letters if plain(letters) else word


def look_up(memo: Memo, piece: str) -> bytes | None:
    """What belongs to `piece`, remembered unless it is long."""
    return memo[piece] if len(piece) <= _MEMO_LENGTH else memo.compute(piece)


class TextEncoder:
    """Ids of whole texts by the tokenizers library, remembered for words.

    The library splits a text at a space or line end that follows something
    else, and a word of plain letters from the mark behind it, whatever stands
    around; of several spaces and line ends in a row it takes all but the last
    together, or all at the end of the text. So the ids of such pieces, words
    with the space before them, make up those of the text. Texts with other
    white space in a row, or with the string of a special token, go to the
    library as they are.

    Texts are cut by Arrow, many at a time, and a word that they share is
    looked up once for all of them.
    """

    _TOGETHER = re.compile(r"\s\s")

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or not isinstance(self.library.pre_tokenizer, ByteLevel):
            raise ValueError("a tokenizer file of another kind")
        self.model = self.library.model
        letters = byte_letters()
        self.space = letters[ord(" ")]
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.of_id = [i.tobytes() for i in np.arange(self.library.get_vocab_size(), dtype=self.kind)]
        self.starts = Memo(self._start, 1 << 16)
        self.words = Memo(self._chunk)
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _letters(self, word: str, space: str) -> bytes:
        # nothing to split: straight to the library's model, in the letters that it has for bytes
        tokens = self.model.tokenize(space + (word if word.isascii() else word.translate(self.letters)))
        return b"".join(map(self.of_id.__getitem__, map(_TOKEN_ID, tokens)))

    def _start(self, word: str) -> bytes:
        """Ids of a word at the start of a text or line."""
        letters = without_marks(word)
        if len(letters) < len(word):
            return look_up(self.starts, letters) + look_up(self.starts, word[len(letters):])
        return self._letters(word, "") if plain(word) else self._ids(word)

    def _chunk(self, chunk: str, last: bool = False) -> bytes | None:
        """Ids of what follows a space, or of a line end and what follows it; None where more than that decides."""
        if plain(chunk):
            return self._letters(chunk, self.space)
        if self._TOGETHER.search(chunk) or not last and (not chunk or chunk[-1].isspace()):
            return None
        if chunk.startswith("\n"):
            return self.line_end + look_up(self.starts, chunk[1:])
        return None if chunk[:1].isspace() else self._ids(" " + chunk)

    def _first(self, chunk: str, last: bool) -> bytes | None:
        if self._TOGETHER.search(chunk) or not last and chunk[-1:].isspace():
            return None
        return look_up(self.starts, chunk)

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array; a null text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()).fill_null("")
        behind = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            limit = SLICE_BYTES + (behind[at - 1] if at else 0)
            out += self._encode_slice(texts.slice(at, max(1, int(np.searchsorted(behind, limit, "right")) - at)))
        return out

    def _encode_slice(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        # a line end goes with the word behind it
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        firsts = np.concatenate([[0], ends[:-1]])
        chunks = split.flatten().dictionary_encode()
        names, places = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy().copy()
        short = pc.max(pc.utf8_length(chunks.dictionary)).as_py() <= _MEMO_LENGTH
        word, start = (memo.__getitem__ if short else partial(look_up, memo) for memo in (self.words, self.starts))
        pieces = [word(w) if len(w) == len(name) else word(w) + start(name[len(w):])
                  for w, name in zip(map(without_marks, names), names, strict=True)]

        def change(at: int, piece: bytes | None) -> None:
            places[at] = len(pieces)
            pieces.append(piece)

        # nothing, or a line end alone, is what a space or line end leaves that another one follows
        blank = pc.is_in(chunks.dictionary, pa.array(["", "\n"], pa.large_string())).to_numpy(zero_copy_only=False)[places]
        blank[firsts] = False
        blank = np.flatnonzero(blank)
        for row in np.split(blank, np.flatnonzero(np.diff(blank) > 1) + 1) if len(blank) else ():
            piece = look_up(self.starts, "".join([names[i] or " " for i in places[row].tolist()]))
            places[row] = len(pieces)
            pieces.append(b"")
            change(row[0], piece)
        # first and last pieces have a space, or something else, on one side only
        for first, end in zip(firsts.tolist(), ends.tolist(), strict=True):
            name, alone = names[places[first]], end - first == 1
            if not alone and pieces[places[end - 1]] is None:
                change(end - 1, self._chunk(names[places[end - 1]], True))
            change(first, self._first(name, alone))
        ids = pa.array(pieces, pa.large_binary()).take(pa.array(places))
        whole = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False), firsts).tolist()
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[:len(ids) + 1]
        data = ids.buffers()[2]
        return [self._ids(text) if apart or self.special.search(text) else data[begin:end].to_pybytes()
                for text, apart, begin, end in zip(texts.to_pylist(), whole, bounds[firsts].tolist(), bounds[ends].tolist(),
                                                   strict=True)]


@lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def gathered(batches, size: int = SLICE_BYTES):
    """First columns, and second ones as texts of any length, of batches put together until they hold `size` bytes."""
    import pyarrow as pa

    keys, texts, held = [], [], 0
    for batch in batches:
        keys.append(batch.column(0))
        texts.append(batch.column(1).cast(pa.large_string()))
        held += batch.nbytes
        if held >= size:
            yield pa.concat_arrays(keys), pa.concat_arrays(texts)
            keys, texts, held = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)


def encode_sorted(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """part, doc_id, ids (compressed): saved in ascending order of doc_id, part by part.

    The parts' bounds are quantiles of the ids, so texts are encoded only once.
    """
    import zstandard

    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n = row_partitions(docs)
    bounds = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) or []
    bounds = np.array(sorted(set(bounds)))
    schema = "part int, doc_id bigint, ids binary"
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        encoder, compress = text_encoder(path), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], encoder.kind).tobytes()
        for keys, texts in gathered(batches):
            ids = [compress(found + end) for found in encoder.encode_all(texts)]
            parts = np.searchsorted(bounds, keys.fill_null(-(1 << 63)).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), keys, pa.array(ids, pa.binary())], schema=arrow_schema(schema))

    encoded = docs.mapInArrow(run, schema).repartitionById(n, F.col("part"))
    return cut_lineage(encoded.sortWithinPartitions("doc_id", "ids"), "ids")


def id_ranks(encoded: DataFrame, path: str) -> np.ndarray:
    """Rank of each id of the vocabulary by how often it occurs in all documents; ties by id."""
    import zstandard

    def run(batches):
        import pyarrow as pa

        kind = text_encoder(path).kind
        expand = zstandard.ZstdDecompressor().decompress
        total = np.zeros(1, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(map(expand, batch.column(0).to_pylist())), kind)
            found = np.bincount(ids, minlength=len(total))
            found[:len(total)] += total
            total = found
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    # one row per id of the vocabulary, whatever the corpus
    counts = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    size = max(text_encoder(path).library.get_vocab_size(), max((r["id"] for r in counts), default=0) + 1)
    often = np.zeros(size, np.int64)
    for r in counts:
        often[r["id"]] = r["n"]
    ranks = np.empty(size, np.uint32)
    ranks[np.argsort(-often, kind="stable")] = np.arange(size)
    return ranks


def write_tokens(encoded: DataFrame, ranks: np.ndarray, path: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Writes the files; gives their manifest: file, unnamed, first_id, first_crc, docs, ids."""
    import zstandard

    spark = encoded.sparkSession
    folder = new_folder(spark, "tokens")
    with open_output(f"{folder}/ranks.u4") as out:
        out.write(ranks.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(ranks)
    schema = "file string, unnamed boolean, first_id bigint, first_crc bigint, docs bigint, ids bigint"

    def run(batches):
        kind = text_encoder(path).kind
        expand = zstandard.ZstdDecompressor().decompress
        kinds = arrow_schema(schema)
        state: dict = {"out": None}

        def flush():
            if not state["keys"]:
                return
            chunk, count = _chunk(state["keys"], state["blobs"], kind, shared.value)
            state["out"].write(chunk)
            state["row"][4] += len(state["keys"])
            state["row"][5] += count
            state.update(keys=[], blobs=[], held=0)

        def close():
            if state["out"] is None:
                return []
            flush()
            state["out"].close()
            state["out"] = None
            return [state["row"]]

        for batch in batches:
            done: list = []
            for part, key, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = (part, key is not None, key or 0)
                if state["out"] is not None and (place[0] != state["last"][0] or place < state["last"]):
                    done += close()
                raw = expand(blob)
                if state["out"] is None:
                    file = new_file(folder, ".ids")
                    state.update(out=open_output(file), keys=[], blobs=[], held=0,
                                 row=[file, key is None, key or 0, zlib.crc32(blob), 0, 0])
                state["last"] = place
                state["keys"].append(key)
                state["blobs"].append(raw)
                state["held"] += len(raw) // kind.itemsize
                if state["held"] >= chunk_ids:
                    flush()
            if done:
                yield rows_batch(done, kinds)
        if done := close():
            yield rows_batch(done, kinds)

    return cut_lineage(encoded.select("part", "doc_id", "ids").mapInArrow(run, schema), "manifest")


def _chunk(keys: list[int | None], blobs: list[bytes], kind: np.dtype, ranks: np.ndarray) -> tuple[bytes, int]:
    """A chunk as it is in the file, and how many ids it holds."""
    ids = np.frombuffer(b"".join(blobs), kind)
    control, data = pack(ranks[ids])
    sizes = [len(b) // kind.itemsize for b in blobs]
    return b"".join([
        _HEAD.pack(len(keys), len(ids), len(control), len(data)), np.array([k or 0 for k in keys], "<i8").tobytes(),
        bytes(k is None for k in keys), np.array(sizes, "<i8").tobytes(), control, data]), len(ids)


def read_chunks(file: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each chunk: the documents' ids, where each document's tokens end, all token ids."""
    with open_input(f"{file.rpartition('/')[0]}/ranks.u4") as source:
        ranks = np.frombuffer(source.read(), "<u4")
    names = np.empty(len(ranks), np.uint32)
    names[ranks] = np.arange(len(ranks), dtype=np.uint32)
    with open_input(file) as source:
        while head := source.read(_HEAD.size):
            docs, count, control, data = _HEAD.unpack(head)
            keys = np.frombuffer(source.read(8 * docs), "<i8").tolist()
            unnamed = source.read(docs)
            ends = np.cumsum(np.frombuffer(source.read(8 * docs), "<i8"))
            numbers = unpack(source.read(control), source.read(data), count)
            yield [None if u else k for k, u in zip(keys, unnamed, strict=True)], ends, names[numbers]


def read_tokens(spark: SparkSession, manifest: DataFrame, each: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), then what `each` gives for the document's ids.

    One task reads one file, chunk by chunk. The manifest has one row per
    file; the ids before each file are summed on the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: (not r["unnamed"], r["first_id"], r["first_crc"], r["ids"]))
    bases = np.concatenate([[0], np.cumsum([r["ids"] for r in files])]).tolist()
    rows = [(i, r["file"], base) for i, (r, base) in enumerate(zip(files, bases, strict=False))]
    schema = f"doc_id bigint, start bigint, {schema}"
    table = spark.createDataFrame(rows, "place int, file string, base bigint")
    if rows:
        table = table.repartitionById(len(rows), F.col("place"))

    def run(batches):
        kinds = arrow_schema(schema)
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for keys, ends, ids in read_chunks(file):
                    starts = np.concatenate([[0], ends[:-1]]).tolist()
                    found = [(k, base + s, *each(ids[s:e])) for k, s, e in zip(keys, starts, ends.tolist(), strict=True)]
                    yield rows_batch(found, kinds)
                    base += len(ids)

    return table.mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
                chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Encodes `docs` with the tokenizer file `path`, writes the ids in files, and gives the manifest.

    `end_id` follows each document. A null text is empty; documents without
    an id come first; repeated ids lie next to each other, a row each.
    """
    encoded = encode_sorted(docs, path, end_id, doc_id, text)
    release_finished(docs.sparkSession)
    return write_tokens(encoded, id_ranks(encoded, path), path, chunk_ids)


def token_digests(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of `token_files`, as read back from the files."""
    def digest(ids: np.ndarray) -> tuple[int, int]:
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    manifest = token_files(docs, path, **options)
    return read_tokens(docs.sparkSession, manifest, digest, "n_tokens bigint, ids_crc32 bigint")
