import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD, TABLES
from trendloom.llm import tokenfile, warc
from trendloom.llm.files import open_input
from trendloom.llm.queries import tokenizer

BYTES = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
@settings(max_examples=200, deadline=None)
def test_pack_round_trip(numbers):
    control, data = tokenfile.pack(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert tokenfile.unpack(control, data, len(numbers)).tolist() == numbers


@given(st.text(alphabet="ab c.,'sé\n\t\r \xa0\x1c　1<|endoftext|>中", max_size=40) | st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_the_text(library, text):
    encoder = tokenfile.text_encoder(BYTES)
    ids = np.frombuffer(encoder.encode(text), encoder.kind).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_shared_words_are_looked_up_once(library):
    """A word costs a look-up for all texts that hold it, its marks cost no entry, and long pieces are not kept."""
    encoder = tokenfile.TextEncoder(BYTES)
    texts = ["one two, two. TWO\nthree\n", None, "", " ", "two", "é two\n" + "中" * 300 + " two ", "two" * 99 + "!", "a\t b"] * 500
    looked, look = [], encoder.words.compute

    class Counting(dict):
        def __getitem__(self, key):
            looked.append(key)
            return look(key)

    encoder.words = Counting()
    encoder.words.compute = look
    found = encoder.encode_all(pa.array(texts))
    assert [np.frombuffer(f, encoder.kind).tolist() for f in found] == [
        library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert looked.count("two") <= 4 and len(looked) < 20
    assert "two," not in looked and max(map(len, (*looked, *encoder.starts))) <= 48


@given(st.lists(st.text(alphabet="ab.'é  \n\n\t\r \x1c1", max_size=16), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_white_space_in_a_row(library, texts):
    encoder = tokenfile.text_encoder(BYTES)
    found = [np.frombuffer(f, encoder.kind).tolist() for f in encoder.encode_all(pa.array(texts, pa.string()))]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_paragraphs_are_words_too(library):
    """Texts with empty lines, indents and double spaces are looked up word by word."""
    encoder = tokenfile.TextEncoder(BYTES)
    asked, ask = [], encoder._ids
    encoder._ids = lambda text: asked.append(text) or ask(text)
    text = "One line.  Two\n\nthree, four\n    five \n\n\n six  \n"
    found = encoder.encode_all(pa.array([text * 40, text, "  " + text]))
    assert [np.frombuffer(f, encoder.kind).tolist() for f in found] == [
        library.encode(t, add_special_tokens=False).ids for t in (text * 40, text, "  " + text)]
    assert all(not t.strip(" \n.,") for t in asked)


def test_slices_do_not_alter_ids(monkeypatch):
    encoder = tokenfile.text_encoder(BYTES)
    texts = ["", "x " * 70, None, "a b", "\n", "c" * 300, "d e\nf", ""]
    whole = encoder.encode_all(pa.array(texts))
    for size in (0, 1, 5, 100, 400):
        monkeypatch.setattr(tokenfile, "SLICE_BYTES", size)
        assert encoder.encode_all(pa.array(texts)) == whole == list(map(encoder.encode, (t or "" for t in texts)))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], names=["k", "t"])
               for i, t in enumerate(texts)]
    parts = list(tokenfile.gathered(batches, 100))
    assert 1 < len(parts) < len(texts) and [t for _, p in parts for t in p.to_pylist()] == texts
    assert [k for p, _ in parts for k in p.to_pylist()] == list(range(len(texts)))


def expected_tokens(rows, library):
    out, start = set(), 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.add((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_odd(documents, rows_of, library):
    rows = [*ODD, (None, "no id"), (99, "a <|endoftext|> b"), (-5, "before")]
    found = tokenfile.token_digests(documents(rows), BYTES, chunk_ids=50)
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == expected_tokens(rows, library)
    assert tokenfile.token_digests(documents(rows).limit(0), BYTES).count() == 0


def test_token_files_repeated_ids(documents, library):
    docs = documents([(7, "one two"), (7, "one two"), (7, "three"), (3, "x")])
    found = sorted(tuple(r) for r in tokenfile.token_digests(docs, BYTES).collect())
    assert [r[0] for r in found] == [3, 7, 7, 7]
    assert found[-1][1] + found[-1][2] == sum(r[2] for r in found)


def test_token_files_sample(spark, sample, rows_of, library):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    manifest = tokenfile.token_files(sample, BYTES)
    found = tokenfile.read_tokens(spark, manifest, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
                                  "n_tokens bigint, ids_crc32 bigint")
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == expected_tokens(rows, library)
    texts = dict(rows)
    for r in tokenfile.read_tokens(spark, manifest, lambda ids: (ids.tolist(),), "ids array<int>").collect():
        assert library.decode(r.ids[:-1]) == texts[r.doc_id] and r.ids[-1] == 2


def expected_pages(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            data = (html or "").encode()
            first[data] = min(page, first.get(data, page))
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = first.get(data)
        other = None if other == page else other
        out.add((page, len(data), digest, "response" if other is None else "revisit", other))
    return out


COLUMNS = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
PAGES = [(5, "http://a/", "<p>x</p>"), (2, "http://b/ c\r\nX: y", "<p>x</p>"), (9, None, None), (4, "", ""), (None, "u", "<p>x</p>"),
         (None, "u", "lone"), (11, "v", "\r\n\r\nWARC/1.1\r\n\x00é" * 40), (12, "w", "z" * 300_000), (-3, "é", "ä")]


def test_archives_odd(spark, rows_of):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES],
                                  "page_id bigint, url string, html string, digest string, first int")
    expected = expected_pages(PAGES)
    manifest = warc.write_archives(pages, file_bytes=200)
    for split in (7, 150, 1 << 20):
        assert rows_of(warc.read_archives(manifest, split), *COLUMNS) == expected
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    doubled = warc.read_archives(warc.write_archives(pages.union(pages)))
    assert doubled.count() == 2 * len(PAGES) and rows_of(doubled.where("page_id is not null"), *COLUMNS) == {
        r for r in expected if r[0] is not None}
    long = warc.read_archives(warc.write_archives(pages, least=9))
    assert {r[3] for r in rows_of(long, *COLUMNS)} == {"response"}


def test_archives_sample(spark, rows_of):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html").limit(10))
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    manifest = warc.write_archives(pages)
    found = warc.read_archives(manifest, 4096, payloads=True)
    assert rows_of(found, *COLUMNS) == expected_pages(rows)
    html = {p: h for p, _, h in rows}
    assert all(r.payload.decode() == html[r.page_id] for r in found.where("record_type = 'response'").collect())
    for r in manifest.collect():  # members one after the other are a gzip file like any other
        with open_input(r.file) as source:
            assert gzip.decompress(source.read()).count(b"WARC/1.1\r\nWARC-Type") == r.records


def test_every_range_owns_what_starts_in_it(tmp_path):
    rng = random.Random(1)
    records = [warc.record(i, None, bytes(rng.randrange(256) for _ in range(rng.randrange(400))), None) for i in range(30)]
    # noise that looks like the start of a member, between and inside of records
    noise = [b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + b"junk" * 3, gzip.compress(b"not a record")]
    records += [warc.record(30 + i, None, n * 20, None) for i, n in enumerate(noise)]
    data = b"".join(warc.member(r, level=rng.choice([0, 6])) + rng.choice([b"", *noise]) for r in records)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for size in (1, 3, 64, 1000, len(data)):
        with open_input(str(path)) as source:
            found = [r for at in range(0, len(data), size)
                     for r in warc.records_in(source, at, min(at + size, len(data)))]
        assert found == records
