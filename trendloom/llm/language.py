"""Language identification by compression.

For each language a bounded sample of its texts is a raw-content dictionary
of a zstd compressor. A text belongs to the language whose dictionary makes
it smallest; where the second comes too near, the guess is marked as rejected.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.llm.common import by_place, change_rows, map_texts

#: The sample: slices of so many characters from so many documents of each language.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 240, 400
#: A text is compressed in pieces of so many bytes, each on its own, so that a
#: passage found in a dictionary outweighs no more than its own length.
PIECE = 512
#: Follows every piece: zstd stores what it can hardly shrink as it is, and so
#: would tell nothing about a few words alone.
CARRIER = bytes(64)
LEVEL = 6
#: Least margin of the best over the second, as a share of the second, of an accepted guess.
MARGIN = 0.002


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose id, as text, has a CRC-32 of 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS,
          but_held_out: bool = False) -> dict[str, bytes]:
    """Dictionary content for each language, the most frequent language first.

    The sample holds, for each language, the documents whose ids have the
    least hashes, and of each a slice at a place that the hash names. Rows
    without text, language or id teach nothing, nor do held-out ones if `but_held_out`.
    """
    labelled, (doc_id, text, lang) = by_place(labelled, doc_id, text, lang)
    if but_held_out:
        labelled = labelled.where(~held_out(doc_id))
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).na.drop()
    rows = rows.where(rows.text.rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    order = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").collect()]
    number = F.xxhash64("id")
    place = F.pmod(number, F.greatest(F.char_length("text") - characters, F.lit(1))).cast("int") + 1
    slices = rows.select("lang", number.alias("number"), "id", F.substring("text", place, F.lit(characters)).alias("slice"))
    # Spark keeps the first rows of a language in each task, so no more than those are shuffled
    first = Window.partitionBy("lang").orderBy("number", "id", "slice")
    picked = slices.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= documents)
    content: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "rank", "slice").orderBy("lang", "rank").collect():
        content.setdefault(r["lang"], []).append(r["slice"].lower().encode())
    return {name: b"\n".join(content[name]) for name in order}


class Classifier:
    """Compressors of all languages; ties go to the language learned first."""

    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], level: int = LEVEL, piece: int = PIECE) -> None:
        import zstandard

        self.names = [name for name, _ in dictionaries]
        self.piece = piece
        self.encoders = []
        for _, content in dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(
                level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes with each dictionary, of a text as it stands."""
        pieces = [data[i:i + self.piece] + CARRIER for i in range(0, len(data), self.piece)]
        return [sum(map(len, map(encoder.compress, pieces))) for encoder in self.encoders]

    def guess(self, data: bytes | None) -> tuple[str, float]:
        """Language and margin; `und` and zero without text, letters or languages."""
        text = data.decode() if data else ""
        if not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0
        sizes = self.sizes(text.lower().encode())
        best = min(sizes)
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = sorted(sizes)[1]
        return self.names[sizes.index(best)], (second - best) / second


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple) -> Classifier:
    return Classifier(dictionaries)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the margin, 0 to 1), accepted, one row per input row.

    `und` with score zero, and rejected, where the text is null or holds no
    letter, or nothing was learned. A margin below `margin` is a rejection
    too; the guess is given all the same, and on a tie it is the language
    learned from most documents. Only the text is looked at.
    """
    known = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def run(rows):
        classifier = _classifier(known.value)
        for key, held, data in rows:
            name, score = classifier.guess(data)
            yield key, held, name, score, name != "und" and score >= margin

    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.col(text).alias("text"))
    return map_texts(docs, run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                    margin: float = MARGIN) -> DataFrame:
    """Rows of `docs` whose language is accepted; all columns as they are."""
    known = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def change(data):
        name, score = _classifier(known.value).guess(data)
        return name != "und" and score >= margin, data

    return change_rows(docs, text, change)
