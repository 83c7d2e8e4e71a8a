"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, components.

Distinct fingerprints are dealt to buckets by pairs of equal bit blocks: of
`radius + 2` blocks, two fingerprints within the radius agree on at least two,
so every link lies in some bucket. Inside a bucket fingerprints stand as bit
planes; carry-save counters add up 64 distances per machine word, and words
whose distances all exceed the radius are given up.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendloom.llm.common import by_place, cut_lineage, map_texts, row_key
from trendloom.llm.components import Forest, connected_components
from trendloom.operators.sizing import row_partitions

SHINGLE = 3
RADIUS = 3
#: Fingerprints of a bucket that are compared in one task; larger buckets are dealt in cells.
CELL = 2048
#: Fingerprints that a task takes together.
_GATHER = 1 << 15
_HASHES_AT_ONCE = 1 << 15


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; zero without words.

    A text of fewer words than a shingle is one shingle.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i:i + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a key of the row), fp (the fingerprint as a signed 64-bit number), one row per input row."""
    def run(rows):
        for key, row, data in rows:
            fp = fingerprint(data, shingle)
            yield key, row, fp - (1 << 64) if fp >> 63 else fp

    docs, (doc_id, text) = by_place(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(doc_id, text).alias("row"),
                       F.col(text).alias("text"))
    return map_texts(docs, run, "doc_id bigint, row bigint, fp bigint")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Place and width of the bit blocks."""
    count = radius + 2
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def buckets(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, bucket: one row for each pair of blocks; the number of the pair is part of the bucket."""
    def bits(place: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", place).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for n, ((p, v), (q, w)) in enumerate(combinations(_blocks(radius), 2)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(n).cast("bigint"), v).bitwiseOR(bits(p, v)), w).bitwiseOR(bits(q, w)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))


def in_cells(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds `cell`: buckets of over `cell` rows are dealt in parts, and each pair of parts meets in a cell of its own.

    Nothing is dropped: rows of such a bucket are copied once per part.
    """
    crowded = cut_lineage(
        rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > cell)
        .select(F.col("bucket").alias("crowded"), F.ceil(F.col("n") / cell).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("bigint"))
    dealt = rows.join(crowded, F.col("bucket") == F.col("crowded"), "left").drop("crowded")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("bigint")
    others = F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1)
    meets = F.transform(others, lambda o: F.shiftleft(F.least(o, F.col("part")), 24) + F.greatest(o, F.col("part")))
    return dealt.withColumn("part", part).withColumn("cell", F.explode(meets)).drop("part", "parts")


def linked(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS):
    """Yields pairs of places (left, right) within the radius and of one group.

    Rows lie group by group. Rows d apart are compared for d = 1, 2, ...; a
    machine word holds 64 such pairs.
    """
    n = len(fps)
    words = -(-n // 64)
    ends = np.nonzero(np.append(groups[1:] != groups[:-1], True))[0]
    follow = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)
    padded = np.zeros(words * 64, np.int64)
    padded[:n] = follow
    follow = padded.reshape(words, 64)
    most = follow.max(axis=1)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    planes = np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)
    counters = radius.bit_length()
    for d in range(1, int(most.max(initial=0)) + 1):
        at = np.nonzero(most >= d)[0]
        alive = np.packbits(follow[at] >= d, axis=1, bitorder="little").view(np.uint64).ravel()
        step, shift = divmod(d, 64)
        low, high = np.uint64(shift), np.uint64(64 - shift)
        digits = [np.zeros(len(at), np.uint64) for _ in range(counters)]
        for p in range(64):
            plane = planes[p]
            other = plane[np.minimum(at + step, words)]
            if shift:
                other = other >> low | plane[np.minimum(at + step + 1, words)] << high
            carry = plane[at] ^ other
            for i in range(counters):
                digits[i], carry = digits[i] ^ carry, digits[i] & carry
            # what is carried out of the last digit is beyond any radius of that many digits
            alive &= ~carry
            if p % 8 == 7:
                if radius + 1 < 1 << counters:
                    alive &= ~_above(digits, radius)
                still = alive != 0
                if not still.all():
                    at, alive = at[still], alive[still]
                    digits = [x[still] for x in digits]
                if not len(at):
                    break
        if len(at):
            left = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, place = np.nonzero(left)
            left = at[word] * 64 + place
            yield left, left + d


def _above(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits where the counter, given digit by digit, exceeds the radius."""
    above = np.zeros_like(digits[0])
    equal = ~above
    for i in reversed(range(len(digits))):
        if radius >> i & 1:
            equal &= digits[i]
        else:
            above |= equal & digits[i]
            equal &= ~digits[i]
    return above


def _bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """Edges from each linked fingerprint to the least one of its links in the bucket."""
    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        size = 0

        def solve(block: np.ndarray):
            groups = np.cumsum(np.append(True, (block[1:, 1:] != block[:-1, 1:]).any(axis=1)))
            fps = np.ascontiguousarray(block[:, 0]).view(np.uint64)
            forest = Forest(len(fps))
            for left, right in linked(fps, groups, radius):
                forest.link(left, right)
            moved = forest.root != np.arange(len(fps))
            values = block[:, 0]
            return pa.RecordBatch.from_arrays(
                [pa.array(values[moved]), pa.array(values[forest.root[moved]])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= _GATHER:
                block = np.concatenate(held)
                last = (block[:, 1:] == block[-1, 1:]).all(axis=1)
                first = int(np.argmax(last))  # the last bucket may go on
                if first:
                    yield solve(block[:first])
                held, size = [block[first:]], len(block) - first
        if size:
            yield solve(np.concatenate(held))

    n = row_partitions(rows)
    rows = rows.select("fp", "bucket", "cell").repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell", "fp")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, radius: int, cell: int) -> DataFrame:
    """key, component: for each distinct fingerprint the least one reachable."""
    distinct = cut_lineage(docs.select("fp").distinct(), "distinct")
    edges = _bucket_edges(in_cells(buckets(distinct, radius), cell), radius)
    members = cut_lineage(connected_components(edges), "members")
    return distinct.join(members, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("key"), F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id",
                    text: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per input row.

    Fingerprints that differ in `radius` bits or fewer are linked, and
    component_id is the smallest doc_id reachable. A null text has no words
    and the fingerprint zero, which is linked like any other. Rows with a
    null doc_id take part; a component of such rows alone has a null id.
    Repeated rows are rows of one component. Other columns are ignored.
    """
    docs = cut_lineage(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    least = docs.groupBy(F.col("fp").alias("f")).agg(F.min("doc_id").alias("least"))
    classes = cut_lineage(_classes(docs, radius, cell).join(least, F.col("key") == F.col("f")).drop("f"), "classes")
    ids = classes.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, F.col("component") == F.col("c")).select("key", "component_id")
    return docs.join(classes, F.col("fp") == F.col("key")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id",
                     text: str = "text", cell: int = CELL) -> DataFrame:
    """The row of the smallest doc_id of each group of near-duplicates, all columns as they are.

    A null id is the largest here; of different texts of one id the one with
    the least hash stays, of repeated rows (equal id and text) any. Rows are
    told apart by `row_key`. Texts move once, to the keys of those that stay.
    """
    rows, (key, body) = by_place(docs, doc_id, text)
    marks = cut_lineage(fingerprints(rows, shingle, key, body), "fingerprints")
    first = marks.groupBy(F.col("fp").alias("f")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    chosen = cut_lineage(
        _classes(marks, radius, cell).join(first, F.col("key") == F.col("f")).groupBy("component")
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias("chosen")), "chosen")
    rows = rows.withColumn("row", row_key(key, body))
    stay = rows.join(chosen, F.col("row") == F.col("chosen"), "left_semi")
    repeated = cut_lineage(
        marks.groupBy(F.col("row").alias("r")).agg(F.count("*").alias("n")).where("n > 1").select("r"), "repeated")
    if not repeated.isEmpty():
        # of repeated rows one per task goes on, and one of those stays
        once = Window.partitionBy("row").orderBy("row")
        many = stay.join(repeated, F.col("row") == F.col("r"), "left_semi").withColumn("n", F.row_number().over(once))
        stay = stay.join(repeated, F.col("row") == F.col("r"), "left_anti").unionByName(many.where("n = 1").drop("n"))
    return stay.drop("row").toDF(*docs.columns)
