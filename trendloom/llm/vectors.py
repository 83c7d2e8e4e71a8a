"""Near-duplicate embeddings by randomly rotated binary codes.

A vector's code holds the signs of its coordinates under several random
rotations, and one correction factor per rotation: the inner product of the
rotated vector with its own code. With the factors, code and vector give an
unbiased estimate of an inner product and a bound of its error; only pairs
whose estimate can reach the threshold are computed exactly.

Slices of the code serve as keys: vectors meet in the buckets of several
tables, as many as bring pairs at the threshold together with probability
`recall`. A pair is counted in the first table in which it meets.

Codes alone travel to the buckets of all tables, where packed bits are
compared; vectors and factors follow only those that a bucket has found a
partner for.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trendloom.llm.common import arrow_schema, cut_lineage, small_batches
from trendloom.llm.components import Forest, connected_components
from trendloom.operators.sizing import row_partitions

THRESHOLD = 0.98
#: Share of the pairs at the threshold itself that meet in some table; closer pairs meet more often.
RECALL = 0.9999
#: Standard errors of an estimate that count as its bound.
ERRORS = 5.0
#: Vectors of a bucket that the number of key bits aims at, and beyond which a bucket is dealt in cells.
BUCKET, CELL = 512, 2048
SEED = 42
_ROWS = 256


def tables_for(largest: int, threshold: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Key bits and tables for groups of at most `largest` vectors."""
    bits = max(4, math.ceil(math.log2(max(1, largest) / bucket)))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree))) if agree < 1 else 1


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """`count` random rotations, one below the other."""
    parts = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, i]).standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def encode(units: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (one row each, as 0 and 1) and correction factors, one per rotation."""
    n, dim = units.shape
    turned = units @ rotations(dim, count).T
    factors = np.abs(turned).reshape(n, count, dim).sum(axis=2) / math.sqrt(dim)
    return (turned > 0).astype(np.uint8), factors


def bucket_links(units: np.ndarray, signs: np.ndarray, factors: np.ndarray, keys: np.ndarray, table: int,
                 parts: np.ndarray, across: bool, threshold: float, errors: float = ERRORS):
    """Yields (left, right) places of the linked pairs that this bucket has to count.

    keys: of all tables. With `across`, only pairs of different parts count.
    """
    n, dim = units.shape
    count = factors.shape[1]
    turned = (units @ rotations(dim, count).T).astype(np.float32)
    scale = np.repeat(1 / (factors * math.sqrt(dim) * count), dim, axis=1)
    codes = ((signs * 2.0 - 1) * scale).astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 / factors**2 - 1).mean(axis=1) / (count * max(1, dim - 1)))
    least = threshold - errors * spread - 1e-4
    for at in range(0, n, _ROWS):
        estimate = codes[at:at + _ROWS] @ turned[at:].T
        left, right = np.nonzero(estimate >= least[at:at + _ROWS, None])
        left, right = left + at, right + at
        wanted = left < right
        if across:
            wanted &= parts[left] != parts[right]
        left, right = left[wanted], right[wanted]
        if table and len(left):
            new = (keys[left, :table] != keys[right, :table]).all(axis=1)
            left, right = left[new], right[new]
        if len(left):
            exact = np.einsum("ij,ij->i", units[left], units[right]) >= threshold
            if exact.any():
                yield left[exact], right[exact]


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def close_rows(code: np.ndarray, bits: int, keys: np.ndarray, table: int, parts: np.ndarray, across: bool,
               threshold: float, errors: float = ERRORS) -> np.ndarray:
    """Which rows have a partner that `bucket_links` has to look at, by the bits in which packed codes differ.

    At the threshold a bit differs with the probability angle / pi; `errors`
    standard errors above that, and a bit for rounding, still pass.
    """
    share = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    most = math.ceil(bits * share + errors * math.sqrt(bits * share * (1 - share))) + 1
    n = len(code)
    wide = np.zeros((n, -(-code.shape[1] // 8) * 8), np.uint8)
    wide[:, :code.shape[1]] = code
    words = np.ascontiguousarray(wide.view(np.uint64).T)
    near = np.zeros(n, bool)
    for at in range(0, n, _ROWS):
        apart = np.zeros((min(_ROWS, n - at), n - at), np.int32)
        for word in words:
            apart += np.bitwise_count(word[at:at + _ROWS, None] ^ word[None, at:])
        left, right = np.nonzero(apart <= most)
        left, right = left + at, right + at
        wanted = left < right
        if across:
            wanted &= parts[left] != parts[right]
        left, right = left[wanted], right[wanted]
        for t in range(table):  # tables in turn, as a bucket of near copies has many pairs
            new = keys[left, t] != keys[right, t]
            left, right = left[new], right[new]
        near[left] = near[right] = True
    return near


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """grp, node, n, code, factors, vec (at unit length) for each class."""
    schema = "grp bigint, node bigint, n bigint, code binary, factors binary, vec binary"
    small_batches(classes.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            rest = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("grp", "node", "n")}
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes).tolist():
                rows = np.nonzero(sizes == dim)[0]
                units = unit(np.array([vectors[i] for i in rows.tolist()], np.float64))
                signs, factors = encode(units, max(2, -(-bits * tables // dim)))
                blobs = [[x.tobytes() for x in a] for a in (np.packbits(signs, axis=1), factors, units)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rest[c][rows]) for c in ("grp", "node", "n")] + [pa.array(b, pa.binary()) for b in blobs],
                    schema=arrow_schema(schema))

    return classes.select("grp", "node", "n", "vec").mapInArrow(run, schema)


def _dealt(coded: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each class and table: grp, place (table and key), node, code."""
    schema = "grp bigint, place bigint, node bigint, code binary"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            grp, node, code = batch.columns
            wanted = bits * tables
            head = np.frombuffer(b"".join(c[:-(-wanted // 8)] for c in code.to_pylist()), np.uint8)
            signs = np.unpackbits(head.reshape(batch.num_rows, -1), axis=1, count=wanted)
            places = _keys(signs, bits, tables) + (np.arange(tables) << bits)
            again = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            yield pa.RecordBatch.from_arrays([grp.take(again), pa.array(places.ravel()), node.take(again), code.take(again)],
                                             schema=arrow_schema(schema))

    return coded.select("grp", "node", "code").mapInArrow(run, schema)


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys of all tables: slices of the code as numbers."""
    return signs[:, :bits * tables].reshape(len(signs), tables, bits).astype(np.int64) @ (1 << np.arange(bits))


def _in_cells(rows: DataFrame, cell: int) -> DataFrame:
    """Adds `part` and `cell`: buckets of over `cell` rows are dealt in parts, each pair of which has a cell."""
    crowded = cut_lineage(
        rows.groupBy("grp", "place").agg(F.count("*").alias("rows")).where(F.col("rows") > cell)
        .select(F.col("grp").alias("g"), F.col("place").alias("p"), F.ceil(F.col("rows") / cell).cast("int").alias("parts")),
        "crowded")
    if crowded.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("bigint")).withColumn("cell", F.lit(0).cast("bigint"))
    dealt = rows.join(crowded, (F.col("grp") == F.col("g")) & (F.col("place") == F.col("p")), "left").drop("g", "p")
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("bigint"))
    others = F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)
    meets = F.transform(others, lambda o: F.shiftleft(F.least(o, F.col("part")), 24) + F.greatest(o, F.col("part")))
    return dealt.withColumn("cell", F.explode(meets)).drop("parts")


def _by_bucket(rows: DataFrame, solve, schema: str) -> DataFrame:
    """`solve` for the rows of each bucket's cell that has two or more."""
    names = ["grp", "place", "cell"]

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            block = pa.Table.from_batches([batch])
            held = block if held is None else pa.concat_tables([held, block])
            marks = np.stack([held.column(c).to_numpy() for c in names])
            ends = np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1
            start = 0
            for end in ends.tolist():
                if end - start > 1:
                    yield solve(held.slice(start, end - start))
                start = end
            held = held.slice(start)  # the last bucket may go on
        if held is not None and held.num_rows > 1:
            yield solve(held)

    rows = rows.repartition(row_partitions(rows), *names).sortWithinPartitions(*names, "node")
    return rows.mapInArrow(run, schema)


def _across(cell: int) -> bool:
    return cell >> 24 != cell & (1 << 24) - 1


def _met(rows: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """place, part, cell, node: the rows whose codes are close to another one's of their bucket."""
    schema = "place bigint, part bigint, cell bigint, node bigint"

    def solve(block):
        import pyarrow as pa

        column = {c: block.column(c).combine_chunks() for c in block.column_names}
        code = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(block.num_rows, -1)
        keys = _keys(np.unpackbits(code, axis=1, count=bits * tables), bits, tables)
        near = close_rows(code, code.shape[1] * 8, keys, column["place"][0].as_py() >> bits, column["part"].to_numpy(),
                          _across(column["cell"][0].as_py()), threshold)
        return pa.RecordBatch.from_arrays(
            [column[f].filter(pa.array(near)) for f in ("place", "part", "cell", "node")], schema=arrow_schema(schema))

    return _by_bucket(rows, solve, schema)


def _bucket_results(rows: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Of each bucket: edges (node, other) of its components, and rows (node, null, links) of counts."""
    schema = "node bigint, other bigint, links bigint"

    def solve(block):
        import pyarrow as pa

        column = {c: block.column(c).combine_chunks() for c in block.column_names}
        nodes, times = column["node"].to_numpy(), column["n"].to_numpy()
        size = block.num_rows
        units = np.frombuffer(b"".join(column["vec"].to_pylist()), np.float64).reshape(size, -1)
        factors = np.frombuffer(b"".join(column["factors"].to_pylist()), np.float64).reshape(size, -1)
        code = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(size, -1)
        signs = np.unpackbits(code, axis=1, count=units.shape[1] * factors.shape[1])
        forest, links = Forest(size), np.zeros(size, np.int64)
        for left, right in bucket_links(
                units, signs, factors, _keys(signs, bits, tables), column["place"][0].as_py() >> bits,
                column["part"].to_numpy(), _across(column["cell"][0].as_py()), threshold):
            np.add.at(links, left, times[right])
            np.add.at(links, right, times[left])
            forest.link(left, right)
        moved, counted = np.nonzero(forest.root != np.arange(size))[0], np.nonzero(links)[0]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([nodes[moved], nodes[counted]])),
            pa.concat_arrays([pa.array(nodes[forest.root[moved]]), pa.nulls(len(counted), pa.int64())]),
            pa.array(np.concatenate([np.zeros(len(moved), np.int64), links[counted]]))], schema=arrow_schema(schema))

    return _by_bucket(rows, solve, schema)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, vec_id: str = "vec_id",
                 embedding: str = "embedding", label: str = "label", cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per input row.

    Vectors of one label and one length are linked if their cosine, in double
    precision, reaches `threshold`. A row without label or id, or whose vector
    is null, empty, zero, or holds a null or a number that is not finite,
    links with nothing and is its own component. Repeated rows are vectors of
    their own that link with each other. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vec"),
                          F.xxhash64(label, F.size(embedding)).alias("grp"),
                          (F.col(label).isNotNull() & F.col(vec_id).isNotNull() & _valid(F.col(embedding))).alias("valid"))
    rows = rows.withColumn("node", F.when(F.col("valid"), F.xxhash64("grp", "vec")))
    classes = cut_lineage(rows.where("valid").groupBy("node").agg(
        F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"),
        F.count("*").alias("n")), "classes")
    largest = classes.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits, tables = tables_for(largest, threshold, recall)
    coded = cut_lineage(_coded(classes, bits, tables), "coded")
    met = cut_lineage(_met(_in_cells(_dealt(coded, bits, tables), cell), bits, tables, threshold), "met")
    pairs = met.withColumnRenamed("node", "m").join(coded, F.col("m") == F.col("node")).drop("m")
    found = cut_lineage(_bucket_results(pairs, bits, tables, threshold), "links")
    members = connected_components(
        found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = (classes.select("node", "least", "n")
              .join(members.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
              .join(links.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left")
              .select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "node").alias("component")))
    joined = cut_lineage(joined, "vectors")
    ids = joined.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    joined = joined.join(ids, F.col("component") == F.col("c")).select(F.col("node").alias("key"), "n_links", "component_id")
    out = rows.select("vec_id", "node").join(joined, F.col("node") == F.col("key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
