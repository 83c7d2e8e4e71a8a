"""Best score per product and tag, taken where the scores are made.

Scores never become rows of their own: each Arrow batch is reduced to the
maximum per product and tag, and what cannot reach the bounds is not even
multiplied. With `k`, a task keeps the k best products of each tag, and its
k-th score is the bound for all that follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from trendloom.functions.vectors import SCORE_DIGITS
from trendloom.operators.similarity import CELLS_PER_STEP, prepared_items, prepared_tags, tag_blocks, tag_matrices
from trendloom.session import cut_lineage

#: Rows of k-best lists that a task holds, and as many again until they are cut; tags are taken in blocks of this many over k.
HELD_ROWS = 1 << 20

#: Groups of a block up to which its rows are chosen by name before they are joined.
NAMED_GROUPS = 200


class Keeper:
    """What one task has found for the tags of one group."""

    def __init__(self, floors, above: float | None, digits: int | None, k: int | None) -> None:
        import numpy as np

        self.above = -np.inf if above is None else above
        self.floors = np.where(np.isnan(floors), -np.inf, floors)
        self.kth = np.full(len(floors), -np.inf)
        self.digits, self.k, self.parts, self.rows = digits, k, [], 0
        self.slack = 0.0 if digits is None else 10.0 ** -digits

    def reach(self) -> float:
        """Scores below this matter for no tag."""
        import numpy as np

        return float(np.maximum(np.maximum(self.floors, self.above), self.kth).min(initial=np.inf)) - self.slack

    def best(self, products, scores):
        """product, tag number and score of the maxima that matter; `scores` has a row for each of `products`."""
        import numpy as np
        import pyarrow as pa

        codes = products.dictionary_encode()
        numbers = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(numbers, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(numbers[order]) > 0))
        most = np.fmax.reduceat(scores[order], starts, axis=0)
        if self.digits is not None:
            most = np.round(most, self.digits)
        row, tag = np.nonzero((most > self.above) & (most >= np.maximum(self.floors, self.kth)))
        return codes.dictionary.take(pa.array(numbers[order][starts][row])), tag.astype(np.int32), most[row, tag]

    def hold(self, found) -> None:
        import pyarrow as pa

        self.parts.append(pa.table([found[0], pa.array(found[1]), pa.array(found[2])], names=["p", "t", "s"]))
        self.rows += len(found[0])
        if self.rows > max(1 << 16, 2 * self.k * len(self.kth)):
            self.prune()

    def prune(self):
        """The k best products of each tag out of what is held, equal scores by product."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # on one thread, as each would hold groups of its own and the cores have tasks
        held = pa.concat_tables(self.parts).group_by(["t", "p"], use_threads=False).aggregate([("s", "max")])
        held = held.take(pc.sort_indices(held, sort_keys=[("t", "ascending"), ("s_max", "descending"), ("p", "ascending")]))
        tags, scores = held.column("t").to_numpy(), held.column("s_max").to_numpy()
        ends = np.searchsorted(tags, np.arange(len(self.kth) + 1))
        full = np.diff(ends) >= self.k
        self.kth[full] = scores[ends[:-1][full] + self.k - 1]
        held = held.filter(pa.array(np.arange(len(tags)) - ends[tags] < self.k))
        self.parts = [held.rename_columns(["t", "p", "s"]).select(["p", "t", "s"])]
        self.rows = held.num_rows
        pa.default_memory_pool().release_unused()
        return self.parts[0]


def _kernel(held, group: str, key: str, above, digits, k, rows_of):
    """A function over Arrow batches. `rows_of(batch, tags, keeper)` yields products and their scores of a group's rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tags, keepers = held.value, {}

        def out(name, found):
            products, tag, score = found
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(name, groups.type.value_type), len(products)), products,
                 tags[name][0].take(pa.array(tag)), pa.array(score)], names=[group, key, "tag", "score"])

        for batch in batches:
            groups = batch.column(group).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                if name not in tags:
                    continue
                keeper = keepers.get(name) or keepers.setdefault(name, Keeper(tags[name][2], above, digits, k))
                rows = batch.take(pa.array(np.nonzero(codes == code)[0]))
                for products, scores in rows_of(rows, tags[name], keeper):
                    found = keeper.best(products, scores)
                    if len(found[0]) and k is None:
                        yield out(name, found)
                    elif len(found[0]):
                        keeper.hold(found)
        for name, keeper in keepers.items():
            if keeper.parts:
                for part in keeper.prune().to_batches(max_chunksize=10_000):
                    yield out(name, (part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy()))

    return run


def _vector_rows(key: str, step: int):
    """Scores of rows that carry vectors; rows whose weight and length cannot bring them to the bounds are left out."""

    def rows_of(batch, tags, keeper):
        import numpy as np
        import pyarrow as pa

        _, matrix, _ = tags
        if (batch.column("__vec").value_lengths().to_numpy() != len(matrix)).any():
            raise ValueError("item and tag vectors differ in length")
        flat = batch.column("__vec").flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
        vectors = flat.reshape(batch.num_rows, len(matrix))
        weights = batch.column("__weight").to_numpy(zero_copy_only=False)
        longest = np.sqrt(np.einsum("ij,ij->j", matrix, matrix)).max(initial=0.0)
        bounds = np.abs(weights) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * longest * (1 + 1e-12)
        rows = max(1, step // max(1, matrix.shape[1]))
        products = batch.column(key)
        # rows of a product lie together, and so do the largest bounds where k raises the bar
        order = np.argsort(-bounds, kind="stable") if keeper.k else np.arange(batch.num_rows)
        for start in range(0, len(order), rows):
            at = order[start:start + rows]
            at = at[bounds[at] >= keeper.reach()]
            if len(at):
                yield products.take(pa.array(at)), (vectors[at] @ matrix) * weights[at, None]

    return rows_of


def _packed_rows(key: str, step: int):
    """Scores of rows that carry those of their text, one for each tag of the group."""

    def rows_of(batch, tags, keeper):
        import numpy as np
        import pyarrow as pa

        width = tags[1].shape[1]
        scores = batch.column("__scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        weights = batch.column("__weight").to_numpy(zero_copy_only=False)
        bounds = weights * scores.max(axis=1, initial=-np.inf)
        rows = max(1, step // max(1, width))
        products = batch.column(key)
        order = np.argsort(-bounds, kind="stable") if keeper.k else np.arange(batch.num_rows)
        for start in range(0, len(order), rows):
            at = order[start:start + rows]
            at = at[bounds[at] >= keeper.reach()]
            if len(at):
                yield products.take(pa.array(at)), scores[at] * weights[at, None]

    return rows_of


def _blocks(tags: DataFrame, group: str, k: int | None) -> list[tuple]:
    """Shared matrices of the tags, block by block, and a condition on the rows that have tags there; see `tag_blocks`.

    A block that lists are held for is one of whole groups, unless a group is
    too large for one: so a row passes through as few blocks as can be.
    """
    sc = tags.sparkSession.sparkContext
    most = max(1, HELD_ROWS // k) if k else None
    blocks = [b for part in tag_blocks(tags, group) for b in _split(tag_matrices(part.toArrow(), group), most)]
    chosen = [F.col(group).isin(list(b)) if len(blocks) > 1 and len(b) <= NAMED_GROUPS else F.lit(True) for b in blocks]
    return [(sc.broadcast(b), c) for b, c in zip(blocks, chosen, strict=True)]


def _split(matrices: dict, most: int | None) -> list[dict]:
    """The matrices in dictionaries of at most `most` tags each; a group of more than that is cut."""
    if most is None or sum(len(names) for names, _, _ in matrices.values()) <= most:
        return [matrices]
    blocks, room = [], 0
    for name, (names, matrix, floors) in sorted(matrices.items(), key=lambda m: -len(m[1][0])):
        for start in range(0, len(names), most):
            end = min(start + most, len(names))
            if end - start > room:
                blocks.append({})
                room = most
            blocks[-1][name] = (names.slice(start, end - start), matrix[:, start:end].copy(), floors[start:end])
            room -= end - start
    return blocks


def _schema(rows: DataFrame, group: str, key: str) -> StructType:
    return StructType([rows.schema[group], rows.schema[key], StructField("tag", StringType()), StructField("score", DoubleType())])


def best_pairs(items: DataFrame, tags: DataFrame, key: str = "product_id", item_vec: str = "text_embedding",
               tag_vec: str = "embedding", weight: str | None = None, on: str = "category", above: float | None = 0.0,
               floor: str | None = None, k: int | None = None, digits: int | None = SCORE_DIGITS) -> DataFrame:
    """`on`, `key`, tag, score: at most one row per key and tag out of each Arrow batch.

    The maxima of these per key and tag are those of `similarity_join` over
    all pairs. With `k`, at most k rows per tag come out of each task, and
    the k best keys of each tag, equal scores by key, are among them. Rows
    without key, group, vector or weight have no score.
    """
    rows = prepared_items(items.where(F.col(key).isNotNull()), [key], on, item_vec, weight)
    shared = _blocks(prepared_tags(tags, on, tag_vec, floor), on, k)
    if len(shared) > 1:
        rows = cut_lineage(rows, "items")  # read once per block, worked out once
    schema = _schema(rows, on, key)
    return reduce(DataFrame.unionByName, [
        rows.where(chosen).mapInArrow(_kernel(held, on, key, above, digits, k, _vector_rows(key, CELLS_PER_STEP)), schema)
        for held, chosen in shared])


def best_of_texts(rows: DataFrame, texts: DataFrame, tags: DataFrame, text_key: Sequence[str], key: str = "product_id",
                  weight: str = "weight", text_vec: str = "text_embedding", tag_vec: str = "embedding",
                  on: str = "category", above: float = 0.0, floor: str | None = None, k: int | None = None,
                  digits: int | None = SCORE_DIGITS, join=None) -> DataFrame:
    """As `best_pairs`, for rows that name a text: each of `texts` is scored once against the tags of its group.

    A text travels with its scores, an array in the order of the group's tags,
    to the rows that have it; weights are not negative. `join(rows, packed,
    text_key)` brings them together.
    """
    prepared = prepared_items(texts, list(text_key), on, text_vec, None).drop("__weight")
    shared, found = _blocks(prepared_tags(tags, on, tag_vec, floor), on, k), []
    if len(shared) > 1:
        prepared = cut_lineage(prepared, "text-vectors")
    for held, chosen in shared:
        packed = prepared.where(chosen).mapInArrow(
            _text_scores(held, list(text_key), on, above),
            StructType([*[prepared.schema[c] for c in text_key], StructField("__scores", ArrayType(DoubleType()))]))
        joined = join(rows.where(chosen), packed, list(text_key)).select(on, key, F.col(weight).cast("double").alias("__weight"), "__scores")
        found.append(joined.mapInArrow(
            _kernel(held, on, key, above, digits, k, _packed_rows(key, CELLS_PER_STEP)), _schema(joined, on, key)))
    return reduce(DataFrame.unionByName, found)


def _text_scores(held, columns: list[str], group: str, above: float):
    """Texts with an array of their scores; those without one above `above`, if that is not negative, are left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tags = held.value
        for batch in batches:
            groups = batch.column(group).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(groups.dictionary.to_pylist()):
                if name not in tags:
                    continue
                matrix = tags[name][1]
                at = np.nonzero(codes == code)[0]
                for start in range(0, len(at), max(1, CELLS_PER_STEP // max(1, matrix.shape[1]))):
                    rows = batch.take(pa.array(at[start:start + max(1, CELLS_PER_STEP // max(1, matrix.shape[1]))]))
                    if (rows.column("__vec").value_lengths().to_numpy() != len(matrix)).any():
                        raise ValueError("item and tag vectors differ in length")
                    flat = rows.column("__vec").flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
                    scores = np.nan_to_num(flat.reshape(rows.num_rows, len(matrix)) @ matrix, nan=-np.inf)
                    some = np.nonzero(scores.max(axis=1, initial=-np.inf) > min(above, 0.0))[0]
                    if len(some):
                        ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * matrix.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [*rows.select(columns).take(pa.array(some)).columns,
                             pa.ListArray.from_arrays(ends, pa.array(scores[some].ravel()))], names=[*columns, "__scores"])

    return run
