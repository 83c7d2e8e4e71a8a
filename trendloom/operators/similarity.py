"""Scoring of catalog rows against tags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trendloom.functions.vectors import SCORE_DIGITS, dot, to_doubles, weighted
from trendloom.operators.sizing import lookup_join, measure
from trendloom.session import cut_lineage

#: Tags that are broadcast at a time. More are taken in blocks, each in a pass of its own over the items.
BLOCK_TAGS = 50_000
BLOCK_BYTES = 256 << 20
TAGS_PER_BLOCK = 512
CELLS_PER_STEP = 4_000_000

_ANY = "__any"


def similarity_join(items: DataFrame, tags: DataFrame, keep: Sequence[str],
                    item_vec: str = "text_embedding", tag_vec: str = "embedding",
                    weight: str | None = None, on: str | None = "category",
                    above: float | None = 0.0, floor: str | None = None,
                    kernel: str = "arrow", digits: int | None = SCORE_DIGITS) -> DataFrame:
    """Dot product of each item with each tag of its group, times the item's weight.

    Both sides hold unit vectors, so the product is the cosine. Scores are
    rounded to `digits` decimals, if given. Only pairs with `score > above`,
    and `score >= floor` where the tags carry such a column, leave the kernel;
    other pairs never become rows. Vectors of different lengths in one group
    are an error.

    Both kernels give the same rows for any number of tags. `arrow` multiplies
    Arrow batches with the tags' matrix; the tags are measured, and broadcast
    in blocks of bounded size, so the items never move. `native` needs no
    Python and shuffles the items by group.
    """
    group = on or _ANY
    if on is None:
        items, tags = items.withColumn(_ANY, F.lit("")), tags.withColumn(_ANY, F.lit(""))
    keep = [c for c in keep if c != group]
    items = prepared_items(items, keep, group, item_vec, weight)
    tags = prepared_tags(tags, group, tag_vec, floor)
    if kernel == "native":
        scored = _native_scores(items, tags, keep, group)
    elif kernel == "arrow":
        parts = tag_blocks(tags, group)
        if len(parts) > 1:
            items = cut_lineage(items, "items")  # read once per block, worked out once
        scored = reduce(DataFrame.unionByName, [_arrow_scores(items, p.toArrow(), keep, group, above, digits) for p in parts])
    else:
        raise ValueError(f"no kernel {kernel!r}")
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    if above is not None:
        scored = scored.where(F.col("score") > above)
    return scored.where("__floor is null or score >= __floor").drop("__floor", _ANY)


def prepared_items(items: DataFrame, keep: Sequence[str], group: str, item_vec: str, weight: str | None) -> DataFrame:
    """Rows with a vector and a group: `keep`, group, __vec, __weight."""
    keep = [c for c in keep if c != group]
    return items.where(F.col(item_vec).isNotNull() & F.col(group).isNotNull()).select(
        *keep, F.col(group), F.col(item_vec).alias("__vec"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__weight"))


def prepared_tags(tags: DataFrame, group: str, tag_vec: str, floor: str | None) -> DataFrame:
    """Tags with a vector and a group: group, tag, __tag_vec, __floor."""
    return tags.where(F.col(tag_vec).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group), F.col("tag").cast("string").alias("tag"), to_doubles(tag_vec).alias("__tag_vec"),
        (F.col(floor) if floor else F.lit(None)).cast("double").alias("__floor"))


def tag_blocks(tags: DataFrame, group: str, most: int | None = None) -> list[DataFrame]:
    """Prepared tags, worked out once, in blocks of bounded bytes and rows (`most`, if that is less)."""
    tags = cut_lineage(tags, "tags")
    rows, size = measure(tags)
    blocks = max(1, -(-rows // max(1, min(BLOCK_TAGS, most or BLOCK_TAGS))), -(-size // BLOCK_BYTES))
    number = F.pmod(F.xxhash64(group, "tag", "__tag_vec"), F.lit(blocks))
    return [tags.where(number == i) for i in range(blocks)] if blocks > 1 else [tags]


def tag_matrices(held, group: str) -> dict:
    """By group: names, vectors as the columns of a matrix, floors (NaN where there is none)."""
    import numpy as np
    import pyarrow as pa

    by_group = {}
    codes = held.column(group).combine_chunks().dictionary_encode()
    numbers = codes.indices.to_numpy(zero_copy_only=False)
    vectors, names = held.column("__tag_vec").combine_chunks(), held.column("tag").combine_chunks()
    floors = held.column("__floor").to_numpy().astype("float64")
    for code, name in enumerate(codes.dictionary.to_pylist()):
        places = np.nonzero(numbers == code)[0]
        own = vectors.take(pa.array(places))
        flat = own.flatten().to_numpy(zero_copy_only=False)
        lengths = own.value_lengths().to_numpy()
        if len(np.unique(lengths)) > 1:
            raise ValueError(f"tag vectors of {name!r} differ in length")
        matrix = flat.reshape(len(places), -1).T.copy()
        by_group[name] = (names.take(pa.array(places)), matrix, floors[places])
    return by_group


def _arrow_scores(items: DataFrame, held, keep: Sequence[str], group: str,
                  above: float | None, digits: int | None) -> DataFrame:
    """Scores with the tags at hand; what rounding cannot bring to the bounds is left out already."""
    by_group = tag_matrices(held, group)
    shared = items.sparkSession.sparkContext.broadcast(by_group)
    schema = StructType([*[items.schema[c] for c in [*keep, group]],
                         StructField("tag", StringType()), StructField("score", DoubleType()),
                         StructField("__floor", DoubleType())])
    columns, step = [*keep, group], CELLS_PER_STEP
    slack = 0.0 if digits is None else 10.0 ** -digits

    def score(batches):
        import numpy as np
        import pyarrow as pa

        tags = shared.value
        for whole in batches:
            encoded = whole.column(group).dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            for code, g in enumerate(encoded.dictionary.to_pylist()):
                if g not in tags:
                    continue
                names, matrix, floors = tags[g]
                positions = np.nonzero(codes == code)[0]
                rows = max(1, step // matrix.shape[1])
                for start in range(0, len(positions), rows):
                    batch = whole.take(pa.array(positions[start:start + rows]))
                    flat = batch.column("__vec").flatten().to_numpy(zero_copy_only=False)
                    flat = flat.astype("float64", copy=False)
                    if (batch.column("__vec").value_lengths().to_numpy() != len(matrix)).any():
                        raise ValueError("item and tag vectors differ in length")
                    weights = batch.column("__weight").to_numpy(zero_copy_only=False)
                    scores = (flat.reshape(batch.num_rows, -1) @ matrix) * weights[:, None]
                    wanted = ~np.isnan(scores) if above is None else scores > above - slack
                    wanted &= np.isnan(floors)[None, :] | (scores >= floors[None, :] - slack)
                    item_at, tag_at = np.nonzero(wanted)
                    out = batch.select(columns).take(pa.array(item_at))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, names.take(pa.array(tag_at)),
                         pa.array(scores[item_at, tag_at]), pa.array(floors[tag_at], from_pandas=True)],
                        names=[*columns, "tag", "score", "__floor"])

    return items.mapInArrow(score, schema)


def _native_scores(items: DataFrame, tags: DataFrame, keep: Sequence[str], group: str) -> DataFrame:
    """Tags packed into arrays of bounded length, scored inside each item row."""
    counts = tags.groupBy(group).agg(
        F.ceil(F.count(F.lit(1)) / TAGS_PER_BLOCK).cast("int").alias("__blocks"))
    blocks = (
        tags.join(counts, [group])
        .withColumn("__block", F.pmod(F.xxhash64("tag", F.xxhash64("__tag_vec")), F.col("__blocks")))
        .groupBy(group, "__block")
        .agg(F.collect_list(F.struct("tag", "__tag_vec", "__floor")).alias("__tags"))
        .drop("__block"))
    items = items.withColumn("__vec", to_doubles("__vec"))
    joined = lookup_join(items, blocks, [group], "inner")

    def score(tag):
        differ = F.raise_error(F.lit("item and tag vectors differ in length")).cast("double")
        raw = weighted(dot(F.col("__vec"), tag["__tag_vec"]), F.col("__weight"))
        return F.when(F.size("__vec") == F.size(tag["__tag_vec"]), raw).otherwise(differ)

    pairs = F.transform("__tags", lambda t: F.struct(
        t["tag"].alias("tag"), score(t).alias("score"), t["__floor"].alias("__floor")))
    pairs = F.filter(pairs, lambda p: p["score"].isNotNull())
    return joined.select(*keep, group, F.inline(pairs))
