"""Shared by the operators: row keys, Arrow maps, saved steps."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trendloom.session import cut_lineage

#: Rows of a text table that are handed to Python at a time. Texts may be long;
#: rows of numbers are gathered again on the Python side where that pays.
ROWS_PER_BATCH = 256

__all__ = ["ROWS_PER_BATCH", "Memo", "by_place", "change_rows", "cut_lineage", "map_arrays", "map_texts", "place_of",
           "release_finished", "row_key", "rows_batch", "small_batches", "table"]


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def release_finished(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are saved by now.

    It does so once their plans are garbage, which the driver else collects at
    some later time. Python's handles of them go first, in the background; so
    the JVM is asked twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_of(df: DataFrame, name: str) -> int:
    """Place of the column called `name`: as it is spelt, else in any case. Dots have no meaning."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} among {df.columns}")
    return found[0]


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`df` with its columns called c0, c1, ..., and what those of `names` are called there.

    So no name in the input can be taken for one of ours, whatever dots or capitals it has.
    """
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{place_of(df, n)}" for n in names]


def row_key(*columns: str) -> Column:
    """64 bits that tell rows apart: equal rows share it, nulls have their own.

    Of n different rows about n * n / 2**65 pairs share a key too (one in 10^10 rows).
    """
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)


def map_texts(df: DataFrame, each: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows through a Python generator, batch by batch.

    `each` gets the rows of a batch as tuples, strings as UTF-8 bytes, and
    yields tuples of `schema`.
    """
    small_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        from trendloom.llm.common import arrow_schema

        kinds = arrow_schema(schema)
        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            rows = list(each(zip(*(c.to_pylist() for c in columns), strict=True)))
            arrays = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(a), type=f.type) for a, f in zip(arrays, kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def map_arrays(df: DataFrame, each: Callable[..., tuple], schema: str) -> DataFrame:
    """As `map_texts`, for many small output rows: `each(*row)` gives equally long numpy arrays."""
    small_batches(df.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from trendloom.llm.common import arrow_schema

        kinds = arrow_schema(schema)
        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            parts = [each(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            parts = [p for p in parts if len(p[0])]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a), type=f.type) for a, f in zip(zip(*parts, strict=True), kinds, strict=True)],
                    schema=kinds)

    return df.mapInArrow(run, schema)


def change_rows(df: DataFrame, text: str, change: Callable[..., tuple[bool, bytes | None]],
                n_chars: str | None = "n_chars", given: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `df`, all columns, with each text kept, replaced or its row dropped.

    `change` gets a text as UTF-8 bytes and gives (keep, text); a column
    `n_chars`, if there, is counted anew for texts that change. Columns
    `given` are handed to `change` too, and left out of the result.
    """
    small_batches(df.sparkSession)
    columns = df.columns
    place, rest = place_of(df, text), [i for i, c in enumerate(columns) if c not in given]
    at = columns.index(n_chars) if n_chars in columns else None
    placed, _ = by_place(df)
    schema = StructType([placed.schema.fields[i] for i in rest])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(place).cast(pa.binary()).to_pylist()
            more = [batch.column(columns.index(c)).to_pylist() for c in given]
            keep, new = zip(*map(change, old, *more), strict=True) if old else ((), ())
            changed = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a is not b and a != b]
            if changed:
                arrays = list(batch.columns)
                arrays[place] = pa.array(new, pa.binary()).cast(arrays[place].type)
                if at is not None:
                    counts = arrays[at].to_pylist()
                    for i in changed:
                        counts[i] = len(new[i].decode())
                    arrays[at] = pa.array(counts, arrays[at].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            if given:
                batch = batch.select(rest)
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return placed.mapInArrow(run, schema).toDF(*(columns[i] for i in rest))


class Memo(dict):
    """Results by key, of a bounded number of keys: beyond it the older half is forgotten."""

    def __init__(self, compute: Callable, limit: int = 1 << 19) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def rows_batch(rows: list, kinds):
    """Tuples, at least one, as an Arrow batch."""
    import pyarrow as pa

    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def arrow_schema(ddl: str):
    """The few types that the operators hand back, as an Arrow schema."""
    import pyarrow as pa

    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
             "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(plain[inner]) if kind.startswith("array<") else plain[kind]))
    return pa.schema(fields)
