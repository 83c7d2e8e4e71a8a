"""Only new files are processed, only missing categories are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trendloom.functions.encoders import Encoder
from trendloom.operators.sizing import row_partitions
from trendloom.session import cut_lineage
from trendloom.sources.readers import path_missing

#: Column, and name of the folders, that hold the number of an arrival.
ARRIVAL = "arrival"


def incremental_embed(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
                      transform: Callable[[DataFrame], DataFrame], schema: StructType,
                      max_files: int | None = None, partition_by: str | None = "category") -> None:
    """Run `transform` over the files not seen before and append the result.

    `transform` works row by row. The checkpoint remembers the files, and the
    file sink publishes a batch once, so a restarted run neither repeats nor
    loses rows.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (transform(reader.parquet(src_dir)).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint).option("path", out_dir)
              .outputMode("append").trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.start().awaitTermination()


def _saved(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """Rows of the arrivals before a number; None if there are none yet."""
    try:
        return spark.read.option("basePath", folder).parquet(folder).where(F.col(ARRIVAL) < before)
    except AnalysisException as error:
        if path_missing(error) or error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def arrival_writer(out_dir: str, vectors_dir: str, prepare: Callable[[DataFrame], DataFrame], encoder: Encoder,
                   text: str = "embedding_text", vector: str = "text_embedding",
                   partition_by: str | None = "category") -> Callable[[DataFrame, int], None]:
    """What is done with the rows of one arrival, given with its number.

    Texts without a vector yet are encoded and kept below `vectors_dir`; the
    rows with their vectors go below `out_dir`. Both are written to the
    arrival's own folder, which a replay replaces, and only vectors of earlier
    arrivals count as known: so a replay changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(prepare(batch), "arrival")
        texts = rows.select(text).where(F.col(text).isNotNull()).distinct()
        known = _saved(spark, vectors_dir, number)
        if known is not None:
            known = known.select(text, vector)
            texts = texts.join(known, [text], "left_anti")
        own = f"{vectors_dir}/{ARRIVAL}={number}"
        # spread, as texts that are new are few and dear
        texts = texts.repartition(row_partitions(texts), text)
        texts.select(text, encoder(F.col(text)).alias(vector)).write.mode("overwrite").parquet(own)
        fresh = spark.read.parquet(own).select(text, vector)
        vectors = fresh if known is None else known.unionByName(fresh)
        writer = rows.join(vectors, [text], "left").select(*rows.columns, vector).write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{out_dir}/{ARRIVAL}={number}")

    return write


def embed_arrivals(spark: SparkSession, src_dir: str, out_dir: str, vectors_dir: str, checkpoint: str,
                   prepare: Callable[[DataFrame], DataFrame], encoder: Encoder, schema: StructType,
                   max_files: int | None = None, **options) -> None:
    """Files not seen before, with the vectors of their texts; no text is encoded twice over all arrivals.

    `prepare` gives the rows their text; as an arrival is a table of its own,
    it may join and group, so texts can be worked out once each and with
    lemmas. The checkpoint numbers the arrivals, so it belongs to its two
    output folders; see `arrival_writer` for lost and repeated ones.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    write = arrival_writer(out_dir, vectors_dir, prepare, encoder, **options)
    (reader.parquet(src_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def skip_done(df: DataFrame, out_dir: str) -> DataFrame:
    """Rows of categories that have no output yet."""
    try:
        done = df.sparkSession.read.parquet(out_dir).select("category").distinct()
    except AnalysisException as error:
        if path_missing(error):
            return df
        raise
    return df.join(done, ["category"], "left_anti")
