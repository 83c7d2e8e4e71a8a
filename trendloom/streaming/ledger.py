"""States of submitted batches while ledger lines and status messages arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

from trendloom.functions import vocabulary as voc
from trendloom.operators.requests import classify_status
from trendloom.sources.readers import path_missing
from trendloom.streaming.incremental import ARRIVAL

#: One message: a ledger line names the file of its batch, a status message has none.
NEWS = StructType([
    StructField("id", StringType()), StructField("jsonl_file", StringType()), StructField("status", StringType()),
    StructField("at", TimestampType())])

#: Groups that the ids are hashed to. A state is found by its group, so a checkpoint holds for this number only.
BUCKETS = 1 << 13

# places of the arrays are the batches of a bucket
_BUCKET = StructType([
    StructField("id", ArrayType(StringType())), StructField("jsonl_file", ArrayType(StringType())),
    StructField("status", ArrayType(StringType())), StructField("at", ArrayType(LongType())),
    StructField("ended", ArrayType(BooleanType())), StructField("overdue", ArrayType(BooleanType())),
    StructField("timer", LongType())])

_CHANGE = StructType([
    StructField("id", StringType()), StructField("jsonl_file", StringType()), StructField("status", StringType()),
    StructField("at", LongType()), StructField("overdue", BooleanType())])

_TOLD = ("id", "jsonl_file", "status", "at", "ended")

# states in RocksDB; no batches without messages, as timers by the clock would go on asking for them
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def ledger_news(ledger: DataFrame, at: Column) -> DataFrame:
    """Messages of ledger lines, as heard at a time."""
    return ledger.select(F.col("batch.id").alias("id"), "jsonl_file", F.col("batch.status").alias("status"), at.alias("at"))


def status_news(status: DataFrame, at: Column) -> DataFrame:
    """Messages of `status(id, status)`, as heard at a time."""
    return status.select("id", F.lit(None).cast("string").alias("jsonl_file"), "status", at.alias("at"))


def _last(news: pd.DataFrame) -> pd.DataFrame:
    """The last message of each id and its greatest file; files are not compared group by group, which pandas does slowly."""
    files = news.dropna(subset=["jsonl_file"]).sort_values("jsonl_file").drop_duplicates("id", keep="last")
    last = news.sort_values(["at", "ended", "status"]).drop_duplicates("id", keep="last")
    named = last["id"].map(files.set_index("id")["jsonl_file"]).astype(object)
    return last.assign(jsonl_file=named.where(named.notna(), None))


def _last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`_last` of each Arrow batch: so little of a busy id is shuffled."""
    for batch in batches:
        yield _last(batch)


class _LastStatus(StatefulProcessor):
    """Keeps the last status of the batches of a bucket, and a timer for the first of them that is to be overdue.

    A bucket is read and written as a whole: a call per batch would ask the
    state store several times for each.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _BUCKET)

    def _load(self) -> tuple[dict, int | None]:
        """{id: (file, status, at, ended, overdue)}, and the time of the timer."""
        kept = self.bucket.get()
        if kept is None:
            return {}, None
        ids, *columns, timer = kept
        return dict(zip(ids, zip(*columns, strict=True), strict=True)), timer

    def _keep(self, batches: dict, timer: int | None, now: int) -> list[tuple]:
        """Save the batches and the next timer; returns the changes to overdue. `timer` is the one still set."""
        late, wanted = [], None
        for id, (file, status, at, ended, overdue) in batches.items():
            if ended or overdue or file is None:
                continue
            due = at + self.patience_ms
            if due <= now:
                late.append((id, file, status, at, True))
            elif wanted is None or due < wanted:
                wanted = due
        for id, file, status, at, _ in late:
            batches[id] = (file, status, at, False, True)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.bucket.update((list(batches), *map(list, zip(*batches.values(), strict=True)), wanted))
        return late

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches, timer = self._load()
        changed = set()
        for news in rows:
            for id, file, status, at, ended in zip(*(news[n].tolist() for n in _TOLD), strict=True):
                old = batches.get(id)
                new = (file, status, at, ended, False)
                if old is not None:
                    if (old[2], old[3], old[1]) >= (at, ended, status):
                        new = (file, *old[1:4], False)
                    if file is None or (old[0] is not None and old[0] > file):
                        new = (old[0], *new[1:])
                    if new[:3] == old[:3]:
                        continue
                batches[id] = new
                changed.add(id)
        if not changed:
            return
        told = [(id, *batches[id][:3], False) for id in changed if batches[id][0] is not None]
        late = self._keep(batches, timer, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(told + late, columns=_CHANGE.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late = self._keep(self._load()[0], None, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(late, columns=_CHANGE.names)

    def close(self) -> None:
        pass


def state_changes(news: DataFrame, patience: timedelta) -> DataFrame:
    """Changes (id, jsonl_file, status, at, overdue) of a stream of `NEWS`, `at` in milliseconds.

    The latest message of a batch counts, in whatever order they come; at the
    same time one that ends it goes first, then the later name. A batch whose
    ledger line has not come yet is remembered and not given out. One that has
    not ended within `patience` of its last message is given out once more as
    overdue, when the clock has passed that time and an arrival is worked on.
    Messages without id, status or time say nothing and are passed over. The
    state holds every batch, by buckets of its id, and no message is too late
    for it. An arrival reads and writes the buckets it has messages for.
    """
    told = news.where("id IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL").select(
        "id", "jsonl_file", "status", F.unix_millis("at").alias("at"),
        F.col("status").isin([*voc.BATCH_DONE, *voc.BATCH_ENDED]).alias("ended"))
    last = told.mapInPandas(_last_of_each, told.schema)
    buckets = last.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    return buckets.groupBy("bucket").transformWithStateInPandas(
        _LastStatus(int(patience.total_seconds() * 1000)), _CHANGE, "Update", "ProcessingTime")


def track_batches(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, patience: timedelta,
                  max_files: int | None = None) -> None:
    """Work the message files not seen before into the states, and write what changed.

    The changes of an arrival are a folder of their own, which a replay
    replaces. The checkpoint holds the states and numbers the arrivals, so it
    belongs to its output folder.
    """
    reader = spark.readStream.schema(NEWS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    changes = state_changes(reader.parquet(src_dir), patience)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/{ARRIVAL}={number}")

    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    # a stream takes the settings of its session as they are when it starts
    try:
        for name, value in _SETTINGS.items():
            spark.conf.set(name, value)
        stream = (changes.writeStream.outputMode("update").foreachBatch(write)
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        stream.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def tracked_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """(jsonl_file, id, status, state, overdue) of each batch, as its last change has it."""
    try:
        changes = spark.read.schema(StructType([*_CHANGE.fields, StructField(ARRIVAL, LongType())])).parquet(out_dir)
    except AnalysisException as error:
        if not path_missing(error):
            raise
        changes = spark.createDataFrame([], StructType([*_CHANGE.fields, StructField(ARRIVAL, LongType())]))
    order = F.struct(ARRIVAL, "overdue")
    last = changes.groupBy("id").agg(F.max_by(F.struct("jsonl_file", "status", "overdue"), order).alias("last"))
    return last.select("last.jsonl_file", "id", "last.status", classify_status("last.status").alias("state"), "last.overdue")
