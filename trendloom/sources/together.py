"""Tables that readers see change together.

A run writes its tables into a folder of its own; one small file in the root
then names that folder. Readers go by the file, so they see all tables of a
run or all of the run before, never some of each. A run that fails names
nothing. Folders of earlier runs stay, as readers may still be at them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from trendloom.sources.named_files import write_named_files
from trendloom.sources.writers import write_table

#: The file that names the run, without its ending.
CURRENT = "current"

#: A table, or what makes it from the tables of the run written so far.
Table = DataFrame | Callable[[Mapping[str, DataFrame]], DataFrame]


def write_together(spark: SparkSession, tables: Mapping[str, Table], root: str) -> str:
    """Write `tables` (name to table) in order, then make them the current ones; gives the run's folder.

    A table may be a function: it gets the tables written before it, read back,
    so that it agrees with them whatever is not repeatable in their plans. Of
    two runs that end together the one that names itself last stays.
    """
    if not tables:
        raise ValueError("a run needs a table")
    root = root.rstrip("/")
    run = f"runs/{uuid.uuid4().hex}"
    written: dict[str, DataFrame] = {}
    for name, table in tables.items():
        rows = table(written) if callable(table) else table
        write_table(rows, f"{root}/{run}/{name}")
        written[name] = spark.read.schema(rows.schema).parquet(f"{root}/{run}/{name}")
    state = json.dumps({"run": run, "tables": list(tables)})
    write_named_files(spark.createDataFrame([(CURRENT, state)], "name string, value string"), root, ".json")
    return f"{root}/{run}"


def read_together(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the run that is current now, by name; none where no run has ended yet."""
    root = root.rstrip("/")
    try:
        state = spark.read.schema("run string, tables array<string>").json(f"{root}/{CURRENT}.json").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {name: spark.read.parquet(f"{root}/{state['run']}/{name}") for name in state["tables"]}
