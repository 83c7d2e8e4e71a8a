"""Binary files in the shared folder that the cluster names.

Tasks write files of their own; a table of the files that finished tasks have
written (the manifest) is what readers go by, so what a lost or repeated task
left behind is never read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from trendloom.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, as a URI or an absolute path."""
    folder = re.sub(r"^(\w+):/(?!/)", r"\1:///", scratch_path(spark, name))
    fs, path = locate(folder)
    fs.create_dir(path, recursive=True)
    return folder


def locate(uri: str):
    """File system and path of a URI, of any scheme that Arrow knows."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def new_file(folder: str, ending: str) -> str:
    """A name that no other task, nor another attempt of this one, has."""
    return f"{folder}/{uuid.uuid4().hex}{ending}"


def open_output(uri: str):
    fs, path = locate(uri)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)
