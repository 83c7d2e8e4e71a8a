"""A data source that writes a file per row, all of them or none.

Tasks write beside the files that are there, in a folder of the run; once all
tasks have ended well, the commit moves each new file to its name. A run that
fails leaves what was there as it was. A task that still writes when its run
has been given up finds that folder gone; in a store without folders it may
leave a file there, in a hidden folder that nothing reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Characters that a file name must not hold, and those at its begin that would hide it from readers.
_UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]|^[._]""")


def file_name(name: str, ending: str = "") -> str:
    """The name with what a file name cannot hold percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", name) + ending


def located(path: str):
    """File system and path of a folder, given as a path or a URI."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    # Hadoop writes file:/x, Arrow wants file:///x
    return FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path)) if re.match(r"\w+:", path) else (LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: name and staged file of each row."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, ending: str) -> None:
        self.folder, self.ending = folder.rstrip("/"), ending
        self.staged = f"{self.folder}/.writing-{uuid.uuid4().hex}"

    def begin(self) -> NamedFilesWriter:
        fs, staged = located(self.staged)
        fs.create_dir(staged, recursive=True)
        return self

    def write(self, iterator: Iterator) -> Written:
        fs, staged = located(self.staged)
        files = []
        for name, value in iterator:
            if not name or value is None:
                raise ValueError(f"a name and a text are expected, not {name!r} and {value if value is None else '...'}")
            place = f"{staged}/{uuid.uuid4().hex}"
            with fs.open_output_stream(place, compression=None) as out:
                out.write(value.encode() + b"\n")
            files.append((name, place))
        return Written(files)

    def commit(self, messages: list) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        for (name, _), (following, _) in zip(files, files[1:]):
            if name == following:
                raise ValueError(f"one row per name is expected; there are more for {name!r}")
        fs, folder = located(self.folder)
        fs.create_dir(folder, recursive=True)
        for name, place in files:
            target = f"{folder}/{file_name(name, self.ending)}"
            try:
                fs.move(place, target)
            except OSError:  # a store that moves to new names only
                fs.delete_file(target)
                fs.move(place, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, staged = located(self.staged)
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


class NamedFiles(DataSource):
    """Columns: name, text. Options: path, and ending (such as `.json`)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if schema.fieldNames() != ["name", "value"]:
            raise ValueError(f"the columns name and value are expected, not {schema.fieldNames()}")
        return NamedFilesWriter(self.options["path"], self.options.get("ending", "")).begin()


def write_named_files(df: DataFrame, folder: str, ending: str = "") -> None:
    """Write each row (name, value) as a file of its own; files of other names stay."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.write.format("named_files").mode("append").option("path", folder).option("ending", ending).save()
