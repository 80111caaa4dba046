"""A listing of files as a Spark source.

Spark's file readers leave out files of length 0, so what exists is listed apart from what is read.
Each folder below the path is a partition that is listed by a task, the files beside them are one
more. A folder that cannot be listed gives a row with the reason instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self):
        """(file system, its path, what to put before paths of it)."""
        from pyarrow import fs

        uri = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        system, inside = fs.FileSystem.from_uri(uri)
        return system, inside.rstrip("/"), uri[:uri.index("://") + 3]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        try:
            system, inside, _ = self._open()
            below = system.get_file_info(fs.FileSelector(inside, recursive=False))
            folders = sorted(i.path for i in below if i.type == fs.FileType.Directory)
        except (OSError, ValueError):  # the task that lists it says why
            folders, inside = [], ""
        return [Folder(inside, False), *[Folder(f, True) for f in folders]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        try:
            system, inside, head = self._open()
            for info in system.get_file_info(fs.FileSelector(partition.path or inside, recursive=partition.deep)):
                if info.type == fs.FileType.File:
                    yield head + info.path, info.size, None
        except (OSError, ValueError) as problem:
            yield f"{(partition.path or self.path).rstrip('/')}/", None, str(problem)


class FolderListing(DataSource):
    """Files below `path`: uri, bytes; or a folder's uri and the error that hides it."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "uri string, bytes bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(path)
