"""A Spark data source that writes text rows to one file for each name, on the executors, as a whole or not at all.

``rows.write.format("site_files").option("path", folder)`` takes rows of ``(file, text, part, item)``. Rows of a file have to
lie together and in order within a partition (see ``write_files``); each is written as it comes, so a file may be larger
than memory. Where ``item`` is true a comma goes before every row but the first of its ``part``. Each attempt of a task
writes to a staging folder of its own; the commit moves the files of the attempts that count into place, and a write that
fails removes them, so no half file is left.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: where each is staged, and its name."""

    files: list[tuple[str, str]]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SiteFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder.rstrip("/"), f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = _store(self.staging)
        own, out, last, files = posixpath.join(staging, uuid.uuid4().hex), None, None, []
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "text", "part", "item")]
                for name, text, part, item in zip(*columns, strict=True):
                    if out is None or name != last[0]:
                        if out is not None:
                            out.close()
                        store.create_dir(own, recursive=True)
                        files.append((posixpath.join(own, str(len(files))), name))
                        out, last = store.open_output_stream(files[-1][0]), (name, None)
                    if item and last[1] == part:
                        out.write(b",")
                    out.write((text or "").encode())
                    last = (name, part)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.folder)
        for staged, name in [x for m in messages if m is not None for x in m.files]:
            target = posixpath.join(folder, name)
            store.create_dir(posixpath.dirname(target), recursive=True)
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_file(target)
            store.move(staged, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class SiteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_files"

    def writer(self, schema, overwrite: bool) -> SiteFilesWriter:
        return SiteFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Write ``rows(file, part, text, item, ...)`` below folder; within a part by ``order``. A file of the same name is replaced."""
    rows.sparkSession.dataSource.register(SiteFiles)
    dealt = rows.repartition("file").sortWithinPartitions("file", "part", *order)
    dealt.select("file", F.col("text").cast("string").alias("text"), F.col("part").cast("int").alias("part"), F.col("item").cast("boolean").alias("item")).write.format("site_files").option("path", folder).mode("append").save()
