"""Archives as files: a sink for pieces of archives, written by all tasks at their places.

`df.write.format("zip_files").mode("append").save(path)` takes rows (archive, at, piece) as zip_sink.archive_pieces() makes
them. Each task writes its pieces into hidden files at their offsets; the same piece written twice, by a task that is run
again, is the same bytes at the same place. Committing gives the files their names, aborting takes them away, so a failed
job leaves no archive. path is a folder that driver and executors see as a file system.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "archive string, at long, piece binary"


def folder_of(path: str) -> str:
    """The folder of a plain path or of a file: address."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives are written into a mounted folder, not to {parts.scheme}:")
    return parts.path if parts.scheme else path


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


class ZipWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.folder = folder_of(path)
        self.hidden = os.path.join(self.folder, f".writing-{uuid.uuid4().hex}")
        os.makedirs(self.hidden)  # by the driver: a task that outlives an abort must not make it again

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: dict[str, int] = {}
        names: set[str] = set()
        try:
            for batch in iterator:
                for archive, at, piece in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "piece"))):
                    if archive not in files:
                        if len(files) >= 100:  # a task may have pieces of very many archives
                            os.close(files.pop(next(iter(files))))
                        names.add(archive)
                        files[archive] = os.open(os.path.join(self.hidden, f"{archive}.zip"), os.O_WRONLY | os.O_CREAT, 0o644)
                    done = 0
                    while done < len(piece):
                        done += os.pwrite(files[archive], piece[done:], at + done)
        finally:
            for f in files.values():
                os.close(f)
        return Written(sorted(names))

    def commit(self, messages: list[Written | None]) -> None:
        for name in {n for m in messages if m for n in m.archives}:
            os.replace(os.path.join(self.hidden, f"{name}.zip"), os.path.join(self.folder, f"{name}.zip"))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class ZipFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("archives are added to a folder: use mode append")
        return ZipWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipFiles)
