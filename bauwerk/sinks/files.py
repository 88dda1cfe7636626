"""Exports as files, one a document: df.write.format("bauwerk_files").

A task writes a document under a hidden name and then renames it, so under its own name a file is whole or not there. Names follow from
doc_id, so a task that runs again replaces its files. The commit leaves _SUCCESS; it and an abort remove hidden files that lost
tasks left.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_name(doc_id: str, suffix: str) -> str:
    """The last part of the id without its ending, and a digest of the whole id, as two folders may have files of one name."""
    stem = re.sub(r"\.[A-Za-z0-9]{1,5}\Z", "", doc_id.rstrip("/").rsplit("/", 1)[-1])
    plain = re.sub(r"[^\w .-]", "_", stem).strip(". ")[:80] or "document"
    return f"{plain}-{hashlib.sha256(doc_id.encode()).hexdigest()[:16]}.{suffix}"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.digits, self.job = options["path"], options.get("suffix", "xml"), int(options.get("folders", "0")), uuid.uuid4().hex

    def _system(self) -> tuple[pafs.FileSystem, str]:
        if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", self.path):
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._system()
        system.create_dir(folder)
        made, files, size = set(), 0, 0
        for batch in iterator:
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                data, name = content.as_py().encode(), file_name(doc_id.as_py(), self.suffix)
                place = folder
                if self.digits:
                    place = f"{folder}/{name.rsplit('-', 1)[-1][: self.digits]}"
                    if place not in made:
                        system.create_dir(place)
                        made.add(place)
                hidden = f"{place}/.{self.job}-{uuid.uuid4().hex}.tmp"
                try:
                    with system.open_output_stream(hidden) as out:
                        out.write(data)
                    system.move(hidden, f"{place}/{name}")
                except BaseException:
                    if system.get_file_info(hidden).type == pafs.FileType.File:
                        system.delete_file(hidden)
                    raise
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def _sweep(self) -> tuple[pafs.FileSystem, str]:
        system, folder = self._system()
        system.create_dir(folder)
        for f in system.get_file_info(pafs.FileSelector(folder, recursive=bool(self.digits))):
            if f.base_name.startswith(f".{self.job}-"):
                system.delete_file(f.path)
        return system, folder

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._sweep()
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()


class FileSink(DataSource):
    """Options: path, a folder in a store that pyarrow opens from every task; suffix, the files' ending; folders, by how many digits of the digest the files are dealt out to folders,
    for very many documents. Rows: doc_id string, content string."""

    @classmethod
    def name(cls) -> str:
        return "bauwerk_files"

    def schema(self) -> str:
        return "doc_id string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def write_documents(exported: DataFrame, path: str, suffix: str, folders: int = 0) -> None:
    """Every document of exported (doc_id, json or xml) to a file in path; those that are blocked, whose text is null, get none."""
    body = "json" if "json" in exported.columns else "xml"
    exported.sparkSession.dataSource.register(FileSink)
    rows = exported.where(F.col(body).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(body).alias("content"))
    rows.write.format("bauwerk_files").mode("append").option("suffix", suffix).option("folders", str(folders)).save(path)


def blocked(exported: DataFrame) -> DataFrame:
    """(doc_id, reason) of the documents that get no file."""
    if "blocked" not in exported.columns:
        return exported.select("doc_id", F.lit(None).cast("string").alias("reason")).where("false")
    return exported.where("blocked IS NOT NULL").select("doc_id", F.col("blocked").alias("reason"))
