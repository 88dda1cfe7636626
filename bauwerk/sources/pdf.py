"""PDF files as a Spark data source: spark.read.format("bauwerk_pdf"), a row a file, with text, layout and images of one read."""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from shutil import which

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, source string, text string, text_error string, layout_xml string, images array<struct<src: string, content: binary>>, layout_error string"
_ARROW = pa.schema([
    ("doc_id", pa.string()), ("source", pa.string()), ("text", pa.string()), ("text_error", pa.string()), ("layout_xml", pa.string()),
    ("images", pa.list_(pa.struct([("src", pa.string()), ("content", pa.binary())]))), ("layout_error", pa.string()),
])

#: Files of a partition: the tools take a second or so a file, however few bytes it has.
FILES = 16


class ToolError(RuntimeError):
    """A file that a tool can't read, or a tool that isn't there."""


def _run(tool: str, *arguments: str) -> bytes:
    found = which(tool)
    if not found:
        raise ToolError(f"{tool} konnte nicht gestartet werden; bitte Poppler installieren")
    done = subprocess.run([found, *arguments], capture_output=True)
    if done.returncode:
        raise ToolError(f"{tool} ist fehlgeschlagen: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def pdf_text(file: Path) -> str:
    return _run("pdftotext", "-layout", str(file), "-").decode()


def pdf_layout(file: Path, folder: Path) -> tuple[str, list[tuple[str, bytes]]]:
    """Layout XML and the images beside it, which the tool writes to folder."""
    xml = folder / "layout.xml"
    _run("pdftohtml", "-xml", "-hidden", "-nodrm", "-enc", "UTF-8", str(file), str(xml))
    images = [(p.name, p.read_bytes()) for p in sorted(folder.iterdir()) if p.suffix.lower() in (".png", ".jpg", ".jpeg")]
    return xml.read_text().replace(f"{folder}/", ""), images


def read_file(name: str, content: bytes, layout: bool) -> pa.RecordBatch:
    """A file's row. What a tool can't do is told in the row; other files aren't touched."""
    row = dict.fromkeys(_ARROW.names) | {"doc_id": name, "source": name.rsplit("/", 1)[-1] or "input.pdf", "images": []}
    with tempfile.TemporaryDirectory() as made:
        folder = Path(made)
        file = folder / "input.pdf"
        file.write_bytes(content)
        try:
            row["text"] = pdf_text(file)
        except (ToolError, OSError, UnicodeDecodeError) as error:
            row["text_error"] = str(error)
        if layout:
            try:
                row["layout_xml"], images = pdf_layout(file, folder)
                row["images"] = [{"src": s, "content": c} for s, c in images]
            except (ToolError, OSError, UnicodeDecodeError) as error:
                row["layout_error"] = str(error)
    return pa.RecordBatch.from_pylist([row], _ARROW)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _listed(path: str) -> tuple[pafs.FileSystem, str, list[str]]:
    """(file system, what stands before its paths in a name, files) of a file, a folder or a pattern with * and ?."""
    scheme = re.match(r"[a-z][a-z0-9+.-]*:", path)
    if scheme and scheme[0] != "file:":
        system, plain = pafs.FileSystem.from_uri(path)
        before = path[: len(path) - len(plain)] if path.endswith(plain) else f"{scheme[0]}//"
    else:
        system, plain, before = pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path), "file:"
    if not re.search(r"[*?]", plain):
        if system.get_file_info(plain).type != pafs.FileType.Directory:
            return system, before, [plain]
        plain = f"{plain.rstrip('/')}/*.pdf"
    fixed = plain[: re.search(r"[*?]", plain).start()].rsplit("/", 1)[0] or "/"
    wanted = re.compile(re.escape(plain).replace(r"\*", "[^/]*").replace(r"\?", "[^/]"))
    selector = pafs.FileSelector(fixed, allow_not_found=True, recursive="/" in plain[len(fixed) + 1 :])
    return system, before, sorted(f.path for f in system.get_file_info(selector) if f.type == pafs.FileType.File and wanted.fullmatch(f.path))


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout, self.files = options["path"], options.get("layout", "true").lower() == "true", int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        """Only names are listed here; at least one partition, as an empty folder is an empty table."""
        _, _, paths = _listed(self.path)
        return [Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        scheme = re.match(r"[a-z][a-z0-9+.-]*:", self.path)
        local = not scheme or scheme[0] == "file:"
        system = pafs.LocalFileSystem() if local else pafs.FileSystem.from_uri(self.path)[0]
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield read_file(f"file:{path}" if local else f"{scheme[0]}//{path}", stream.read(), self.layout)


class PdfSource(DataSource):
    """Options: path, a file, folder or pattern; layout, whether layouts and images are read, true unless given; files, how many files
    a partition takes."""

    @classmethod
    def name(cls) -> str:
        return "bauwerk_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


def read(spark: SparkSession, path: str, layout: bool = True) -> DataFrame:
    """Rows of SCHEMA. Stores that only Spark's readers open are read by these, with partitions by bytes."""
    try:
        _listed(path)
    except (OSError, pa.ArrowInvalid, ValueError):
        files = spark.read.format("binaryFile").load(path).select("path", "content")

        def run(batches):
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield read_file(name, content.as_py(), layout)

        return files.mapInArrow(run, SCHEMA)
    spark.dataSource.register(PdfSource)
    return spark.read.format("bauwerk_pdf").option("layout", str(layout).lower()).load(path)
