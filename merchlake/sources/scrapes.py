"""Folders of scrape results as a data source of its own: `spark.read.format("scrapes").load(folder)`, as a stream, and to write.

A row is a product as JSON text with its file, line and place, or an error with the file and line that it is about; so
nothing is lost and one bad file or line stops nothing. Files are listed once and dealt to partitions by their sizes. They
are opened by `pyarrow.fs` in the tasks, so the folder is a local (shared) path or a store that it knows.

Register it with `register(spark)`. Options: `path`, one folder or several with commas, of which the first that has a file of
some name is the one; `partitionBytes`, of files read by one task (a larger file is read by itself).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "file string, line int, pos int, product string, error string"
PARTITION_BYTES = 32 << 20
#: Names under which an object may have its list of products, in order
LISTS = ("products", "items", "data")


@dataclass
class Found:
    path: str
    name: str
    size: int
    changed: int


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def found_in(paths: str) -> list[Found]:
    """Files of all folders by name; reports of errors, and what is being written, are passed over."""
    out: dict[str, Found] = {}
    for folder in (p.strip() for p in paths.split(",")):
        system, root = _open(folder)
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and name.endswith((".json", ".jsonl")) and "errors" not in name.lower() and "/_" not in info.path.removeprefix(root):
                scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
                out.setdefault(name, Found(scheme + info.path, name, info.size, info.mtime_ns or 0))
    return [out[n] for n in sorted(out)]


def products_of(text: str, name: str) -> Iterator[tuple[int | None, int | None, str | None, str | None]]:
    """(line, pos, product, error) of one file: JSON lines, or one JSON value that is or has a list of products."""
    if name.endswith(".jsonl"):
        pos = 0
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    value = json.loads(line)
                except ValueError as e:
                    yield n, None, None, f"line {n}: {e}"
                    continue
                if isinstance(value, dict):
                    yield n, pos, json.dumps(value, ensure_ascii=False), None
                    pos += 1
                else:
                    yield n, None, None, f"line {n} is not an object"
        return
    if not text.strip():
        yield None, None, None, "empty"
        return
    try:
        root = json.loads(text)
    except ValueError as e:
        yield getattr(e, "lineno", None), None, None, str(e)
        return
    rows = root if isinstance(root, list) else None
    if isinstance(root, dict):
        rows = next((root[k] for k in LISTS if isinstance(root.get(k), list)), None)
        if rows is None:
            rows = next((v for v in root.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)), None)
    if rows is None:
        yield None, None, None, "no list of products"
        return
    for pos, product in enumerate(x for x in rows if isinstance(x, dict)):
        yield None, pos, json.dumps(product, ensure_ascii=False), None


@dataclass
class Files(InputPartition):
    files: list[Found]


def _dealt(files: list[Found], most: int) -> list[Files]:
    """Files in their order, together up to `most` bytes."""
    out: list[Files] = []
    room = 0
    for f in files:
        if not out or f.size > room:
            out.append(Files([]))
            room = most
        out[-1].files.append(f)
        room -= f.size
    return out


def _rows(part: Files) -> Iterator[tuple]:
    for f in part.files:
        system, path = _open(f.path)
        try:
            with system.open_input_file(path) as source:
                text = source.read().decode("utf-8", "replace")
        except OSError as e:
            yield f.name, None, None, None, f"cannot be read: {e}"
            continue
        for row in products_of(text, f.name):
            yield (f.name, *row)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return _dealt(found_in(self.paths), self.most) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Files in order of their last change; an offset is the time and path up to which they have been read."""

    def __init__(self, options: dict[str, str]):
        self.paths, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.changed, f.path) for f in found_in(self.paths)), default=(0, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = ((o["changed"], o["path"]) for o in (start, end))
        new = sorted((f for f in found_in(self.paths) if since < (f.changed, f.path) <= until), key=lambda f: (f.changed, f.path))
        return _dealt(new, self.most) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    rows: int


class _Writer(DataSourceWriter):
    """JSON lines, a file for each task that has rows. They become visible by renaming when all tasks are through."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.folder, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.names = schema.names

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = _open(self.folder)
        out, n, path = None, 0, f"{root}/_{self.run}/{uuid.uuid4().hex}.jsonl"
        for row in rows:
            if out is None:
                system.create_dir(f"{root}/_{self.run}", recursive=True)
                out = system.open_output_stream(path)
            value = {k: v for k, v in zip(self.names, row, strict=True) if v is not None}
            out.write((json.dumps(value, ensure_ascii=False, default=str) + "\n").encode())
            n += 1
        if out is not None:
            out.close()
        return _Written(path if n else None, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.folder)
        old = [f.path for f in found_in(self.folder)] if self.overwrite else []
        for n, m in enumerate(x for x in messages if x is not None and x.path):
            system.move(m.path, f"{root}/part-{self.run}-{n:05d}.jsonl")
        for path in old:
            system.delete_file(_open(path)[1])
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")


class Scrapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scrapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Scrapes)


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The products among `rows`, and their counters, which are there once the products have been used: no pass of its own."""
    seen = Observation()
    bad = F.col("error").isNotNull()
    out = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("errors"), F.count_if(bad & (F.col("error") == "empty")).alias("empty"), F.count_if(~bad).alias("products"))
    return out, seen
