"""The lake as a data source of Spark: `spark.read.format("lake")`, a stream, and a sink that commits whole books.

Options: path (a local path or any URI that Arrow's file systems reach), layout (time, book or batch), batch_size,
and books_per_task. Rows are (book_id, folder, header_path, body_path, header, body), one for each complete book,
of several copies the one in the folder that sorts last. Filters on book_id are pushed down: in the book and batch
layouts the folder follows from the id, so no other is listed or opened. Folders, in the time layout books, are
dealt to tasks; a task opens its own files only.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "book_id long, folder string, header_path string, body_path string, header string, body string"
_FILE = re.compile(r"([0-9]+)_(header|body)\.txt")
_FOLDERS = {"time": re.compile(r"\d{8}/\d{2}"), "book": re.compile(r"\d+"), "batch": re.compile(r"batch_\d+_\d+")}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LakeSource)


def open_root(path: str) -> tuple[fs.FileSystem, str]:
    found, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, root.rstrip("/")


def folder_of(layout: str, book_id: int, batch_size: int) -> str:
    low = book_id // batch_size * batch_size
    return str(book_id) if layout == "book" else f"batch_{low}_{low + batch_size - 1}"


@dataclass
class Part(InputPartition):
    """What one task reads: folders to look into, or books whose folders are known already."""

    folders: list[str]
    books: list[tuple[int, str]]


class Lake:
    """What reader, stream and sink know of a lake's place and layout."""

    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "time")
        if self.layout not in _FOLDERS:
            raise ValueError(f"no layout {self.layout}; known are {', '.join(_FOLDERS)}")
        self.batch_size = int(options.get("batch_size", "1000"))
        if self.batch_size < 1:
            raise ValueError(f"a batch holds at least one book, not {self.batch_size}")
        self.per_task = int(options.get("books_per_task", "256"))

    def names(self, system: fs.FileSystem, folder: str, kind: fs.FileType) -> list[fs.FileInfo]:
        return [x for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == kind]

    def folders(self, system: fs.FileSystem, root: str) -> list[str]:
        """Folders of the layout, relative to the root, in order."""
        found = [x.base_name for x in self.names(system, root, fs.FileType.Directory)]
        if self.layout == "time":
            found = [f"{day}/{x.base_name}" for day in found if re.fullmatch(r"\d{8}", day) for x in self.names(system, f"{root}/{day}", fs.FileType.Directory)]
        return sorted(f for f in found if _FOLDERS[self.layout].fullmatch(f))

    def pairs(self, system: fs.FileSystem, root: str, folder: str) -> dict[int, float]:
        """The complete books of a folder, and when the later of their two files was written."""
        seen: dict[int, dict[str, float]] = {}
        for x in self.names(system, f"{root}/{folder}", fs.FileType.File):
            if m := _FILE.fullmatch(x.base_name):
                seen.setdefault(int(m[1]), {})[m[2]] = x.mtime_ns or 0
        return {i: max(f.values()) for i, f in seen.items() if len(f) == 2 and (self.layout != "book" or folder == str(i))}

    def row(self, system: fs.FileSystem, root: str, folder: str, book_id: int) -> tuple:
        paths = [f"{root}/{folder}/{book_id}_{kind}.txt" for kind in ("header", "body")]
        texts = []
        for path in paths:
            with system.open_input_stream(path) as f:
                texts.append(f.read().decode("utf-8", "replace"))
        return (book_id, folder, *paths, *texts)

    def rows(self, part: Part, ids: set[int] | None) -> Iterator[tuple]:
        system, root = open_root(self.path)
        for folder in part.folders:
            for book_id in sorted(self.pairs(system, root, folder)):
                if ids is None or book_id in ids:
                    yield self.row(system, root, folder, book_id)
        for book_id, folder in part.books:
            yield self.row(system, root, folder, book_id)

    def dealt(self, items: list) -> list[list]:
        return [items[i : i + self.per_task] for i in range(0, len(items), self.per_task)]


class LakeReader(DataSourceReader):
    def __init__(self, lake: Lake):
        self.lake, self.ids = lake, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("book_id",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("book_id",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.ids = wanted if self.ids is None else self.ids & wanted

    def partitions(self) -> list[Part]:
        lake = self.lake
        system, root = open_root(lake.path)
        if lake.layout == "time":
            newest: dict[int, str] = {}
            for folder in lake.folders(system, root):
                newest |= dict.fromkeys(lake.pairs(system, root, folder), folder)
            books = sorted((i, f) for i, f in newest.items() if self.ids is None or i in self.ids)
            return [Part([], x) for x in lake.dealt(books)] or [Part([], [])]
        if self.ids is None:
            folders = lake.folders(system, root)
        else:
            folders = sorted({folder_of(lake.layout, i, lake.batch_size) for i in self.ids if i is not None})
        if lake.layout == "book":
            return [Part(x, []) for x in lake.dealt(folders)] or [Part([], [])]
        return [Part([f], []) for f in folders] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.lake.rows(partition, self.ids)


class LakeStream(DataSourceStreamReader):
    """New books, each when its second file has been there for SETTLE seconds. The offset is a point of time.

    A file that appears later with an older time of its own is not seen; movers have to touch it.
    """

    SETTLE = 1.0

    def __init__(self, lake: Lake):
        self.lake = lake

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.SETTLE * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, root = open_root(self.lake.path)
        books = [
            (i, folder)
            for folder in self.lake.folders(system, root)
            for i, at in self.lake.pairs(system, root, folder).items()
            if start["until"] < at <= end["until"]
        ]
        return [Part([], x) for x in self.lake.dealt(sorted(books, key=lambda b: (b[1], b[0])))] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.lake.rows(partition, None)


@dataclass
class Written(WriterCommitMessage):
    moves: str  # a task's list, a line a file: where it lies in the task's folder, and where it belongs below the root


class LakeWriter(DataSourceWriter):
    """Writes rows (book_id, header, body, source_url, downloaded_at). Tasks write into a staging folder of the job;
    the commit moves the files into place, a book's body last, so a reader that pairs files never sees half a book.
    Tasks list their files beside them and send the list's path only; the commit reads the lists line by line.
    A failed or repeated task leaves nothing that a reader sees."""

    def __init__(self, lake: Lake, schema: StructType):
        self.lake, self.columns, self.job = lake, schema.fieldNames(), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, root = open_root(self.lake.path)
        part, n = f"{root}/_staging/{self.job}/{uuid.uuid4().hex}", 0
        system.create_dir(part, recursive=True)
        moves = system.open_output_stream(f"{part}/moves")
        for row in iterator:
            book = dict(zip(self.columns, row, strict=True))
            i, at = book["book_id"], book["downloaded_at"]
            folder = f"{at:%Y%m%d}/{at:%H}" if self.lake.layout == "time" else folder_of(self.lake.layout, i, self.lake.batch_size)
            texts = {f"{i}_header.txt": book["header"] or "", f"{i}_body.txt": book["body"] or ""}
            if self.lake.layout == "book":
                side = {"book_id": i, "source_url": book["source_url"], "downloaded_at": f"{at:%Y-%m-%dT%H:%M:%S}"}
                texts = {"metadata.json": json.dumps(side, indent=2) + "\n"} | texts
            for name, text in texts.items():
                with system.open_output_stream(f"{part}/{n}") as out:
                    out.write(text.encode())
                moves.write(f"{n}\t{folder}/{name}\n".encode())
                n += 1
        moves.close()
        return Written(f"{part}/moves")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_root(self.lake.path)
        for message in filter(None, messages):
            with system.open_input_stream(message.moves) as source:
                for line in io.TextIOWrapper(source, "utf-8", newline="\n"):
                    staged, name = line.rstrip("\n").split("\t")
                    system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                    system.move(f"{posixpath.dirname(message.moves)}/{staged}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_root(self.lake.path)
        if system.get_file_info(f"{root}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging/{self.job}")


class LakeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lake"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LakeReader:
        return LakeReader(Lake(self.options))

    def streamReader(self, schema: StructType) -> LakeStream:  # noqa: N802
        return LakeStream(Lake(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LakeWriter:
        if overwrite:
            raise ValueError("books are added to a lake; use mode append")
        return LakeWriter(Lake(self.options), schema)
