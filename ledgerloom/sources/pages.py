"""Page words from files: any extractor, behind a table of files or a Python data source, in batches and as a stream.

An extractor is an object with `count(data)`, the number of pages in a file's bytes, and `words(data, first, last)`, which
yields (page, page_width, x0, y0, x1, y1, text) for the words of pages first to last - 1. TextOperators reads
uncompressed page streams of text operators, as simple report writers make them, PlainText reports in letters of one width; others can wrap a
PDF library.

* `words` and `stream` read files through Spark's own binary source: any store that Spark reads, new files tracked by the
  checkpoint. A task holds one file at a time.
* The data source "pages" (register(spark)) reads what pyarrow's file systems reach, and splits large files into
  ranges of pages, so that one long document is extracted by several tasks.

A statement's id is made of its file's path: 43 bits of SHA-256. Two paths with one id would be two parts of
one statement, which ingest refuses and notes; nothing is mixed silently. A file that the extractor can't read has one row without
a page whose text says why: ingest finds it among the words that can't be read.
"""

from __future__ import annotations

import hashlib
import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import WORDS

SCHEMA = f"{WORDS}, source_path string"
NAMES = ["statement_id", "page", "page_width", "x0", "y0", "x1", "y1", "text", "source_path"]
KINDS = [pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.string(), pa.string()]
ID_BITS = 43


class Extractor(Protocol):
    def count(self, data: bytes) -> int: ...

    def words(self, data: bytes, first: int, last: int) -> Iterator[tuple]: ...


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_BOX = re.compile(rb"/MediaBox\s*\[\s*([\d.+-]+)\s+([\d.+-]+)\s+([\d.+-]+)\s+([\d.+-]+)\s*\]")
#: Tokens of a page stream: strings, arrays' brackets, numbers, names and operators.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|[\[\]]|[+-]?(?:\d+\.?\d*|\.\d+)|/[^\s/()\[\]]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


@dataclass(frozen=True)
class TextOperators:
    """Words of uncompressed page streams: BT, Tf, Tm, Td, TD, TL, T*, Tj, TJ, ' and ". Letters are as wide as `width` of their size."""

    width: float = 0.5

    def count(self, data: bytes) -> int:
        return sum(1 for _ in _STREAM.finditer(data))

    def words(self, data: bytes, first: int, last: int) -> Iterator[tuple]:
        box = _BOX.search(data)
        left, low, right, high = (float(x) for x in box.groups()) if box else (0.0, 0.0, 612.0, 792.0)
        for page, found in enumerate(_STREAM.finditer(data)):
            if first <= page < last:
                for x0, y0, x1, y1, text in self._page(found.group(1), high):
                    yield page, right - left, x0 - left, y0, x1 - left, y1, text

    def _page(self, stream: bytes, high: float) -> Iterator[tuple]:
        stack, size, leading, line, x, y = [], 10.0, 0.0, (0.0, 0.0), 0.0, 0.0
        for token in _TOKEN.findall(stream):
            if token[:1] in b"([]/" or token[-1:].isdigit() or token[-1:] == b".":
                stack.append(token)
                continue
            op, numbers = token.decode(), [float(t) for t in stack if t[:1] not in b"([]/"]
            if op == "BT":
                line = x, y = 0.0, 0.0
            elif op == "Tf" and numbers:
                size = numbers[-1]
            elif op == "TL" and numbers:
                leading = numbers[-1]
            elif op == "Tm" and len(numbers) >= 6:
                line = x, y = numbers[-2], numbers[-1]
            elif op in ("Td", "TD") and len(numbers) >= 2:
                leading = -numbers[-1] if op == "TD" else leading
                line = x, y = line[0] + numbers[-2], line[1] + numbers[-1]
            if op in ("T*", "'", '"'):
                line = x, y = line[0], line[1] - leading
            if op in ("Tj", "TJ", "'", '"'):
                letters = []  # (letter, where it begins)
                for part in stack:
                    if part[:1] == b"(":
                        for letter in re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), part[1:-1]).decode("latin-1"):
                            letters.append((letter, x))
                            x += self.width * size
                    elif op == "TJ" and part[:1] not in b"[]/":
                        x -= float(part) / 1000 * size
                        if letters and -float(part) / 1000 >= self.width / 2:
                            letters.append((" ", x))  # a gap of half a letter parts words
                yield from self._words(letters, x, high - y - size, high - y)
            stack.clear()

    def _words(self, letters: list[tuple[str, float]], end: float, y0: float, y1: float) -> Iterator[tuple]:
        text, begin = "", 0.0
        for letter, x in [*letters, (" ", end)]:
            if letter.isspace():
                if text:
                    yield begin, y0, x, y1, text
                text = ""
            else:
                text, begin = text + letter, begin if text else x


@dataclass(frozen=True)
class PlainText:
    """Words of UTF-8 reports in letters of one width: lines `height` apart, pages ended by form feeds."""

    width: float = 5.0
    height: float = 10.0
    page_width: float = 612.0

    def count(self, data: bytes) -> int:
        return data.count(b"\f") + 1 if data else 0

    def words(self, data: bytes, first: int, last: int) -> Iterator[tuple]:
        for page, part in enumerate(data.split(b"\f")[:last]):
            for line, text in enumerate(part.decode().split("\n") if page >= first else ()):
                for m in re.finditer(r"\S+", text):
                    yield page, self.page_width, m.start() * self.width, line * self.height, m.end() * self.width, (line + 1) * self.height, m.group()


def statement_id(path: str) -> int:
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> (64 - ID_BITS)


def rows_of(path: str, data: bytes, extractor: Extractor, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """A file's words, or one row without a page that says why there are none."""
    key = statement_id(path)
    try:
        last = extractor.count(data) if last is None else last
        for row in extractor.words(data, first, last):
            yield (key, *row, path)
    except (ValueError, LookupError, ArithmeticError) as problem:
        yield (key, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}", path)


def batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)


def extracted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """files (path, content), static or streaming, to their words."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from batches(rows_of(path.as_py(), data.as_py() or b"", extractor))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def words(spark: SparkSession, path: str | list[str], extractor: Extractor, pattern: str = "*.pdf") -> DataFrame:
    """The words of all files below a path, or of the files named."""
    return extracted(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), extractor)


def stream(spark: SparkSession, path: str, extractor: Extractor, pattern: str = "*.pdf", files: int = 1000) -> DataFrame:
    """The words of files as they arrive, `files` of them in a batch; for ingest.run_stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(path)
    return extracted(found, extractor)


@dataclass
class Pages(InputPartition):
    path: str
    first: int = 0
    last: int | None = None


class _Files:
    """What both readers of the data source share. Options: path, extractor ("module:name" of an object), pattern, pages (in a range), split (bytes from which a file is split)."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.pdf")
        module, name = options.get("extractor", f"{__name__}:DEFAULT").split(":")
        self.extractor: Extractor = getattr(importlib.import_module(module), name)
        self.pages, self.split = int(options.get("pages", "50")), int(options.get("split", str(16 << 20)))

    def _open(self, path: str) -> bytes:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with system.open_input_file(inner) as f:
            return f.read()

    def found(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) of all files, oldest first."""
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        some = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and fnmatch(f.base_name, self.pattern)]
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in some)

    def ranges(self, path: str, size: int) -> list[Pages]:
        if size < self.split:
            return [Pages(path)]
        n = self.extractor.count(self._open(path))
        return [Pages(path, a, min(a + self.pages, n)) for a in range(0, n, self.pages)] or [Pages(path)]

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without files Spark asks once for nothing
            return iter(())
        return batches(rows_of(partition.path, self._open(partition.path), self.extractor, partition.first, partition.last))


class PageReader(_Files, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return [p for _, path, size in self.found() for p in self.ranges(path, size)]


class PageStream(_Files, DataSourceStreamReader):
    """Files in order of their time; one must not come with an earlier time than files already read."""

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        found = self.found()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        inside = lambda t, p: (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])
        return [x for t, path, size in self.found() if inside(t, path) for x in self.ranges(path, size)]


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


DEFAULT, REPORTS = TextOperators(), PlainText()


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("pages") and spark.readStream.format("pages") known to the session."""
    spark.dataSource.register(PageSource)
