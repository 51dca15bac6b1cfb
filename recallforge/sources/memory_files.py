"""Spark data source ``memory_files``: records of JSON memory files, a partition a file, parsed as a stream.

``spark.read.format("memory_files").load(folder)`` after ``register(spark)``; options ``suffix`` (default .json) and ``chunk`` (bytes read at a time). A file holds ``{"memories": [...]}`` or a bare list;
one record is in memory at a time, however large the bank. A file that is cut off or no such JSON counts as empty and has one row that says so.
Paths are read by pyarrow's file systems (local, S3, GCS, HDFS) on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "bank string, window string, depth int, file string, at int, record string, corrupt boolean"
_SPACE = re.compile(r"[ \t\r\n]*")


class Corrupt(ValueError):
    """Not the JSON of a memory file."""


class _Scanner:
    """A JSON text read in pieces; what has been passed is dropped."""

    def __init__(self, read: Callable[[int], bytes], chunk: int = 1 << 16):
        self.read, self.chunk, self.text, self.at, self.over, self.rest = read, chunk, "", 0, False, b""
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        """Read on, twice as much as is left unread, so a long value is tried few times."""
        if self.over:
            return False
        data = self.read(max(self.chunk, 2 * (len(self.text) - self.at)))
        self.over = not data
        whole = self.rest + data
        cut = len(whole)
        while not self.over and cut and (whole[cut - 1] & 0xC0) == 0x80 and len(whole) - cut < 4:
            cut -= 1  # tails of a character
        if not self.over and cut and whole[cut - 1] >= 0xC0:
            cut -= 1  # and its head: it is kept for the next piece
        elif not self.over:
            cut = len(whole)
        try:
            self.text = self.text[self.at :] + whole[:cut].decode()
        except UnicodeDecodeError as e:
            raise Corrupt(str(e)) from e
        self.rest, self.at = whole[cut:], 0
        return not self.over

    def peek(self) -> str:
        """The next character that is no blank, "" at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> str:
        c = self.peek()
        if not c or c not in wanted:
            raise Corrupt(f"{c!r} in place of one of {wanted!r}")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                got, end = self.decoder.raw_decode(self.text, self.at)
            except ValueError as e:
                if self.more():
                    continue
                raise Corrupt(str(e)) from e
            if end < len(self.text) or not self.more():  # a number may go on
                self.at = end if end <= len(self.text) else self.at
                return got

    def items(self) -> Iterator:
        """Values of the list that begins here."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return


def records(read: Callable[[int], bytes], chunk: int = 1 << 16) -> Iterator[dict]:
    """Objects of a bare list or of the list ``memories`` of an object; other values in it are passed over. Raises ``Corrupt`` where the text ends early or is no such JSON."""
    s = _Scanner(read, chunk)
    if s.peek() == "[":
        yield from (x for x in s.items() if isinstance(x, dict))
    else:
        s.take("{")
        if s.peek() == "}":
            s.at += 1
        else:
            while True:
                name = s.value()
                s.take(":")
                if name == "memories" and s.peek() == "[":
                    yield from (x for x in s.items() if isinstance(x, dict))
                else:
                    s.value()
                if s.take(",}") == "}":
                    break
    if s.peek():
        raise Corrupt("text after the end")


class _File(InputPartition):
    def __init__(self, path: str, parts: tuple[str, ...]):
        self.path, self.parts = path, parts


class MemoryFilesReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, suffix: str):
        self.path, self.chunk, self.suffix = path, chunk, suffix

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        below = [(f.path, tuple(f.path[len(root.rstrip("/")) + 1 :].split("/"))) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        return [_File(p, parts) for p, parts in sorted(below) if len(parts) in (2, 3)]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        bank, *rest = partition.parts
        head = (bank, rest[0] if len(rest) == 2 else "all_memories", len(partition.parts), partition.path)
        try:
            with store.open_input_stream(partition.path) as f:  # a first pass, so that nothing of a file that breaks off is given
                for _ in records(f.read, self.chunk):
                    pass
        except Corrupt:
            yield (*head, None, None, True)
            return
        with store.open_input_stream(partition.path) as f:
            for at, r in enumerate(records(f.read, self.chunk)):
                yield (*head, at, json.dumps(r, ensure_ascii=False), False)


class MemoryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "memory_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemoryFilesReader:
        path = self.options["path"]
        return MemoryFilesReader(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1), int(self.options.get("chunk", 1 << 16)), self.options.get("suffix", ".json"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MemoryFiles)
