"""Files as streams for the readers that run in Python: local paths and every file system that pyarrow knows by URI."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: bytes a range of a UTF-16 file; even
RANGE = 64 << 20
STEP = 1 << 20
SCHEMA = "file string, split bigint, k bigint, byte bigint, text string"


def opened(path: str):
    """A seekable binary stream of a file."""
    url = urlparse(path)
    if url.scheme in ("", "file") or len(url.scheme) == 1:
        return open(unquote(url.path) if url.scheme == "file" else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, os.SEEK_END)


class Utf16Reader(DataSourceReader):
    """Aligned ranges of UTF-16 files. A range has the lines that begin in it; what it holds is one step and one line."""

    def __init__(self, paths: list[str], encoding: str) -> None:
        self.paths, self.big = paths, encoding == "utf16be"
        self.codec, self.end = ("utf-16-be", b"\0\n") if self.big else ("utf-16-le", b"\n\0")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, a)) for p in self.paths for a in range(0, max(size_of(p), 1), RANGE)]

    def _lines(self, f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """Lines that begin in a range, with their places. A line begins at 0 or behind a line end."""
        at = max(start - 2, 0)
        f.seek(at)
        held, base, skip, last = b"", at, start > 0, False
        while not last:
            data = f.read(STEP)
            last = not data
            held += data
            begin, look = 0, 0
            while (i := held.find(self.end, look)) >= 0:
                if i % 2:  # the held bytes begin at an even place
                    look = i + 1
                    continue
                if not skip:
                    yield base + begin, held[begin:i]
                skip = False
                begin = look = i + 2
                if base + begin >= stop:
                    return
            held, base = held[begin:], base + begin
        if held and not skip:
            yield base, held

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start = partition.value
        rows: list[tuple] = []
        with opened(path) as f:
            for k, (at, data) in enumerate(self._lines(f, start, start + RANGE), 1):
                text = data.decode(self.codec, "replace")
                rows.append((path, start, k, at, text.removesuffix("\r")))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "split", "k", "byte", "text"])


class Utf16Source(DataSource):
    """Format ``tidemark_utf16``; options ``paths`` (one a line) and ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_utf16"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Utf16Reader(self.options["paths"].split("\n"), self.options["encoding"])
