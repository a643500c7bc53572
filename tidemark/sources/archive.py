"""Logs inside archives: zip, tar (plain, gz, bz2, xz), gz, bz2, xz. A Spark data source reads one archive a task, as a stream.

Of several entries the likeliest log is taken: a preferred ending first, then the larger one, binaries never. An archive is
read twice, first for the names, sizes and heads of its entries; neither it nor an entry is ever held whole. 7z needs a
library that is not available and is refused with a clear error.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import opened
from .lines import CODECS, detect_encoding, is_binary

# Endings of likely logs and magic numbers.
ENDINGS = (".log", ".txt", ".out", ".err", ".json", ".csv", ".sql")
MAGIC = [(b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"7z\xbc\xaf\x27\x1c", "7z")]
NAMES = [(".tar.gz", "gz"), (".tgz", "gz"), (".tar.bz2", "bz2"), (".tbz2", "bz2"), (".tar.xz", "xz"), (".txz", "xz"), (".tar", "tar"), (".zip", "zip"), (".gz", "gz"), (".bz2", "bz2"), (".xz", "xz"), (".7z", "7z")]
_OPEN = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}
SCHEMA = "file string, entry string, line bigint, text string"


class ArchiveError(ValueError):
    """An archive that cannot be read."""


def kind_of(name: str, data: bytes) -> str | None:
    """Archive kind by name, else by magic number; None for a plain file."""
    low = name.lower()
    for ending, kind in NAMES:
        if low.endswith(ending):
            return kind
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    return "tar" if data[257:262] == b"ustar" else None


def rank(name: str, size: int) -> tuple:
    return (name.lower().endswith(ENDINGS), size, name)


def best_entry(entries: list[tuple[str, int, bool]], where: str) -> str:
    """Name of the likeliest log among (name, size, is it binary)."""
    texts = [(n, size) for n, size, binary in entries if not binary]
    if not texts:
        raise ArchiveError(f"{where}: the archive holds no text")
    return max(texts, key=lambda e: rank(*e))[0]


@contextmanager
def entry_stream(path: str, source=None):
    """Entry name and byte stream of the log in an archive (or of the file itself). ``source``: its bytes, if they are at hand."""
    opener = (lambda: io.BytesIO(source)) if source is not None else (lambda: opened(path))
    with ExitStack() as stack:
        try:
            f = stack.enter_context(opener())
            head = f.read(512)
            f.seek(0)
            kind = kind_of(path, head)
            base = path.rsplit("/", 1)[-1]
            if kind == "7z":
                raise ArchiveError("7z archives are not supported")
            if kind == "zip":
                yield _from_zip(f, path, stack)
                return
            packed = kind in _OPEN
            inner = stack.enter_context(_OPEN[kind](f)) if packed else f
            if packed:
                head = inner.read(512)
                inner = stack.enter_context(_OPEN[kind](stack.enter_context(opener())))
            if head[257:262] == b"ustar":
                again = stack.enter_context(opener())
                yield _from_tar(inner, stack.enter_context(_OPEN[kind](again)) if packed else again, path, stack)
                return
            yield (base.rsplit(".", 1)[0] if packed and "." in base else base), inner
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError) as e:
            raise ArchiveError(f"{path}: {e}") from None


def _from_zip(f, path: str, stack: ExitStack):
    z = stack.enter_context(zipfile.ZipFile(f))
    infos = [i for i in z.infolist() if not i.is_dir()]
    if any(i.flag_bits & 1 for i in infos):
        raise ArchiveError(f"{path}: the archive is encrypted")
    entries = []
    for i in infos:
        with z.open(i) as e:
            entries.append((i.filename, i.file_size, is_binary(e.read(8192))))
    name = best_entry(entries, path)
    return name, stack.enter_context(z.open(name))


def _from_tar(first, second, path: str, stack: ExitStack):
    """The entries of a tar, read as a stream; the chosen one from a second stream."""
    entries = []
    with tarfile.open(fileobj=first, mode="r|") as t:
        for m in t:
            if m.isfile():
                entries.append((m.name, m.size, is_binary(t.extractfile(m).read(8192))))
    name = best_entry(entries, path)
    t = stack.enter_context(tarfile.open(fileobj=second, mode="r|"))
    for m in t:
        if m.isfile() and m.name == name:
            return name, t.extractfile(m)
    raise ArchiveError(f"{path}: {name} is gone")


def unpack(name: str, data: bytes) -> tuple[str, bytes]:
    """Entry name and content of the log in an archive that is at hand as bytes."""
    with entry_stream(name, data) as (entry, f):
        return entry, f.read()


def stream_lines(f, encoding: str | None = None) -> Iterator[str]:
    """Lines of a byte stream, decoded piece by piece; the encoding is detected from its first 64 KiB unless given."""
    data = f.read(65536)
    key = encoding or detect_encoding(data)
    decoder = codecs.getincrementaldecoder(CODECS.get(key, key))("replace")
    held, first = "", True
    while data:
        held += decoder.decode(data)
        if first:
            held, first = held.removeprefix("\ufeff"), False
        *whole, held = held.split("\n")
        for x in whole:
            yield x.removesuffix("\r")
        data = f.read(1 << 20)
    held += decoder.decode(b"", True)
    if held:
        yield held.removesuffix("\r")


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with entry_stream(partition.value) as (entry, f):
            for i, t in enumerate(stream_lines(f), 1):
                yield partition.value, entry, i, t


class ArchiveSource(DataSource):
    """Format ``tidemark_archive``; option ``path``: one path or several, one a line."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader([p for p in self.options["path"].split("\n") if p])


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, entry, line, text`` of the log in each archive. Paths must be readable where the tasks run."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tidemark_archive").option("path", "\n".join(paths) if isinstance(paths, list) else paths).load()
