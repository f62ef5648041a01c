"""Raw files are fetched into a folder by a data source that commits in two phases.

A task copies each of its files to ``<name>.part``, going on after the bytes that are there already, with
retries; what begins as its kind doesn't, or has another length or digest than it should, fails. Only when
all tasks are done are the parts renamed, so a job that fails shows no file, and the next one resumes.
Sources and target are addresses of any file system that Arrow opens (``file:``, ``s3:``, ``gs:``, ``hdfs:``);
the target is shared by driver and executors.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .readers import SIGNATURES

BLOCK = 4 << 20


def opened(address: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    if address.startswith("file:"):
        address = "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


@dataclass
class Fetched(WriterCommitMessage):
    """The names that a task has whole, as parts."""

    names: list[str]


class AcquiredFiles(DataSource):
    """Write (url, name, kind, size, sha256) rows; options ``path`` (the target), ``tries`` and ``wait``,
    the seconds before a second try, doubled for each more."""

    @classmethod
    def name(cls) -> str:
        return "acquired_files"

    def schema(self) -> str:
        return "url string, name string, kind string, size long, sha256 string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("tries", 3)), float(self.options.get("wait", 0.5)))


class _Writer(DataSourceWriter):
    def __init__(self, target: str, tries: int, wait: float) -> None:
        self.target, self.tries, self.wait = target.rstrip("/"), tries, wait

    def write(self, iterator: Iterator) -> Fetched:
        names = []
        for row in iterator:
            for left in reversed(range(self.tries)):
                try:
                    self.fetch(row)
                    break
                except OSError:
                    if not left:
                        raise
                    time.sleep(self.wait * 2 ** (self.tries - 1 - left))
            names.append(row.name)
        return Fetched(names)

    def fetch(self, row) -> None:
        """Bring the part of a row's file up to its source's end."""
        from pyarrow import fs

        if not row.name or "/" in row.name or row.name.startswith(".") or row.name.endswith(".part"):
            raise ValueError(f"no name for a file: {row.name!r}")
        source, at = opened(row.url)
        target, folder = opened(self.target)
        part = f"{folder}/{row.name}.part"
        target.create_dir(folder, recursive=True)
        size = source.get_file_info(at).size
        if size is None:
            raise FileNotFoundError(row.url)
        found = target.get_file_info(part)
        there = found.size if found.type == fs.FileType.File and found.size <= size else 0
        digest = hashlib.sha256()
        head = b""
        with source.open_input_file(at) as reader:
            if there:  # the bytes there must be the source's
                with target.open_input_stream(part) as old:
                    left = there
                    while left:
                        a, b = old.read(min(BLOCK, left)), reader.read(min(BLOCK, left))
                        if a != b or not a:
                            there, digest, head = 0, hashlib.sha256(), b""
                            break
                        digest.update(a)
                        head = head or a[:8]
                        left -= len(a)
                reader.seek(there)
            with target.open_append_stream(part) if there else target.open_output_stream(part) as writer:
                while data := reader.read(BLOCK):
                    writer.write(data)
                    digest.update(data)
                    head = head or data[:8]
        if row.kind and not head.hex().upper().startswith(SIGNATURES[row.kind]):
            target.delete_file(part)
            raise ValueError(f"{row.url} doesn't begin like {row.kind}")
        if row.size not in (None, size) or row.sha256 not in (None, digest.hexdigest()):
            target.delete_file(part)
            raise ValueError(f"{row.url} isn't the file that was asked for")

    def commit(self, messages: list) -> None:
        target, folder = opened(self.target)
        for message in messages:
            for name in message.names if message else ():
                target.move(f"{folder}/{name}.part", f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        """Parts stay, for the next job to go on from."""


def acquire(files: DataFrame, target: str, tries: int = 3, wait: float = 0.5) -> None:
    """Fetch each row's ``url`` to ``name`` in the folder ``target``; ``kind`` (see ``SIGNATURES``), ``size``
    and ``sha256`` may be missing or null. Names are distinct; a file that is there is replaced. A source
    that can't be read after ``tries`` fails the job."""
    from pyspark.sql import functions as F

    files.sparkSession.dataSource.register(AcquiredFiles)
    columns = [F.col(n).cast(t).alias(n) if n in files.columns else F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), ("name", "string"), ("kind", "string"), ("size", "long"), ("sha256", "string"))]
    files.select(*columns).write.format("acquired_files").mode("append").option("path", target).option("tries", tries).option("wait", wait).save()
