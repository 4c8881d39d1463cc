"""Small files of catalogs, journals and locks on any store that Spark can open.

Tables are written by Spark itself; these helpers only move and read files of a
few kilobytes through the same file-system classes, so a catalog may lie on any shared store.

A text that readers follow (catalog, journal) is a series of numbered versions: a
new one is written beside and renamed to the next number, the highest number
counts, and only then older ones go, oldest first. Broken off at any step, a
reader finds the old text or the new one, never a part and never none.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


VERSION = re.compile(r"\.(.+)\.v(\d{12})")


def _version(name: str, number: int) -> str:
    return f".{name}.v{number:012d}"


class Store:
    """One root folder of a file system."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        spark = spark or SparkSession.builder.getOrCreate()
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name)) or (bool(name) and bool(self.versions(name)))

    def _all(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(""))) if self._fs.exists(self._path("")) else []

    def names(self) -> list[str]:
        """What lies in the root, a text of several versions once."""
        return sorted({m[1] if (m := VERSION.fullmatch(x)) else x for x in self._all()})

    def versions(self, name: str) -> list[int]:
        return sorted(int(m[2]) for x in self._all() if (m := VERSION.fullmatch(x)) and m[1] == name)

    def read(self, name: str, version: int | None = None) -> str:
        """A file's text; of a text with versions the newest one, or the one that a reader has pinned."""
        for last in (False, False, False, True):
            known = self.versions(name) if version is None else [version]
            try:
                return self._text(_version(name, known[-1]) if known else name)
            except Exception:  # two newer versions came between the look and the read: look again
                if last or version is not None or self.versions(name) == known:
                    raise
        raise AssertionError

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """The whole text; without ``overwrite`` an existing file is an error."""
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> int:
        """The next version of a text, which is returned; the one before stays for readers that hold it. Writers keep a lock (``publish.writer``)."""
        before = self.versions(name)
        fresh, number = f".new-{uuid.uuid4().hex}", (before[-1] if before else 0) + 1
        self.write(fresh, text)
        self.rename(fresh, _version(name, number))
        for old in before[:-1]:
            self._fs.delete(self._path(_version(name, old)), True)
        if self._fs.exists(self._path(name)):  # a text from before there were versions
            self._fs.delete(self._path(name), True)
        return number

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, name: str) -> None:
        """Remove a file or folder with all versions, the newest last."""
        for number in self.versions(name):
            self._fs.delete(self._path(_version(name, number)), True)
        self._fs.delete(self._path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Create a file that must not exist yet; false if another one was first."""
        try:
            self.write(name, text, overwrite=False)
        except Exception as e:  # the store's own error for an existing file
            if self.exists(name):
                return False
            raise e
        return True
