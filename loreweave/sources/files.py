"""Small files on whatever file system a path names, by the session's Hadoop configuration."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """Paths mean here what they mean to spark.read: a scheme names the file system, without one it is the default."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str | os.PathLike) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(str(path))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str | os.PathLike) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_file(self, path: str | os.PathLike) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def names(self, folder: str | os.PathLike) -> list[str]:
        """Names of what is directly in a folder, in order; none if there is no such folder."""
        fs, at = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def any_file(self, folder: str | os.PathLike, suffixes: tuple[str, ...]) -> bool:
        """Whether a file with one of these endings is anywhere under a folder."""
        fs, at = self._at(folder)
        if not fs.exists(at):
            return False
        found = fs.listFiles(at, True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(suffixes):
                return True
        return False

    def size(self, path: str | os.PathLike) -> int:
        """Bytes of a file, or of all files under a folder."""
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength()

    def age(self, path: str | os.PathLike, now: float) -> float:
        """Seconds since a path was last changed."""
        fs, at = self._at(path)
        return now - fs.getFileStatus(at).getModificationTime() / 1000

    def read(self, path: str | os.PathLike) -> str:
        fs, at = self._at(path)
        if not fs.exists(at):
            raise FileNotFoundError(str(path))
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str | os.PathLike, text: str) -> None:
        fs, at = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def create(self, path: str | os.PathLike, text: str) -> bool:
        """Writes a file that must not exist, whole and in one step; False if it does exist.

        The local file system links a finished file to its name, others rename it. Where renaming is no single step, as
        in some object stores, writers must take turns.
        """
        fs, at = self._at(path)
        draft = f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if fs.getScheme() == "file":
                source, target = (self.spark._jvm.org.apache.hadoop.fs.Path(str(p)).toUri().getPath() for p in (draft, path))
                try:
                    os.link(source, target)
                except FileExistsError:
                    return False
                return True
            return not fs.exists(at) and fs.rename(self._at(draft)[1], at)
        finally:
            self.remove(draft)

    def mkdirs(self, path: str | os.PathLike) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def remove(self, path: str | os.PathLike) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
