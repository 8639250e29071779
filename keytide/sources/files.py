"""File operations of the store through Hadoop's file system API, so that any store Spark can use will do."""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession

from keytide.model import InvalidArgument

#: Schemes of file systems that rename atomically and never onto what exists.
RENAMES = frozenset(["hdfs", "viewfs", "abfs", "abfss"])


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.path(name)).getLength()

    def age(self, name: str) -> float:
        """Seconds since a folder or a file in it was changed."""
        at = self.path(name)
        times = [self._fs.getFileStatus(at).getModificationTime(), *(x.getModificationTime() for x in self._fs.listStatus(at))]
        return time.time() - max(times) / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Publishes a file under a name that must be new; False if another writer took it.

        The content is written under another name first, so readers never see half of it. On a local disk a hard link
        claims the name; on file systems whose rename is atomic and does not overwrite, a rename. Others are refused, as
        two writers could both believe they had the name.
        """
        scheme = self._fs.getUri().getScheme()
        if scheme != "file" and scheme not in RENAMES:
            raise InvalidArgument(f"commits are not safe on {scheme}://")
        temporary = f"{name}.{os.getpid()}-{os.urandom(6).hex()}.tmp"
        out = self._fs.create(self.path(temporary), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        try:
            if scheme == "file":
                local = lambda x: self.path(x).toUri().getPath()
                try:
                    os.link(local(temporary), local(name))
                    return True
                except FileExistsError:
                    return False
            if self.exists(name):
                return False
            return bool(self._fs.rename(self.path(temporary), self.path(name)))
        finally:
            self._fs.delete(self.path(temporary), False)
