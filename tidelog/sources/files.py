"""Files through Hadoop's FileSystem, so that a store may lie on any store Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A folder; names are relative to it."""

    def __init__(self, spark: SparkSession, base: str):
        jvm = spark._jvm
        self.base = base.rstrip("/")
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str):
        """An output stream to a new file; fails if there is one."""
        return self._fs.create(self._path(name), False)

    def publish(self, name: str, data: bytes) -> bool:
        """Write a file that appears whole or not at all; False if the name is taken."""
        import uuid

        temp = f".{uuid.uuid4().hex}"
        stream = self.create(temp)
        stream.write(bytearray(data))
        stream.hsync()
        stream.close()
        if self.exists(name) or not self._fs.rename(self._path(temp), self._path(name)):
            self.delete(temp)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
