"""Small text files on whatever file system a path names, replaced atomically."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._gateway = spark.sparkContext._gateway
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = str(root).rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it does not exist."""
        path = self._path(name)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def write(self, name: str, text: str, replace: bool = True) -> None:
        """Write beside the target and rename over it in one step, so a reader sees the old text or the new one.

        With ``replace`` off an existing target is an error: of two writers one fails.
        """
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = self._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            array = self._gateway.new_array(how, 1)
            array[0] = how.OVERWRITE if replace else how.NONE
            context.rename(self._fs.makeQualified(self._path(beside)), self._fs.makeQualified(self._path(name)), array)
        except Exception:
            self._fs.delete(self._path(beside), False)
            raise
