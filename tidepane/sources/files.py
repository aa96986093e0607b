"""Small files on the shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """A few operations on the shared file system, by whatever scheme its path has."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def write(self, path: str, text: str) -> None:
        """Make a new file; it appears complete or not at all."""
        fs, final = self._at(path)
        made = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(made)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if fs.exists(final) or not fs.rename(made, final):
            raise FileExistsError(path)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)
