"""Small documents on any file system that Spark knows, through Hadoop's interface."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith("_")) if fs.exists(where) else []

    def size(self, path: str) -> int:
        """Bytes of the data files below a folder."""
        fs, where = self._at(path)
        return sum(s.getLen() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))

    def read(self, path: str):
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, path: str, value) -> None:
        """Write a new document; fails if there is one, so of two writers one wins."""
        fs, where = self._at(path)
        stream = fs.create(where, False)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()

    def replace(self, path: str, value) -> None:
        """Written aside, then renamed over what is there: a reader sees the old document or the new one."""
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.create(aside, value)
        old, new = (self.jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
        option = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = next(x for x in option.getEnumConstants() if x.name() == "OVERWRITE")
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.conf).rename(new, old, overwrite)

    def remove(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, True)
