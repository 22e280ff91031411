"""Small files and listings through Hadoop's file systems: whatever store Spark reads, the catalog reads."""

from __future__ import annotations

import json
import re
import threading
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_commits = threading.Lock()


@dataclass(frozen=True)
class DataFile:
    path: str
    size: int
    modified: int


    def partition(self, table: str) -> dict[str, str]:
        """The partition columns and values, as text, that the folders below ``table`` name."""
        folders = self.path[len(table) :].strip("/").split("/")[:-1]
        return {k: unquote(v) for k, v in (x.split("=", 1) for x in folders if "=" in x)}


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def qualified(self, path: str) -> str:
        p, fs = self._at(path)
        return fs.makeQualified(p).toString()

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)

    def read_json(self, path: str):
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, path: str, value) -> bool:
        """Writes ``value`` whole at ``path``, or nothing and false if another writer was there first.

        Where a store looks for the target before it renames, as a local disk does, the lock keeps one process's
        writers apart; stores of a cluster that rename in one step keep all apart.
        """
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        p, fs = self._at(temporary)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(value, default=str).encode()))
        finally:
            stream.close()
        target = fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            with _commits:
                context.rename(fs.makeQualified(p), target, options)
        except Py4JJavaError:
            fs.delete(p, False)
            if fs.exists(target):
                return False
            raise
        return True

    def names(self, path: str) -> dict[str, int]:
        """The names in a folder and when each was modified (milliseconds); none if it isn't there."""
        p, fs = self._at(path)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def size(self, path: str) -> int:
        """Bytes of all files below ``path``; 0 if there is none."""
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def data_files(self, table: str) -> list[DataFile]:
        """The Parquet files below ``table``, partitions included; names that begin with _ or . are no data.

        Spark lists them (in a job where folders are many), and one text brings them over.
        """
        if not self.exists(table):
            return []
        base = self.qualified(table).rstrip("/")
        location = self.spark.read.schema("nothing int").parquet(base)._jdf.queryExecution().analyzed().relation().location()
        listed = _STATUS.findall(location.allFiles().mkString("\n"))
        found = [DataFile(path, int(size), int(modified)) for path, size, modified in listed if path.endswith(".parquet")]
        return sorted(found, key=lambda x: x.path)


#: A file's path, length and time of modification in the text of Hadoop's FileStatus.
_STATUS = re.compile(r"Status\{path=(.+?); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")
