"""Small files that say something has happened: complete once they are there, and never changed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Markers:
    """JSON files in one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def names(self, ending: str = ".json") -> list[str]:
        if not self._files.exists(self._folder):
            return []
        found = [status.getPath().getName() for status in self._files.listStatus(self._folder)]
        return sorted(name.removesuffix(ending) for name in found if name.endswith(ending))

    def get(self, name: str) -> dict | None:
        path = self._path(f"{name}.json")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Take a name; false if anyone has taken it before."""
        self._files.mkdirs(self._folder)
        return self._files.createNewFile(self._path(f"{name}.claim"))

    def put(self, name: str, content: dict) -> None:
        """Write a marker aside and give it its name in one step. Names are written once: claim them where writers may meet."""
        self._files.mkdirs(self._folder)
        fresh = self._path(f"{uuid.uuid4().hex}.tmp")
        out = self._files.create(fresh, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        if not self._files.rename(fresh, self._path(f"{name}.json")):
            raise OSError(f"marker {name} could not be written to {self.folder}")
