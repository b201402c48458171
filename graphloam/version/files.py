"""Small files of a repository, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so a reader sees the old or the new text."""
        fs, path = self._at(name)
        _, beside = self._at(name + ".new")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(beside, path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def list(self, name: str) -> list[str]:
        """Names of what lies directly in a folder."""
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def under(self, name: str) -> list[str]:
        """Files anywhere below a folder, relative to it."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return []
        found, todo = [], [(path, "")]
        while todo:
            folder, prefix = todo.pop()
            for s in fs.listStatus(folder):
                own = prefix + s.getPath().getName()
                todo.append((s.getPath(), own + "/")) if s.isDirectory() else found.append(own)
        return sorted(found)

    def json(self, name: str):
        return json.loads(self.read(name))

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1))
