"""Small driver-side file operations on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Hadoop's FileSystem for one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.fs.exists(self.path(name)) else []

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0
