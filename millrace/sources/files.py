"""Files and folders of whichever file system a path names, by Spark's own access to it."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, old: str, new: str) -> None:
        fs, at = self._at(old)
        if not fs.rename(at, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def replace(self, path: str, text: str) -> None:
        """A file's text, new or changed. Whoever dies on the way leaves the old text or ``path``.new, which ``current`` finds."""
        self.write(f"{path}.new", text)
        self.delete(path)
        self.rename(f"{path}.new", path)

    def current(self, path: str) -> str | None:
        """The text that ``replace`` wrote last, or None."""
        for at in (path, f"{path}.new"):
            if self.exists(at):
                return self.read(at)
        return None

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
