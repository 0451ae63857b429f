"""Small files and folders in any file system that Spark's Hadoop clients reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file: the text goes to a neighbour first, and the old file is moved aside before it is deleted, so one of them is always whole; see recover()."""
        fs, p = self._at(path)
        new, old = (self.jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old"))
        stream = fs.create(new, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(old, False)
            if not fs.rename(p, old):
                raise OSError(f"can't move {path} aside")
        if not fs.rename(new, p):
            raise OSError(f"can't move {path}.new into place")
        fs.delete(old, False)

    def recover(self, path: str) -> None:
        """Ends a write() that was broken off: the new text was whole before the old file was moved aside."""
        fs, p = self._at(path)
        new, old = (self.jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old"))
        if not fs.exists(p) and fs.exists(old):
            fs.rename(new if fs.exists(new) else old, p)

    def size(self, path: str) -> int:
        """Bytes of all files below a path; 0 where there is none."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        if fs.exists(p):
            fs.delete(p, True)

    def copy(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, self.jvm.org.apache.hadoop.fs.Path(new), False, self.conf)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach: under spark.checkpoint.dir, or with a local master where that is unset a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
