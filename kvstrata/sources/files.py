"""Small files through the file systems that Spark's readers use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master (tests)."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kvstrata-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


class Files:
    """Operations on paths of any file system that the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def names(self, path: str) -> list[str]:
        """Sorted names in a directory; none where there is no such directory."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_directory(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str, temporary: str) -> bool:
        """Write a file by renaming a temporary one, which fails (False) where the path exists already."""
        fs, p = self._at(temporary)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(p, self._jvm.org.apache.hadoop.fs.Path(path), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(p, False)
            return False
        return True

    def rename(self, path: str, to: str) -> bool:
        """Move a file or directory; False where it isn't there or the target is."""
        fs, p = self._at(path)
        return not self.exists(to) and fs.exists(p) and fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(to))

    def age(self, path: str) -> float:
        """Seconds since a file or directory was last changed."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
