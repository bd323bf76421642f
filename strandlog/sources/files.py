"""Files of any store that Spark's Hadoop layer reaches: local, HDFS, object stores."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting (tests) gets a temporary folder of its own; a cluster without it is
    refused, since executors there don't see each other's disks.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def bytes(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength()

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        a, fs = self._at(source)
        b, _ = self._at(target)
        if not fs.rename(a, b):
            raise OSError(f"can't move {source} to {target}")

    def copy(self, source: str, target: str) -> None:
        a, fs = self._at(source)
        b, there = self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, there, b, False, self.conf)

    def copy_all(self, pairs: list[tuple[str, str]], threads: int = 16) -> None:
        """Copies many files or folders, several at a time."""
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda p: self.copy(*p), pairs))

    def age_seconds(self, path: str, now_millis: int) -> float:
        p, fs = self._at(path)
        return (now_millis - fs.getFileStatus(p).getModificationTime()) / 1000

    def listing(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of every file below a folder."""
        p, fs = self._at(path)
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen()))
        return sorted(out)

    def sha256(self, path: str) -> str:
        """Digest of a file of any size, streamed."""
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name already."""
        p, fs = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:  # noqa: BLE001  the JVM's error tells by its class only
            if "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Puts a file in place of the one there in one step."""
        import uuid

        part = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(part, text)
        a, _ = self._at(part)
        b, _ = self._at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.conf) if a.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(a, b, options)
