"""Shared-folder tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()
BATCH_BYTES, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application, so that they need no path of the driver's. Arrow batches are bounded in
    bytes, unless the session says how, since texts have any length."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_BYTES, str(ARROW_BYTES))
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it runs from an archive that was shipped already
        folder = tempfile.mkdtemp(prefix="lodestack-code-")  # the driver serves it to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "lodestack.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("lodestack", os.path.relpath(full, package)))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs in one process, else a RuntimeError."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(cleanup)
    _folders.append((spark, path))
    return path


class Files:
    """Small files and folders on any file system that Spark can reach, from the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def age(self, path: str) -> float:
        """Seconds since the path was last changed."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file; readers see the old text or the new one."""
        fs, temp = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._context(path).rename(temp, self.jvm.org.apache.hadoop.fs.Path(path), self._option("OVERWRITE"))

    def write_new(self, path: str, text: str) -> bool:
        """Make a file with this text at once, or nothing and False if the path exists."""
        fs, temp = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        local = fs.getUri().getScheme() == "file"
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if local:  # where renaming replaces, linking doesn't
                os.link(temp.toUri().getPath(), self.jvm.org.apache.hadoop.fs.Path(path).toUri().getPath())
            else:
                self._context(path).rename(temp, self.jvm.org.apache.hadoop.fs.Path(path), self._option("NONE"))
            return True
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(temp, False)

    def _context(self, path: str):
        return self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(path)[0].getUri(), self.conf)

    def _option(self, name: str):
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename, 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, name))
        return options

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def remove(spark: SparkSession, path: str) -> None:
    Files(spark).delete(path)


def cleanup() -> None:
    """Remove every table that materialize() wrote in this process."""
    while _folders:
        spark, path = _folders.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone when the process ends
            pass


_kept: set[str] = set()


@contextmanager
def scratch():
    """Tables that materialize() writes inside go at the end, but for those written with ``keep``: for what only those are computed from."""
    before = {path for _, path in _folders}
    try:
        yield
    finally:
        for spark, path in [x for x in _folders if x[1] not in before and x[1] not in _kept]:
            _folders.remove((spark, path))
            remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df once below the shared folder and read it back: computed once, and safe against lost executors. ``keep``: beyond scratch()."""
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, name)
    if keep:
        _kept.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
