"""Folders that the driver and all executors share: scratch space, and versions that replace each other whole."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DONE = re.compile(r"^v-(\d+)\.done$")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark runs in one process, below a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base if ':' in base else f'file://{base}'}/{name}-{uuid.uuid4().hex}"


class Versions:
    """Versions of a data set below a path: a folder v-<n> each, and a file v-<n>.done that is made when it is complete.

    The greatest complete one counts, so a new version takes effect in one step, on file systems without a rename too. A
    writer that fails leaves a folder that doesn't count, and the next one takes a new number. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._at("")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def complete(self) -> list[int]:
        return sorted(int(m.group(1)) for m in map(DONE.match, self._names()) if m)

    def current(self) -> int | None:
        """The version that counts; None before the first."""
        return max(self.complete(), default=None)

    def folder(self, version: int) -> str:
        return f"{self.path}/v-{version}"

    def following(self) -> int:
        """A number above that of every folder, complete or not."""
        return max((int(n) for n in re.findall(r"v-(\d+)", " ".join(self._names()))), default=0) + 1

    def commit(self, version: int, note: str = "") -> None:
        """Marks a version complete. The mark holds the note, and is there with all of it or not at all."""
        fs, path = self._at(f"v-{version}.done")
        fs, part = self._at(f"v-{version}.part")
        out = fs.create(part, True)
        out.write(bytearray(note.encode("utf-8")))
        out.close()
        fs.delete(path, False)
        fs.rename(part, path)

    def note(self, version: int) -> str:
        fs, path = self._at(f"v-{version}.done")
        given = fs.open(path)
        try:
            return bytes(given.readAllBytes()).decode("utf-8")
        finally:
            given.close()

    def delete(self, version: int) -> None:
        """The mark first, so that a version in part never counts."""
        for name in (f"v-{version}.done", f"v-{version}"):
            fs, path = self._at(name)
            fs.delete(path, True)

    def prune(self) -> None:
        """Deletes all versions but the one that counts, those of failed writers included."""
        current = self.current()
        for n in sorted({int(n) for n in re.findall(r"v-(\d+)", " ".join(self._names()))} - {current}):
            self.delete(n)

    def drop(self) -> None:
        fs, path = self._at("")
        fs.delete(path, True)
