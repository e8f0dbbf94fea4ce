"""Intermediate tables in the folder that driver and executors share; they cut lineage and survive lost executors. Small JSON files."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .errors import ConflictError, NotFoundError, StateError


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode, as in tests, and an error on a cluster, whose
    machines have no folder in common that could be guessed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StateError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _inside:
        _inside[-1].append(out)
    return out


#: What the open calls of `settled` have stored on their way.
_inside: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is stored inside is deleted at the end."""
    _inside.append([])
    try:
        yield
    finally:
        for df in _inside.pop():
            forget(df)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stores the table that `make` gives, and deletes what was stored to make it."""
    with scratch():
        out = stored(make(), name)
        _inside[-1] = [d for d in _inside[-1] if d is not out]
    if _inside:
        _inside[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes what `stored` wrote; nothing may read it afterwards."""
    if path := getattr(df, "_stored_at", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class JsonFiles:
    """Small JSON files and listings through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def write(self, path: str, data: Any) -> None:
        fs, p = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(data, indent=1, sort_keys=True, default=str).encode()))
        out.close()
        self._replace(fs, part, p)

    def _replace(self, fs, part, p) -> None:
        """One step where the file system has it, so that there is a whole file at every moment."""
        hadoop = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        try:
            hadoop.FileContext.getFileContext(p.toUri(), self.conf).rename(part, p, over)
        except Py4JJavaError:
            fs.delete(p, False)
            if not fs.rename(part, p):
                raise StateError(f"cannot write {p}") from None

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write_new(self, path: str, data: Any) -> None:
        """Writes a file that must not be there yet; of two writers one fails."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise ConflictError(path) from e
        out.write(bytearray(json.dumps(data, indent=1, sort_keys=True).encode()))
        out.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> Any:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise NotFoundError(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
