"""Files in a storage prefix through Hadoop's file systems: any scheme that the cluster knows (file, s3a, sftp, ...)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import IntegrityError, NameConflictError, NotFoundError, UnsafePathError
from . import places


def safe_path(path: str) -> str:
    """A relative path with forward slashes that stays below its root."""
    p = path.replace("\\", "/")
    parts = p.split("/")
    if not p.strip() or p.startswith("/") or (len(p) > 1 and p[1] == ":") or any(x in ("", ".", "..") for x in parts) or "\0" in p:
        raise UnsafePathError(f"not a safe relative path: {path!r}")
    return p


@dataclass(frozen=True)
class Prefix:
    prefix_id: str
    name: str
    backend: str
    root: str
    credential_ref: str | None = None
    endpoint: str | None = None

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()


class Storage:
    """One prefix. Writes go through a temporary name; batches report errors item by item."""

    def __init__(self, spark: SparkSession, prefix: Prefix):
        self.spark, self.prefix = spark, prefix
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.prefix.root.rstrip('/')}/{safe_path(path)}")
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise NotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = False) -> str:
        fs, p = self._at(path)
        if fs.exists(p) and not overwrite:
            raise NameConflictError(path)
        _, part = self._at(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if overwrite:
            fs.delete(p, False)
        if not fs.rename(part, p):
            fs.delete(part, False)
            raise NameConflictError(path)
        return path

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        if not fs.delete(p, False):
            raise NotFoundError(path)

    def copy(self, source: str, target: str) -> None:
        self.write(target, self.read(source))

    def move(self, source: str, target: str) -> None:
        self.copy(source, target)
        self.delete(source)

    def batch(self, act: Callable[[str], object], paths: Iterable[str]) -> list[dict]:
        out = []
        for p in paths:
            try:
                out.append({"path": p, "ok": True, "result": act(p), "error": ""})
            except Exception as e:
                out.append({"path": p, "ok": False, "result": None, "error": f"{type(e).__name__}: {e}"})
        return out

    def managed_path(self, asset_id: str) -> str:
        digest = asset_id.removeprefix("sha256:")
        return f"managed/sha256/{digest[:2]}/{digest[2:4]}/{digest}"

    def write_managed(self, data: bytes) -> tuple[str, str]:
        """Stores bytes under their digest; the same bytes are stored once."""
        asset = "sha256:" + hashlib.sha256(data).hexdigest()
        path = self.managed_path(asset)
        if not self.exists(path):
            self.write(path, data)
        return asset, path

    def verify(self, asset_id: str, path: str) -> None:
        if "sha256:" + hashlib.sha256(self.read(path)).hexdigest() != asset_id:
            raise IntegrityError(path)


def unverified(rows: DataFrame, root: str) -> DataFrame:
    """The rows (asset_id, relative_path) whose file is missing or has other bytes. Tasks read the files that are named, and no others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bad = []
            for asset, path in zip(frame["asset_id"], frame["relative_path"], strict=True):
                try:
                    bad.append("sha256:" + hashlib.sha256(places.read(f"{root.rstrip('/')}/{path}")).hexdigest() != asset)
                except (OSError, ValueError):
                    bad.append(True)
            yield frame[bad]

    named = rows.select("asset_id", "relative_path")
    return named.mapInPandas(run, "asset_id string, relative_path string")
