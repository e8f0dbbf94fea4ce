"""Files by address inside tasks, through Arrow's file systems: local paths, and whatever schemes they know (file, s3, gs, hdfs)."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse


@lru_cache(64)
def _opened(scheme: str, authority: str):
    from pyarrow import fs

    if scheme in ("", "file"):
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def place(uri: str) -> tuple[object, str]:
    """The file system and the path in it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file") or len(parts.scheme) == 1:
        from .images import local_path

        return _opened("", ""), local_path(uri)
    scheme = "s3" if parts.scheme in ("s3a", "s3n") else parts.scheme
    path = unquote(parts.path)
    return _opened(scheme, parts.netloc), path if scheme in ("hdfs", "viewfs") else parts.netloc + path


def read(uri: str) -> bytes:
    files, path = place(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def write(uri: str, data: bytes) -> None:
    """Through a name of its own, so that no part of a file is ever seen."""
    files, path = place(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, path)


def move(uri: str, to: str) -> None:
    files, path = place(uri)
    _, target = place(to)
    files.create_dir(os.path.dirname(target), recursive=True)
    files.move(path, target)
