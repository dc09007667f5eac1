"""Byte access to files in the shared folder from executors."""

from __future__ import annotations

import os
from urllib.parse import urlparse
from urllib.request import url2pathname


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return url2pathname(parsed.path) if parsed.scheme in ("", "file") else None


def write_whole(path: str, chunks) -> int:
    """Write under a temporary name and rename, so that a killed task leaves no half file of this name."""
    local, size = _local(path), 0
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local + ".partial", "wb") as f:
            for c in chunks:
                size += f.write(c)
        os.replace(local + ".partial", local)
        return size
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    with where.open_output_stream(name + ".partial") as f:
        for c in chunks:
            size += f.write(c)
    where.move(name + ".partial", name)
    return size


def open_bytes(path: str):
    """A file object with ``seek`` and ``read``."""
    local = _local(path)
    if local:
        return open(local, "rb")
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)
