"""Files that tasks write to, and read from, the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator:
    """An output stream that takes its name only when complete: a task that is run again replaces the file of a lost one."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(part) as out:
            yield out
    except BaseException:
        fs.delete_file(part)
        raise
    fs.move(part, path)
