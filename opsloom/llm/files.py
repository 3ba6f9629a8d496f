"""Files on storage that every executor sees, opened from inside tasks by their URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_new(folder: str, suffix: str, data: bytes) -> str:
    """Write a file under a name of its own and return its URI.

    A task that is run twice leaves two files; only the one whose name its
    committed output row carries is ever read.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def read_all(uri: str) -> bytes:
    store, path = _at(uri)
    with store.open_input_stream(path, compression=None) as source:
        return source.read()
