"""Writing and reading single files from tasks, in any store that Arrow knows by URI."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyarrow import fs


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme is refused: to Spark it lies in the default store, to Arrow on a machine's own disk."""
    if not re.match(r"[a-z0-9+]+:", uri):
        raise ValueError(f"{uri} names no store; write file:///..., hdfs://... or s3a://...")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


@contextmanager
def committed(uri: str, attempt: int):
    """A stream to a file that appears under its name only when it is whole; a
    retried or doubled task writes the same bytes to a name of its own first, which goes if it fails."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.attempt-{attempt}"
    try:
        with store.open_output_stream(own) as out:
            yield out
    except BaseException:
        store.delete_file(own)
        raise
    store.move(own, path)


def reader(uri: str):
    store, path = _store(uri)
    return store.open_input_file(path)
