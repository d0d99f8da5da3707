"""Files that executors write into the shared scratch folder themselves. Names are unique per task attempt and are
handed on in a table (the manifest). Reading starts from that table and opens the files it names, so what an attempt
that was lost has left in the folder, whole or cut off, is never opened."""

from __future__ import annotations

import os
from urllib.parse import urlparse
from urllib.request import url2pathname

from pyspark.sql import DataFrame

#: Tasks that read the files of a manifest, at most.
READERS = 100_000


def create(uri: str):
    """A binary file for writing at a URI; local ones by open(), others by the file systems that pyarrow knows."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = url2pathname(parts.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def content(uri: str) -> bytes:
    """All bytes of the file at a URI."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        with open(url2pathname(parts.path), "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def dealt(manifest: DataFrame, n_files: int) -> DataFrame:
    """The manifest with a task for each file, so that files are read side by side."""
    return manifest.repartition(max(1, min(n_files, READERS)))
