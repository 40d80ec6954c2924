"""File systems for binary files that tasks write and read themselves."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyarrow import fs

#: Spark's names of stores, and Arrow's names for the same.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "gs": "gs", "s3": "s3", "s3a": "s3",
           "s3n": "s3", "abfs": "abfss", "abfss": "abfss", "wasb": "abfss", "wasbs": "abfss"}


def known(uri: str) -> bool:
    return urlsplit(uri).scheme in SCHEMES


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or plain path."""
    parts = urlsplit(uri)
    scheme = SCHEMES.get(parts.scheme, parts.scheme)
    if scheme == "file":
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri.replace(f"{parts.scheme}://", f"{scheme}://", 1))
