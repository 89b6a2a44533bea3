"""Files opened inside tasks, in the stores that pyarrow knows."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyarrow import fs

# Address schemes whose files a task can open by itself.
KNOWN = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def is_known(address: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", address)
    return scheme is None or scheme[1].lower() in KNOWN


def store(address: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the path in it."""
    if re.match(r"file:/", address):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/+", "/", address))
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", address):
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri(address)


def files_under(address: str) -> list[tuple[str, int]]:
    """(address, bytes) of the file, or of all files in the folder and below whose names do not begin with _ or a dot."""
    where, path = store(address)
    prefix = address[: len(address) - len(path)] if address.endswith(path) else ""
    if address.startswith("file:"):
        prefix = "file://"
    own = where.get_file_info(path)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(address)
    found = [own] if own.is_file else [f for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
    top = path.rstrip("/")
    hidden = lambda p: any(part[:1] in "_." for part in p[len(top) :].split("/") if part)
    return sorted((prefix + f.path, f.size) for f in found if own.is_file or not hidden(f.path))


def is_packed(address: str) -> bool:
    """Whether the file is compressed as a whole, so that it has no ranges."""
    return re.search(r"\.(gz|bz2|zst|lz4|snappy|br)$", address, re.I) is not None
