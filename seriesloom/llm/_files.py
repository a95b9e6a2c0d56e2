"""Files in the folder that driver and executors share."""

from __future__ import annotations

import os
import posixpath
import shutil
from urllib.parse import unquote, urlparse


def local(uri: str) -> str | None:
    """The path of a file: address or plain path, else None."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_once(uri: str, chunks) -> int:
    """Write byte chunks to uri by way of a new name, so that a reader never meets half a file; the length."""
    size = 0
    if (path := local(uri)) is not None:
        os.makedirs(posixpath.dirname(path), exist_ok=True)
        with open(f"{path}.writing", "wb") as f:
            for x in chunks:
                size += f.write(x)
        os.replace(f"{path}.writing", path)
        return size
    import pyarrow.fs

    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(f"{path}.writing") as f:
        for x in chunks:
            f.write(x)
            size += len(x)
    system.move(f"{path}.writing", path)
    return size


def open_seekable(uri: str):
    """A binary file that can seek."""
    if (path := local(uri)) is not None:
        return open(path, "rb")  # noqa: SIM115
    import pyarrow.fs

    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    """Remove a folder, if it is there."""
    if (path := local(uri)) is not None:
        shutil.rmtree(path, ignore_errors=True)
        return
    import pyarrow.fs

    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(path)
