"""Files of any store, read by ranges: a header or a band of rows costs its own bytes, wherever the file lies.

A store is what ``pyarrow.fs`` opens for a path's scheme. For a scheme that it doesn't know, ``store`` names
a function as ``module:function``, which gets the path and returns (file system, path in it); it is
imported by the tasks that read.
"""

from __future__ import annotations

import importlib
import io
import urllib.parse

import pyarrow as pa
from pyarrow import fs

#: Schemes that pyarrow opens by itself, without libraries of the machine.
KNOWN = ("file", "s3", "gs", "gcs", "abfs", "abfss")


def local(path: str) -> str:
    return urllib.parse.unquote(urllib.parse.urlparse(path).path) if path.startswith("file:") else path


def scheme(path: str) -> str:
    return urllib.parse.urlparse(path).scheme or "file"


def find(path: str, store: str | None = None) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if store:
        module, _, function = store.partition(":")
        return getattr(importlib.import_module(module), function)(path)
    if scheme(path) == "file":
        return fs.LocalFileSystem(), local(path)
    return fs.FileSystem.from_uri(path)


class _Raw(io.RawIOBase):
    """A file of a store as Python's own file objects are."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str, store: str | None = None, buffer: int = 16_384) -> io.BufferedReader:
    """A file to seek and read in; what is asked for is read ahead by ``buffer`` bytes at most."""
    system, name = find(path, store)
    return io.BufferedReader(_Raw(system.open_input_file(name)), buffer)


class Ranges:
    """Ranges of files; the file read last stays open, as the next range is mostly of the same one."""

    def __init__(self, store: str | None = None) -> None:
        self.store, self.path, self.file = store, None, None

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    def _open(self, path: str) -> None:
        if path != self.path:
            self.__exit__()
            system, name = find(path, self.store)
            self.path, self.file = path, system.open_input_file(name)

    def size(self, path: str) -> int:
        self._open(path)
        return self.file.size()

    def read(self, path: str, at: int, size: int) -> bytes:
        """``size`` bytes from ``at`` on; fewer at the file's end."""
        self._open(path)
        return self.file.read_at(size, at) if size > 0 else b""


def listed(path: str, endings: tuple[str, ...], store: str | None = None) -> list[tuple[str, object]]:
    """(path, modified) of the files below a path whose names end so; names only, nothing is read."""
    system, name = find(path, store)
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    head = path[: len(path) - len(name)] if path.endswith(name) else f"{scheme(path)}://"
    return [(head + f.path, f.mtime) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings)]
