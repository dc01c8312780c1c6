"""A store for ``counted://`` paths that Spark can't open; it notes every read beside the files."""

from __future__ import annotations

import io
import os

import pyarrow as pa
from pyarrow import fs


class _Noted(io.FileIO):
    def read(self, size: int = -1) -> bytes:
        at, got = self.tell(), super().read(size)
        with open(os.path.join(os.path.dirname(self.name), "reads.log"), "a") as log:
            log.write(f"{os.path.basename(self.name)} {at} {len(got)}\n")
        return got


class Counted(fs.FileSystemHandler):
    """Reading only."""

    def __init__(self) -> None:
        self.disk = fs.LocalFileSystem()

    def get_type_name(self):
        return "counted"

    def normalize_path(self, path):
        return path

    def get_file_info(self, paths):
        return self.disk.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.disk.get_file_info(selector)

    def open_input_file(self, path):
        return pa.PythonFile(_Noted(path), "r")

    open_input_stream = open_input_file

    def _refuse(self, *_):
        raise NotImplementedError

    create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_output_stream = open_append_stream = _refuse


def find(path: str) -> tuple[fs.FileSystem, str]:
    return fs.PyFileSystem(Counted()), path.removeprefix("counted://")


def reads(folder) -> list[tuple[str, int, int]]:
    """(file, at, bytes) of every read since the last call."""
    log = os.path.join(folder, "reads.log")
    if not os.path.exists(log):
        return []
    with open(log) as file:
        out = [(n, int(a), int(s)) for n, a, s in (line.rsplit(" ", 2) for line in file)]
    os.truncate(log, 0)
    return out
