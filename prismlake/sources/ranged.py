"""Files of any store that Arrow opens (local paths, file:, hdfs:, s3:, gs:), listed, and read by ranges that are counted."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs

#: Bytes that the first read of a file takes: headers, level indices and most descriptors are in them.
HEAD = 4096


def store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what to put before such a path to name it again."""
    if not re.match(r"[a-z0-9+.-]+:", path):
        path = fs.LocalFileSystem().normalize_path(path)
        return fs.LocalFileSystem(), posixpath.abspath(path) if path.startswith("/") else path, ""
    system, inner = fs.FileSystem.from_uri(path)
    at = path.rfind(inner.rstrip("/"))
    return system, inner, path[:at] if at > 0 else ""


def listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, or of all files below a folder, by name."""
    system, inner, before = store(path)
    (info,) = system.get_file_info([inner])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((before + f.path, f.size) for f in found if f.type == fs.FileType.File)


class Ranged:
    """One file: ``r(at, n)`` gives a range (shorter at the end), ``r.taken`` the bytes fetched so far."""

    def __init__(self, path: str):
        system, inner, _ = store(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.taken = 0
        self.head = b""

    def __call__(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at + n <= min(HEAD, self.size):
            if not self.head:
                self.head = self._fetch(0, min(HEAD, self.size))
            return self.head[at : at + n]
        return self._fetch(at, n)

    def _fetch(self, at: int, n: int) -> bytes:
        self.taken += n
        return self.file.read_at(n, at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
