"""Files as pyarrow's file systems see them, for data sources whose readers and writers run in Python."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, length) of the files at or under ``path``, in order of path; hidden ones and other suffixes are left out."""
    files, at = located(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda f: not any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and shown(f))
