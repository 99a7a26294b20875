"""Paths on local and remote file systems, for code in tasks that reads or writes parts of files."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    local = re.fullmatch(r"file:/*(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[fs.FileInfo]:
    """The files at a path: itself, or all below it, in the order of their names."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
