"""Small per-task helpers to reach a local or remote file system from a Python worker."""

from __future__ import annotations

import datetime
import errno
import os
from collections.abc import Iterator

from pyarrow import fs

EPOCH = datetime.datetime(1970, 1, 1)
# Folder errors that are expected and not reported.
SILENT_ERRORS = ("EACCES", "EPERM")


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _local(path: str) -> str:
    return path.removeprefix("file://")


def error_code(problem: OSError) -> str:
    return errno.errorcode.get(problem.errno, "OTHER") if problem.errno else "OTHER"


def _moment(seconds: float) -> datetime.datetime:
    return EPOCH + datetime.timedelta(microseconds=round(seconds * 1e6))


def entries(folder: str) -> Iterator[tuple]:
    """(path, is_dir, size, created, modified, error) of regular files and folders; links are left out.

    A file that goes or refuses to be looked at while it is listed comes with an error code and no values.
    """
    if is_remote(folder):
        system, root = fs.FileSystem.from_uri(folder)
        prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        for info in system.get_file_info(fs.FileSelector(root, recursive=False)):
            modified = info.mtime.replace(tzinfo=None) if info.mtime else None
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield prefix + info.path, info.type == fs.FileType.Directory, info.size or 0, modified, modified, None
        return
    with os.scandir(_local(folder)) as found:
        for entry in found:
            path = f"{folder.rstrip('/')}/{entry.name}"
            try:
                is_dir = entry.is_dir(follow_symlinks=False)
                if not is_dir and not entry.is_file(follow_symlinks=False):
                    continue
                stat = entry.stat(follow_symlinks=False)
            except OSError as problem:
                yield path, False, None, None, None, error_code(problem)
                continue
            created = getattr(stat, "st_birthtime", stat.st_mtime)
            yield path, is_dir, stat.st_size, _moment(created), _moment(stat.st_mtime), None


def create_file(path: str, content: bytes) -> None:
    """Write a file, making its folders."""
    folder = path.rsplit("/", 1)[0]
    if is_remote(path):
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as handle:
            handle.write(content)
        return
    os.makedirs(_local(folder), exist_ok=True)
    with open(_local(path), "wb") as handle:
        handle.write(content)


def open_file(path: str):
    """Readable, seekable binary handle."""
    if is_remote(path):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(_local(path), "rb")
