"""Paths on any file system that pyarrow knows."""

from __future__ import annotations

import pyarrow.fs as pafs


def fs_of(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def paths_of(option: str) -> list[str]:
    """Comma-separated paths; a folder stands for its files in order of names."""
    out = []
    for path in filter(None, (p.strip() for p in option.split(","))):
        fs, at = fs_of(path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            prefix = path[: len(path) - len(at)] if "://" in path else ""
            found = fs.get_file_info(pafs.FileSelector(at))
            out += [prefix + f.path for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        elif info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        else:
            out.append(path)
    return out


def size_of(path: str) -> int:
    fs, at = fs_of(path)
    return fs.get_file_info(at).size
