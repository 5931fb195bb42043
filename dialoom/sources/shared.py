"""Files of shared folders as tasks see them: by pyarrow's file systems, which know local paths, HDFS and object stores."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI; `file:/x`, as Spark writes it, is `/x`."""
    local = re.sub(r"^file:(?://)?", "", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def remove(path: str) -> None:
    """Removes a folder with what is in it, if it is there."""
    system, root = opened(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)


def listed(path: str) -> dict[str, int]:
    """Path and size of the files under a folder (or of one file); names that start with . or _ aren't data."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return {}
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = re.compile(r"(?:^|/)[._][^/]*")
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return {prefix + x.path: x.size for x in infos if x.type == fs.FileType.File and not hidden.search(x.path[len(root.rstrip("/")) :])}
