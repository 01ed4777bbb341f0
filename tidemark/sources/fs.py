"""Small filesystem helpers used inside tasks and for driver-side root checks.

Plain paths are local (or a shared mount); ``scheme://`` URIs go through ``pyarrow.fs``
(S3, GCS, HDFS where pyarrow has the driver), so the same readers work on object stores.
"""

from __future__ import annotations

import os
import stat as _stat
from functools import lru_cache


def strip_file_scheme(path: str) -> str:
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def is_uri(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


@lru_cache(maxsize=64)
def _connected(scheme: str, authority: str):
    """One filesystem per scheme and authority (a connection each)."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def _arrow_fs(path: str):
    """(filesystem, path inside it, prefix that turns such a path into a URI again).  In HDFS the authority
    is a host, which the path inside does not repeat; in object stores it is the bucket, which it does."""
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    if scheme in ("hdfs", "viewfs"):
        return _connected(scheme, authority), "/" + inner, f"{scheme}://{authority}"
    return _connected(scheme, authority), f"{authority}/{inner}".rstrip("/"), f"{scheme}://"


def open_read(path: str):
    """Binary read handle."""
    if is_uri(path):
        fs, p, _ = _arrow_fs(path)
        return fs.open_input_stream(p)
    return open(strip_file_scheme(path), "rb")


def exists(path: str) -> bool:
    if is_uri(path):
        from pyarrow import fs as pafs

        fs, p, _ = _arrow_fs(path)
        return fs.get_file_info(p).type != pafs.FileType.NotFound
    return os.path.exists(strip_file_scheme(path))


def kind(path: str) -> str:
    """'missing', 'dir' or 'file'."""
    if is_uri(path):
        from pyarrow import fs as pafs

        fs, p, _ = _arrow_fs(path)
        t = fs.get_file_info(p).type
        return {pafs.FileType.NotFound: "missing", pafs.FileType.Directory: "dir"}.get(t, "file")
    p = strip_file_scheme(path)
    if not os.path.exists(p):
        return "missing"
    return "dir" if os.path.isdir(p) else "file"


def normalize(root: str) -> str:
    """A root as an absolute path without ``.`` and ``..`` (URIs only lose a closing slash), so that the
    same folder always gives the same paths."""
    if is_uri(root):
        return root.rstrip("/")
    return os.path.abspath(strip_file_scheme(root))


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def list_dir(path: str):
    """Entries of one directory, as they come: (path, is_dir, size, mtime_ms).  An ``OSError`` (an
    unreadable or missing directory) is the caller's to handle; an entry that vanishes meanwhile or
    cannot be examined is left out."""
    if is_uri(path):
        from pyarrow import fs as pafs

        fs, p, prefix = _arrow_fs(path)
        for i in fs.get_file_info(pafs.FileSelector(p, recursive=False)):
            mt = int(i.mtime.timestamp() * 1000) if i.mtime is not None else 0
            yield prefix + i.path, i.type == pafs.FileType.Directory, int(i.size or 0), mt
        return
    p = strip_file_scheme(path)
    with os.scandir(p) as it:
        for e in it:
            try:
                # directories are not entered through symbolic links (a link cycle would never
                # end); a link to a file counts as that file, with the target's size
                if e.is_dir(follow_symlinks=False):
                    yield join(p, e.name), True, 0, 0
                    continue
                st = e.stat(follow_symlinks=True)
            except OSError:
                continue
            if _stat.S_ISREG(st.st_mode):
                yield join(p, e.name), False, int(st.st_size), int(st.st_mtime * 1000)
