"""Random access to files by URI: local paths, the file systems that Arrow knows, and HTTP.

Used inside tasks by the grid source and sink, so that a file is read where it is wanted and only as far.
"""

from __future__ import annotations

import base64
import io
import posixpath
import urllib.request
from collections.abc import Iterable, Mapping

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path on it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def login(options: Mapping[str, str]) -> dict[str, str]:
    """The header of the ``user`` and ``password`` among the options, if they are there."""
    if not options.get("user"):
        return {}
    return {"Authorization": "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()}


def open_uri(uri: str, options: Mapping[str, str] | None = None):
    """A file to read and seek in. What comes by HTTP is read whole."""
    if uri.startswith(("http://", "https://")):
        with urllib.request.urlopen(urllib.request.Request(uri, headers=login(options or {})), timeout=60) as answer:
            return io.BytesIO(answer.read())
    files, path = file_system(uri)
    return files.open_input_file(path)


def listed(uri: str, recursive: bool = False) -> list[str]:
    """URIs of the files of a folder, sorted, without hidden ones; a file is itself."""
    if uri.startswith(("http://", "https://")):
        return [uri]
    files, path = file_system(uri)
    head = uri[: len(uri) - len(path)] if "://" in uri or not uri.startswith("file:") else "file:"
    if files.get_file_info(path).type == fs.FileType.File:
        return [uri]
    found = files.get_file_info(fs.FileSelector(path, recursive=recursive))
    names = [f.path for f in found if f.type == fs.FileType.File]
    hidden = [part for part in path.split("/") if part.startswith((".", "_"))]
    return sorted(head + n for n in names if [p for p in n.split("/") if p.startswith((".", "_"))] == hidden)


def sizes(uris: Iterable[str]) -> dict[str, int]:
    """Bytes of the files that there are; nothing of what comes by HTTP."""
    found = {}
    for uri in uris:
        if not uri.startswith(("http://", "https://")) and uri not in found:
            files, path = file_system(uri)
            found[uri] = files.get_file_info(path).size or 0
    return found


def lines(uri: str, options: Mapping[str, str] | None = None) -> list[str]:
    """The lines of a text file that aren't blank."""
    with open_uri(uri, options) as f:
        return [line.strip() for line in f.read().decode("utf-8").splitlines() if line.strip()]


def write_file(uri: str, content: bytes) -> None:
    """Writes beside the place and moves there, so that no reader sees half a file."""
    files, path = file_system(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    beside = f"{posixpath.dirname(path)}/_{posixpath.basename(path)}"
    with files.open_output_stream(beside) as f:
        f.write(content)
    files.move(beside, path)
