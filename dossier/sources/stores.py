"""Files of any store that tasks and the driver reach by URI."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyarrow import NativeFile, fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it.

    Names are taken as Spark writes them: signs are not escaped, and local files may have one slash.
    """
    uri = uri.rstrip("/")
    scheme, colon, rest = uri.partition(":")
    if uri.startswith("/") or not colon:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, place = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{place}"


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def names_in(uri: str) -> set[str]:
    """Names of the files of a folder; none if it does not exist."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name for f in found if f.is_file}


def folders_in(uri: str) -> set[str]:
    """Names of the folders of a folder; none if it does not exist."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name for f in found if f.type == fs.FileType.Directory}


def publish(uri: str, name: str, write: Callable[[NativeFile], object]) -> None:
    """A file that is there whole or not at all: ``write(stream)`` goes to a name of its own that
    readers skip, which becomes ``name`` in the end."""
    system, path = opened(uri)
    draft = f"{path}/_{uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        write(stream)
    system.move(draft, f"{path}/{name}")
