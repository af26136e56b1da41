"""Files that Python tasks write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import re
import uuid


def open_store(uri: str):
    """(file system, path) for a folder URI; plain and file: paths are local, others go through pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts) -> str:
    """Write bytes to a name no other attempt uses, then move it into place; returns its name."""
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    final = f"{name}-{uuid.uuid4().hex[:12]}"
    with store.open_output_stream(f"{path}/.{final}") as out:
        for p in parts:
            out.write(p)
    store.move(f"{path}/.{final}", f"{path}/{final}")
    return final


def open_file(uri: str, name: str):
    """Random-access file."""
    store, path = open_store(uri)
    return store.open_input_file(f"{path}/{name}")


def place_file(uri: str, name: str, data: bytes) -> None:
    """Write a file whose content is the same in every attempt: whichever attempt moves last into place, or is first, is right."""
    store, path = open_store(uri)
    aside = write_file(uri, name, [data])
    try:
        store.move(f"{path}/{aside}", f"{path}/{name}")
    except OSError:  # a store that does not replace: another attempt was first
        if not read_if_there(uri, name) == data:
            raise


def read_if_there(uri: str, name: str) -> bytes:
    """A whole file, empty where there is none."""
    from pyarrow import fs

    store, path = open_store(uri)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return b""
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read()
