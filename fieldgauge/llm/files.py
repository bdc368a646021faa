"""Files in the shared folder, reached from tasks by its address."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path within it."""
    return fs.FileSystem.from_uri(address if ":" in address.split("/")[0] else f"file://{address}")


def put(address: str, name: str, content: bytes) -> None:
    """Write a small file whole: beside its place, then moved, so that a repeated task replaces it."""
    where, folder = place(address)
    where.create_dir(folder)
    beside = f"{folder}/{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(beside, compression=None) as out:
        out.write(content)
    where.move(beside, f"{folder}/{name}")
