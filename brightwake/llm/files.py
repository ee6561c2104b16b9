"""Files in the shared folder, opened from Python workers by URI."""

from __future__ import annotations

import uuid

from pyarrow import NativeFile, fs
from pyspark import TaskContext


def create(uri: str) -> NativeFile:
    filesystem, path = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(path)


def open_for_reading(uri: str) -> NativeFile:
    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(path)


def part_uri(folder: str, suffix: str) -> str:
    """A name no other attempt of this task uses: a lost task's leftovers are never read."""
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
