"""Raw files in the shared folder, written and read by tasks.

Every file is written by one task attempt under a name of its own and is closed before
its manifest row is emitted.  Readers open only files which a committed manifest lists, so
a repeated or speculative attempt leaves at most an unread file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def attempt_name(folder: str, suffix: str) -> str:
    """A path which no other task attempt uses."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{folder.rstrip('/')}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def create(path: str):
    """An output stream; the folder is made where the store has folders."""
    system, name = _open(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def open_input(path: str):
    """A random-access input file."""
    system, name = _open(path)
    return system.open_input_file(name)
