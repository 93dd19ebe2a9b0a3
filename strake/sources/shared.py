"""A folder that driver and executors share, for files of records that several steps read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_made: list[str] = []


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and inner path of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder; a temporary one only in local mode. It is deleted when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strake-")
        _made.append(base)
    made = f"{base.rstrip('/')}/strake-{name}-{uuid.uuid4().hex}"
    _made.append(made)
    return made


def clear() -> None:
    """Deletes the folders made in this process."""
    while _made:
        system, inner = located(_made.pop())
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


atexit.register(clear)
