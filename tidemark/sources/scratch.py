"""Where intermediate tables go: a folder that the driver and all executors see.

What an application writes there is read lazily, so it stays until Python ends, and then goes; what is
written inside :func:`temporary` goes when the block ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

_folders: dict[str, str] = {}
_made: list[str] = []


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark takes it from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def _remove(spark: SparkSession, folder: str) -> None:
    if folder.startswith("file:"):
        shutil.rmtree(urlsplit(folder).path, ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the session may be over
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` (or ``setCheckpointDir``) names, by application.

    Only a local master, where driver and executors are one process, may go without; it gets a
    temporary folder.
    """
    context = spark.sparkContext
    if context.applicationId in _folders:
        return _folders[context.applicationId]
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = context._jsc.sc().getCheckpointDir()
        named = set_before.get() if set_before.isDefined() else None
    if not named:
        master = context.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        named = tempfile.mkdtemp(prefix="tidemark-")
    folder = _qualified(spark, f"{named.rstrip('/')}/{context.applicationId}")
    _folders[context.applicationId] = folder
    atexit.register(_remove, spark, folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Remove what is written below :func:`shared_path` inside the block, but for the paths given to what it yields."""
    before, kept = len(_made), set()
    try:
        yield kept.add
    finally:
        for path in _made[before:]:
            if path not in kept:
                remove(spark, path)
        _made[before:] = [p for p in _made[before:] if p in kept]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    _remove(spark, path)
