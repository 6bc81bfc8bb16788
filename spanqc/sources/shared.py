"""The folder that the driver and all executors share, and what this process has put there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow.fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and
    all run on one machine (tests) is a temporary one made and set; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if path.startswith(("/", "file:")):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    for hadoop in ("s3a:", "s3n:"):
        path = "s3:" + path.removeprefix(hadoop) if path.startswith(hadoop) else path
    return pyarrow.fs.FileSystem.from_uri(path)


#: What this process has put into the shared folder and not taken away.
WRITTEN: set[str] = set()
#: The same of the scope that the caller stands in, if any.
SCOPE: ContextVar[set[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[set[str]]:
    """Gives the paths that are written within it, by this thread of control."""
    made: set[str] = set()
    token = SCOPE.set(made)
    try:
        yield made
    finally:
        SCOPE.reset(token)


def written(path: str) -> str:
    """The path, which is taken away when the process ends, or before by ``forget``."""
    WRITTEN.add(path)
    if (own := SCOPE.get()) is not None:
        own.add(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return written(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def forget(*paths: str) -> None:
    """Takes away what was written to the shared folder and is no longer read."""
    for path in paths:
        store, name = filesystem(path)
        if store.get_file_info(name).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(name)
        WRITTEN.discard(path)


def forget_all(but: frozenset[str] = frozenset()) -> None:
    """Takes away all that was written to the shared folder, but what is named. Results that read it can't be read any more."""
    forget(*(WRITTEN - but))


@atexit.register
def at_exit() -> None:
    """Results live as long as the process that planned them."""
    with suppress(OSError):
        forget_all()
