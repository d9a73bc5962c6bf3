"""Where intermediate tables go: the shared folder the cluster names.

`spark.checkpoint.dir` is read from the session. Only a local session that
names none gets a folder of its own; on a cluster that is an error, because a
folder of one machine is invisible to the executors of another.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}

# The folder of the innermost scope, below which new ones go.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="postlens-")
    return _local_roots[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared root that no other run uses. Nothing is created."""
    return f"{_scope.get() or shared_root(spark) + '/postlens'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, all intermediate tables that are begun within.

    Whatever is to outlast the scope must be written within it, to a folder named before:
    a table that is only defined there may read what is then gone. Scopes may be nested.
    """
    folder = new_folder(spark, "scope")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
