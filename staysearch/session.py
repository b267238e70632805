"""Session settings and the shared work folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "staysearch", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(cores), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("staysearch.work.dir", None)


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which every executor must see.

    A running session cannot be given that setting any more; one without it can name its
    folder as ``staysearch.work.dir``.
    """
    root = work_root(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_open: dict[int, tuple[int, str | None]] = {}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files behind.

    Otherwise they stay until the driver happens to collect its garbage, and a job of several
    writes, or a stream, holds the shuffles of all of them on disk. Blocks of one session may
    overlap in time; the setting goes back to what it was when the last one ends.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        users, before = _open.get(session) or (0, spark.conf.get(REMOVE_SHUFFLES, None))
        _open[session] = (users + 1, before)
        spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            users, before = _open.pop(session)
            if users > 1:
                _open[session] = (users - 1, before)
            elif before is None:
                spark.conf.unset(REMOVE_SHUFFLES)
            else:
                spark.conf.set(REMOVE_SHUFFLES, before)
