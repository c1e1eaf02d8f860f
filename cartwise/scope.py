"""Persisted frames that live as long as what reads them.

Within ``scope()`` intermediate frames are built once (``once``) and persisted
(``persist``); whoever opened the scope releases it.  ``shared`` keeps one scope at
a time, so that queries over the same session and folder share their rules and
neighbours; the first query over another one releases them.  A frame that is read
later than that is recomputed from its lineage: releasing early costs time, never
rows.

A persisted frame keeps its plan, and every frame that reads it shows that plan again:
over several steps it multiplies.  ``stored`` ends a step: what follows reads a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from cartwise.session import ensure_checkpoint_dir

#: Spark removes the shuffle files of a run at its end, not when the driver's JVM collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    def __init__(self) -> None:
        self.frames: list[DataFrame] = []
        self.values: dict[Any, Any] = {}

    def release(self) -> None:
        """Unpersist everything; a stopped session has nothing left to release.  Stored
        tables stay: a frame that is read later has no other lineage."""
        frames, self.frames, self.values = self.frames, [], {}
        for frame in frames:
            if frame.sparkSession.sparkContext._jsc is not None:
                frame.unpersist()


_current: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope(own: Scope | None = None) -> Iterator[Scope]:
    own = own or Scope()
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)


def persist(df: DataFrame) -> DataFrame:
    """Persist (memory and disk; lost blocks are recomputed from lineage).  Outside
    a scope the caller unpersists."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (own := _current.get()) is not None:
        own.frames.append(df)
    return df


@contextmanager
def clean_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the runs inside are removed when each ends."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Run ``df``, write it to a table in the folder that driver and executors share and
    read it back.  For what is small beside its input and read several times: a lost
    executor costs no recomputation, and the plans that follow begin here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/steps/{tag}-{uuid.uuid4().hex}"
    with clean_up(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(key: Any, build: Callable[[], Any]) -> Any:
    """``build()``, remembered within the current scope."""
    own = _current.get()
    if own is None:
        return build()
    if key not in own.values:
        own.values[key] = build()
    return own.values[key]


_shared: dict[Any, Scope] = {}


def shared(key: Any) -> Scope:
    """The scope of ``key``; that of any other key is released."""
    for other in [k for k in _shared if k != key]:
        _shared.pop(other).release()
    return _shared.setdefault(key, Scope())
