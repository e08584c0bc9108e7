"""Frames that a job reads more than once, with an owner that lets go of them.

``keep`` persists a frame for the job that runs at the moment. The job's frames are released
at the end of its ``owned`` block, or, where the block handed its result on with ``until``,
when nobody holds that result any more. Outside a block nothing is kept: frames are then
computed again, and nothing can be left behind.

``cut`` is for small frames that later steps of a loop read: it writes a checkpoint to the
shared folder, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

import tempfile
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_OWNER: ContextVar[Owner | None] = ContextVar("owner", default=None)


class Owner:
    def __init__(self) -> None:
        self._kept: list[DataFrame] = []
        self._handed_on = False

    def keep(self, df: DataFrame) -> DataFrame:
        """Persisted; recomputable after a lost executor, on disk when memory is short."""
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def until(self, result: DataFrame) -> DataFrame:
        """The frames live as long as ``result``, which is read after the block."""
        self._handed_on = True
        weakref.finalize(result, _release, self._kept).atexit = False
        return result

    def release(self) -> None:
        _release(self._kept)


def _release(kept: list[DataFrame]) -> None:
    while kept:
        df = kept.pop()
        if not _stopped(df):
            df.unpersist()


def _stopped(df: DataFrame) -> bool:
    return getattr(df.sparkSession.sparkContext, "_jsc", None) is None


@contextmanager
def owned() -> Iterator[Owner]:
    """A block whose frames are its own; a block inside another one has an owner as well."""
    owner = Owner()
    token = _OWNER.set(owner)
    try:
        yield owner
    except BaseException:
        owner.release()
        raise
    finally:
        _OWNER.reset(token)
    if not owner._handed_on:
        owner.release()


def keep(df: DataFrame) -> DataFrame:
    owner = _OWNER.get()
    return owner.keep(df) if owner else df


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, may leave it unset and gets a
    temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rentlens-")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint; Spark deletes its files once no plan refers to it, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()
