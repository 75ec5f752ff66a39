"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    Where neither the context nor the session names one, a local master gets a
    folder of our own; a cluster is an error, as its executors share no folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lexiloom-checkpoints"))


_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The shuffle files it was made from go at once.  Spark keeps them until the
    driver happens to collect its garbage, so an operator of many steps would
    hold those of all steps together.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_LET_GO, None)
    conf.set(_LET_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: that of df may be run again
    finally:
        if before is None:
            conf.unset(_LET_GO)
        else:
            conf.set(_LET_GO, before)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose session sends at most ``rows`` texts at once to Python workers.

    Spark's own 10,000 make batches of tens of megabytes where texts are long,
    outside the heap and again in the worker.  A number that was set is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(rows))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: tuple = ()


def sole(key: tuple, make: Callable[[], T]) -> T:
    """The one large object that a Python worker holds between tasks.

    Workers are reused from stage to stage, so what another operator cached
    there is let go of when this one asks for its own.
    """
    global _held
    if not _held or _held[0] != key:
        _held = ()
        pa.default_memory_pool().release_unused()
        _held = (key, make())
    return _held[1]


def whole_text(name: str = "text") -> Column:
    """The text column, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus
