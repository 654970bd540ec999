"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Hashable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import shared_dir, stored

__all__ = ["WORD_PATTERN", "fold", "id_bucket", "kept", "ready_workers", "shared_dir", "stored", "table", "trim"]

#: Words are runs of anything but these six bytes: space and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches that go to Python: rows and bytes at most.
ROWS, BYTES = 128, 4 << 20


def ready_workers(spark: SparkSession, rows: int = ROWS) -> None:
    """Before Python runs on executors: small batches, and this package on the workers' path.

    Spark buffers a whole Arrow batch outside the heap on both sides of the pipe, afresh in every task, until the
    next garbage collection: 10,000 texts a batch cost gigabytes an executor. The path helps local sessions that were started in another folder.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C library can; on the driver after a model was made."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable = None, make: Callable[[], Any] | None = None) -> Any:
    """What a worker made from a model, kept between its tasks: one thing at a time, over all operators.

    Every operator's function on workers calls this first, with a key or without: what another operator left is
    freed and its memory goes back to the system.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            trim()
        if make is not None:
            _KEPT[key] = make()
    return _KEPT.get(key)


def fold(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as bucket -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))
