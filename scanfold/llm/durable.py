"""Written tables of the operators, and batches of bounded size; see ``scanfold.stored``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanfold.stored import claimed, delete, delete_path, new_path, shared_dir, stored, temporary, written

__all__ = ["bounded_batches", "delete", "delete_path", "leaves_only", "new_path", "shared_dir", "temporary", "write"]

#: The frame as a Parquet table in the shared folder, read back. Its path is in ``written_path``.
write = stored


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> None:
    """Lower the session's Arrow batches from their defaults, so that a batch of long texts, which Python holds whole,
    stays small. Values that the session sets itself are kept."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def leaves_only(name: str) -> Callable:
    """A function's DataFrame as a written table, the only one that stays of those that it writes."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(*args, **kwargs) -> DataFrame:
            with temporary():
                out = written(fn(*args, **kwargs), name)
            return claimed(out)

        return run

    return wrap
