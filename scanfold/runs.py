"""Rows of equal keys, streamed through tasks in whole runs: many small groups share a batch, so a group has no cost of its
own in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task's keys, about: the number of tasks, not their memory, grows with the table.
DEALT = 100_000


def dealt(table: DataFrame, key: str) -> DataFrame:
    """A table, counted by its files' footers, with the rows of a key in one partition of about DEALT rows. Groupings and
    windows within a key then need no other shuffle."""
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // DEALT))
    return table.repartition(parts, key)


def in_runs(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with the rows of a key next to each other in one task, by ``order``, and their number ``nth`` from 1. Rows
    that are dealt by the key already are not shuffled again. Null keys are one key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ``in_runs`` cut where a key begins; only the rows of the last, open key are carried on."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        at = starts(pdf)
        if not len(at):
            held.append(pdf)
            continue
        if held or at[-1]:
            yield pd.concat([*held, pdf.iloc[: at[-1]]])
        held = [pdf.iloc[at[-1] :]]
    if held:
        yield pd.concat(held)


def starts(pdf: pd.DataFrame) -> np.ndarray:
    """Places of the first rows of keys."""
    return np.flatnonzero(pdf["nth"].to_numpy() == 1)
