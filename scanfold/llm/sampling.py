"""Bounded samples for fits, fixed by a hash of the rows' key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def hash_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, all of a smaller one: those whose key's hash falls in the share that gives as many.

    Rows are dropped where they lie, so a later sort or limit is over a bounded number of rows whatever the table.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(977), key), F.lit(_STEPS)) < int(_STEPS * rows / n))
