"""Groups of a sorted shuffle, streamed through Arrow one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import release_memory

#: Rows of a batch that is gathered from tuples.
GATHERED = 4096


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, heavy: bool = False) -> DataFrame:
    """``fn`` over each group of equal, non-null integer ``keys``, its rows sorted by ``order``.

    Like a grouped map, but without a cost of its own for each of very many small groups; a task holds one group.
    ``heavy`` keeps all shuffle partitions apart where a group's work is out of proportion to its bytes. ``fn`` may also
    yield tuples, which are gathered into batches of the ``schema``.
    """
    names, kinds = zip(*((f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)), strict=True)

    def gathered(parts: Iterator) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in parts:
            if not isinstance(part, tuple):
                yield part
                continue
            rows.append(part)
            if len(rows) >= GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            cut = np.zeros(len(batch), bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            first = tuple(int(c[0]) for c in cols)
            if last is not None and first != last:
                yield from fn(pa.Table.from_batches(held))
                held = []
            starts = [0, *np.flatnonzero(cut).tolist()]
            for a, b in zip(starts, [*starts[1:], None], strict=True):
                part = batch.slice(a) if b is None else batch.slice(a, b - a)
                held.append(part)
                if b is not None:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
            last = tuple(int(c[-1]) for c in cols)
        if held:
            yield from fn(pa.Table.from_batches(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(groups(batches))
        release_memory()

    number = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if heavy else []
    return df.repartition(*number, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: A key of more than this share of all rows, and of more than so many, is joined by broadcast.
HOT_SHARE = 1 / 1000
HOT_ROWS = 1000


def join_by_size(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a ``key`` and the ``size`` of the key among the ``total`` rows.

    Keys of over HOT_SHARE of all rows, of which there are at most 1 / HOT_SHARE, are broadcast, so that no task gets
    all rows of such a key; the others are shuffled. ``how`` is inner or left.
    """
    hot = F.col(size) > max(HOT_ROWS, int(total * HOT_SHARE))
    some = F.broadcast(keyed.where(hot))
    rest = rows.join(some.select(key), key, "left_anti").join(keyed.where(~hot), key, how)
    return rows.join(some, key).unionByName(rest)
