"""Written tables that cut the lineage of iterative operators.

They are Parquet tables in the folder that ``spark.checkpoint.dir`` names, which driver and executors share, so a lost
executor costs only the tasks that it ran.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A temporary one is made only for a local master that names none (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="scanfold-")
        spark.sparkContext.setCheckpointDir(known)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return known


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written within each open ``temporary`` of this thread or task, the innermost last.
_open: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("open", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, but nothing removes the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def claimed(table: DataFrame) -> DataFrame:
    """Leave a written table to the ``temporary`` that is open, if any."""
    if _open.get():
        _open.get()[-1].append(table)
    return table


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back. Its path is in ``written_path``."""
    return claimed(written(df, name))


def delete(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``stored`` makes within are removed at the end, whatever happens. Other threads' are left alone."""
    tables: list[DataFrame] = []
    token = _open.set((*_open.get(), tables))
    try:
        yield
    finally:
        _open.reset(token)
        delete(*tables)
