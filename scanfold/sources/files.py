"""Files in any store that pyarrow knows, written so that a failed or repeated task leaves nothing behind."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.stored import stored


def storage(uri: str):
    """(file system, path) of a uri or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, content: bytes) -> None:
    """Write a file under another name first and move it: readers see all of it or none."""
    _put(*storage(uri), content, set())


def _put(system, path: str, content: bytes, made: set[str]) -> None:
    """As ``put``; folders in ``made`` exist."""
    folder, name = path.rsplit("/", 1)
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(part, compression=None) as out:
            out.write(content)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).is_file:
            system.delete_file(part)
        raise


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """(path, length) of the files written from rows (name, content). Names are paths below ``folder``; rows with a null
    name or content are passed over, and of equal names one wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), made = storage(folder.rstrip("/")), set()
        for batch in batches:
            done = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if name is not None and content.is_valid:
                    data = content.as_buffer().to_pybytes()
                    _put(system, f"{base}/{name}", data, made)
                    done.append((f"{folder.rstrip('/')}/{name}", len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "length"])

    return rows.select("name", "content").mapInArrow(run, "path string, length long")


def read_files(rows: DataFrame, size: int = 8 << 20) -> DataFrame:
    """(path, content) of the files that rows (path) name, such as those of ``write_files``, each read by the task of its
    row: no folder is listed and many small files share a task. A batch holds about ``size`` bytes; null paths are passed over."""

    def batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, prefix = None, None, ""
        for part in batches:
            paths, contents, held = [], [], 0
            for uri in part.column("path").to_pylist():
                if uri is None:
                    continue
                own = uri.rsplit("/", 1)[0]
                if own != root:
                    (system, prefix), root = storage(own), own
                with system.open_input_stream(f"{prefix}/{uri.rsplit('/', 1)[1]}", compression=None) as f:
                    contents.append(f.read())
                paths.append(uri)
                held += len(contents[-1])
                if held > size:
                    yield batch(paths, contents)
                    paths, contents, held = [], [], 0
            if paths:
                yield batch(paths, contents)

    return rows.select("path").mapInArrow(run, "path string, content binary")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, folder: str, matches: str, but: str = "") -> DataFrame:
    """(nr, path, name) of the files directly in a folder whose whole name matches a pattern and not ``but``, numbered by
    name. Contents are not read; a folder that does not exist has no files."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "nr long, path string, name string")
    files = spark.read.format("binaryFile").load(folder).select("path").withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    files = files.where(F.col("name").rlike(f"^(?:{matches})$"))
    if but:
        files = files.where(~F.col("name").rlike(f"^(?:{but})$"))
    return numbered(files, "name")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with nr, from 0, in order of ``by``: ranges are numbered by themselves and start after those before."""
    parted = stored(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    # one row a partition
    starts = sizes.select("part", "least", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by, "at")) - 1
    return parted.withColumn("own", within).join(F.broadcast(starts), "part").select((F.col("before") + F.col("own")).cast("long").alias("nr"), *rows.columns)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(nr, value): the lines of a text file, numbered from 0. The parts that Spark splits a file into are counted by
    themselves, so that no task sees all lines; none if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "nr long, value string")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a block
    starts = F.broadcast(blocks.select("block", "least", before.alias("before")))
    return rows.join(starts, "block").select((F.col("before") + F.col("at") - F.col("least")).cast("long").alias("nr"), "value")
