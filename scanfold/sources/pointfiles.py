"""Files of points as a data source: ``spark.read.format("points")`` after ``register``.

The suffix tells the form: p3d and p3di are numbers in text, three to a point or four with an intensity; p3db and p3dib
are little-endian doubles, with a byte of intensity. Binary files are read in ranges of whole records by many tasks; text
is read as a stream by one task a file, since a point may begin anywhere. The writer writes a file for each task under a
name of its own, and moves all of them into place when the job commits; a failed task or job leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import storage
from .textual import read_map

#: Bytes of a binary range, of a read of text, and rows of a batch.
RANGE = 32 << 20
CHUNK = 1 << 20
ROWS = 10_000


def form(name: str) -> tuple[bool, bool]:
    """(binary, with intensity) by suffix."""
    kind = name.rsplit(".", 1)[-1]
    if kind not in ("p3d", "p3di", "p3db", "p3dib"):
        raise ValueError(f"not a file of points: {name}")
    return kind.endswith("b"), "i" in kind[3:]


def record(intensity: bool) -> np.dtype:
    return np.dtype([(c, "<f8") for c in "xyz"] + ([("intensity", "u1")] if intensity else []))


def _paths(path: str) -> list[tuple[str, str, int]]:
    """(uri, path in its store, length) of a file, or of the files of points in a folder."""
    from pyarrow import fs

    system, at = storage(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
    return sorted((prefix + f.path, f.path, f.size) for f in files if f.is_file and f.base_name.rsplit(".", 1)[-1].startswith("p3d") and not f.base_name.startswith("."))


@dataclass
class Part(InputPartition):
    path: str
    first: int
    stop: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, intensity: bool):
        self.path, self.intensity = path, intensity

    def partitions(self) -> list[Part]:
        parts = []
        for uri, _, size in _paths(self.path):
            binary, intensity = form(uri)
            if intensity != self.intensity:
                raise ValueError("files with and without intensities")
            step = max(1, RANGE // record(intensity).itemsize)
            n = size // record(intensity).itemsize
            parts += [Part(uri, k, min(k + step, n)) for k in range(0, n, step)] if binary else [Part(uri, 0, None)]
        return parts or [Part("", 0, 0)]

    def _batch(self, path: str, first: int, v: np.ndarray, intensity: np.ndarray | None) -> pa.RecordBatch:
        cols = [pa.array([path] * len(v)), pa.array(np.arange(first, first + len(v))), *(pa.array(v[:, k]) for k in range(3))]
        return pa.RecordBatch.from_arrays(cols + ([] if intensity is None else [pa.array(intensity.astype(np.int16))]), names=["path", "nr", "x", "y", "z", *(["intensity"] if self.intensity else [])])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, at = storage(part.path)
        kind = record(self.intensity)
        if part.stop is not None:
            with system.open_input_file(at) as f:
                for k in range(part.first, part.stop, ROWS):
                    n = min(ROWS, part.stop - k)
                    v = np.frombuffer(f.read_at(n * kind.itemsize, k * kind.itemsize), kind)
                    yield self._batch(part.path, k, np.stack([v[c] for c in "xyz"], axis=1), v["intensity"] if self.intensity else None)
            return
        stride, nr, rest, numbers = 3 + self.intensity, 0, b"", []
        with system.open_input_stream(at, compression=None) as f:
            while True:
                data = f.read(CHUNK)
                text = rest + data
                cut = max(text.rfind(c) for c in (b" ", b"\n", b"\t", b"\r")) + 1 if data else len(text)
                rest = text[cut:]
                numbers += text[:cut].split()
                n = len(numbers) // stride
                for k in range(0, n, ROWS):
                    v = np.array(numbers[k * stride : min(k + ROWS, n) * stride], float).reshape(-1, stride)
                    yield self._batch(part.path, nr, v, v[:, 3] if self.intensity else None)
                    nr += len(v)
                numbers = numbers[n * stride :]
                if not data:
                    return


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path.rstrip("/"), kind, overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> Written:
        system, at = storage(self.path)
        binary, intensity = form("a." + self.kind)
        folder = f"{at}/.job-{self.job}"
        name = f"{folder}/{uuid.uuid4().hex}.{self.kind}"
        system.create_dir(folder, recursive=True)
        any_row = False
        try:
            with system.open_output_stream(name, compression=None) as out:
                held = []
                for r in rows:
                    if r["x"] is not None and r["y"] is not None and r["z"] is not None:
                        held.append((r["x"], r["y"], r["z"], *([int(r["intensity"] or 0)] if intensity else [])))
                    if len(held) >= ROWS:
                        out.write(self._bytes(held, binary, intensity))
                        held, any_row = [], True
                if held:
                    out.write(self._bytes(held, binary, intensity))
                    any_row = True
        except BaseException:
            system.delete_file(name)
            raise
        if not any_row:
            system.delete_file(name)
        return Written(name if any_row else None)

    @staticmethod
    def _bytes(rows: list[tuple], binary: bool, intensity: bool) -> bytes:
        if binary:
            return np.array(rows, record(intensity)).tobytes()
        return "".join(" ".join(repr(float(v)) if k < 3 else str(v) for k, v in enumerate(r)) + "\n" for r in rows).encode()

    def commit(self, messages: list[Written | None]) -> None:
        system, at = storage(self.path)
        system.create_dir(at, recursive=True)
        old = [p for _, p, _ in _paths(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{at}/{self.job[:8]}-{m.path.rsplit('/', 1)[-1]}")
        for p in old:
            system.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = storage(self.path)
        folder = f"{at}/.job-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class PointFiles(DataSource):
    """Options: ``path``; for writing ``kind`` (p3d, p3di, p3db, p3dib)."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def _intensity(self) -> bool:
        found = _paths(self.options["path"])
        return form(found[0][0])[1] if found else form("a." + self.options.get("kind", "p3d"))[1]

    def schema(self) -> str:
        return "path string, nr long, x double, y double, z double" + (", intensity short" if self._intensity() else "")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], "intensity" in schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("kind", "p3d"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointFiles)


def read_points(spark: SparkSession, path: str, first: int = 0, stop: int | None = None, least_hits: int = 0) -> DataFrame:
    """Points of a map's file by its suffix: ``txt`` holds surfaces (see ``read_map``), the others points. ``first`` and
    ``stop`` bound points by their number in their file, ``least_hits`` surfaces by their hits."""
    if path.endswith("txt"):
        return read_map(spark, path).where(F.col("hits") >= least_hits)
    register(spark)
    rows = spark.read.format("points").load(path).where(F.col("nr") >= first)
    return rows if stop is None else rows.where(F.col("nr") < stop)
