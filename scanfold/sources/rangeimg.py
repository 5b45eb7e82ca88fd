"""Range images: 16-bit grey PNG files, distance = value / multiplier, 0 = no return."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.runs import in_runs, starts, whole_runs

#: Pixels of a batch of images.
PIXELS = 1 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """Values of a non-interlaced grey PNG of 8 or 16 bits."""
    if not data.startswith(_MAGIC):
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if colour != 0 or depth not in (8, 16) or interlace:
        raise ValueError("only plain grey images of 8 or 16 bits")
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        line, how = raw[y, 1:], raw[y, 0]
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = line + above
        elif how == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            row, up = bytearray(line), above.tolist()
            for i in range(len(row)):
                a, b, c = row[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i] = (row[i] + guess) & 255
            out[y] = np.frombuffer(bytes(row), np.uint8)
        above = out[y]
    return out.reshape(height, width, step).view(">u2")[:, :, 0].astype(np.int32) if step == 2 else out.astype(np.int32)


def encode_png(values: np.ndarray) -> bytes:
    """A 16-bit grey PNG; values outside 0..65535 become 0."""
    v = np.where((values >= 0) & (values <= 65535), values, 0).astype(">u2")
    raw = np.zeros((v.shape[0], 1 + 2 * v.shape[1]), np.uint8)
    raw[:, 1:] = v.view(np.uint8).reshape(v.shape[0], -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 16, 0, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def _rows(files: DataFrame, value: str) -> DataFrame:
    """(path, row, col, value) of images (path, content), spread into rows by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, widths, values, held = [], [], [], 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                v = decode_png(content.as_py())
                paths.append(path), widths.append(v.shape[1]), values.append(v.ravel())
                held += v.size
                if held > PIXELS:
                    yield _images(paths, widths, values)
                    paths, widths, values, held = [], [], [], 0
            if paths:
                yield _images(paths, widths, values)

    images = files.select("path", "content").mapInArrow(run, "path string, width int, values array<int>")
    rows = images.select("path", "width", F.posexplode("values").alias("at", value))
    return rows.select("path", F.expr("cast(at div width as int)").alias("row"), (F.col("at") % F.col("width")).alias("col"), value)


def _images(paths: list[str], widths: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    arrays = [pa.array(paths, pa.string()), pa.array(widths, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).astype(np.int32)))]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "width", "values"])


def read_range_images(spark: SparkSession, path: str, multiplier: float = 500.0, pattern: str = "*.png") -> DataFrame:
    """(path, row, col, dist) of all images below a folder; dist is null where there is no return."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return range_images(files, multiplier)


def range_images(files: DataFrame, multiplier: float = 500.0) -> DataFrame:
    """(path, row, col, dist) of images (path, content)."""
    rows = _rows(files, "value")
    return rows.select("path", "row", "col", (F.nullif(F.col("value"), F.lit(0)) / F.lit(multiplier)).alias("dist"))


def read_segment_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, segment) of label images, without the pixels of value 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return _rows(files, "segment").where("segment <> 0")


def to_pixel_value(dist: Column, multiplier: float = 500.0) -> Column:
    """Truncated 16-bit value of a distance; 0 where it is missing, negative or too far."""
    v = (dist * F.lit(multiplier)).cast("int")
    return F.when((v >= 0) & (v <= 65535), v).otherwise(0)


def dense_segments(labelled: DataFrame) -> DataFrame:
    """Segments numbered from 1 within their frame in the order of their first pixels."""
    first = labelled.groupBy("frame", "segment").agg(F.min(F.struct("row", "col")).alias("at"))
    from pyspark.sql import Window

    nr = first.withColumn("nr", F.row_number().over(Window.partitionBy("frame").orderBy("at"))).drop("at")
    return labelled.join(nr, ["frame", "segment"])


def encode_frames(rows: DataFrame, multiplier: float = 500.0) -> DataFrame:
    """(frame, content): a PNG file of each frame's (row, col, dist), indices from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches):
            at = starts(pdf)
            row, col, value = (pdf[c].to_numpy() for c in ("row", "col", "value"))
            out = []
            for a, b in zip(at, [*at[1:], len(pdf)], strict=True):
                image = np.zeros((int(row[a:b].max()) + 1, int(col[a:b].max()) + 1), np.int64)
                image[row[a:b], col[a:b]] = value[a:b]
                out.append(encode_png(image))
            yield pd.DataFrame({"frame": pdf["frame"].to_numpy()[at], "content": out})

    values = rows.select("frame", "row", "col", to_pixel_value(F.col("dist"), multiplier).alias("value"))
    return in_runs(values, "frame", "row", "col").mapInPandas(run, "frame long, content binary")
