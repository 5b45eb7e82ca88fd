"""A map of cells that grows scan by scan, kept as Parquet tables by cube of cells.

A batch rewrites only the cubes that it touches or that have gone out of sight; a manifest tells each cube's latest version
and is moved into place last, so a failed batch changes nothing and a repeated one is passed over. Replaced versions are
kept for a few batches, for readers, and then removed.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.operators.grid import AXES, CELL, with_cells
from scanfold.sources.files import put, storage

from .stateful import append_evicted, merge_into_map

SCHEMA = "id long, x double, y double, z double, conf double, ix int, iy int, iz int, hits long"
#: Moves shorter than this do not add a scan; share of valid pixels from which a scan may replace the map.
MOVE_LEAST, VALID_LEAST = 0.05, 0.7
#: Cells stay until they are so much farther than points are added.
MARGIN = 10.0


@dataclass
class Manifest:
    version: int = -1
    cubes: dict[str, int] = field(default_factory=dict)
    centre: tuple[float, float, float] | None = None
    replaced: list[tuple[int, str]] = field(default_factory=list)


class CubeMap:
    """The map in ``folder``: cells of ``extent``, in cubes of ``side`` cells a side, from points up to ``reach`` away.

    With ``evicted`` cells out of sight are appended to the files of points there; otherwise the map keeps all. The
    manifest, which the driver holds, has an entry for each occupied cube: those within sight, or all that were ever.
    """

    def __init__(self, spark: SparkSession, folder: str, extent: float, reach: float, side: int = 64, evicted: str | None = None, keep: int = 2, margin: float = MARGIN):
        self.spark, self.folder, self.extent, self.reach = spark, folder.rstrip("/"), extent, reach
        self.side, self.evicted, self.keep, self.margin = side, evicted, keep, margin

    def manifest(self) -> Manifest:
        system, path = storage(f"{self.folder}/manifest.json")
        if not system.get_file_info(path).is_file:
            return Manifest()
        with system.open_input_file(path) as f:
            return Manifest(**json.loads(f.read()))

    def _cube(self) -> list:
        return [F.floor(F.col(c) / self.side).cast("string") for c in CELL]

    def _paths(self, cubes: dict[str, int]) -> list[str]:
        return [f"{self.folder}/v{v}/cube={c}" for c, v in sorted(cubes.items())]

    def _read(self, cubes: dict[str, int]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*self._paths(cubes)) if cubes else self.spark.createDataFrame([], SCHEMA)

    def table(self) -> DataFrame:
        """All cells: id, x, y, z, conf of the surest point, the cell, and its hits."""
        return self._read(self.manifest().cubes)

    def _far(self, cube: str, centre: tuple[float, float, float]) -> tuple[float, float]:
        """Least and greatest distance of a cube's cells' centres from a point."""
        size = self.side * self.extent
        low = [int(c) * size for c in cube.split("_")]
        near = sum(max(a + self.extent / 2 - c, 0, c - a - size + self.extent / 2) ** 2 for a, c in zip(low, centre, strict=True))
        far = sum(max(abs(a - c), abs(a + size - c)) ** 2 for a, c in zip(low, centre, strict=True))
        return math.sqrt(near), math.sqrt(far)

    def add(self, points: DataFrame, centre: tuple[float, float, float], version: int | None = None, valid: float = 1.0, renew: bool = False) -> bool:
        """Add a scan's points (id, x, y, z, conf), in the map's frame, as seen from ``centre``; whether it was added.

        A scan from less than MOVE_LEAST from the last one is skipped. With ``renew`` a scan of enough ``valid`` pixels
        replaces the map. A ``version`` that the map has reached already is passed over.
        """
        now = self.manifest()
        version = now.version + 1 if version is None else version
        if version <= now.version:
            return False
        if now.centre is not None and math.dist(now.centre, centre) < MOVE_LEAST:
            return False
        held = {} if renew and valid > VALID_LEAST else dict(now.cubes)
        near = points.where(sum((F.col(a) - F.lit(float(c))) ** 2 for a, c in zip(AXES, centre, strict=True)) < F.lit(float(self.reach) ** 2))
        new = with_cells(near.select("id", *AXES, "conf"), self.extent).withColumn("cube", F.concat_ws("_", *self._cube()))
        touched = {r.cube for r in new.select("cube").distinct().collect()}  # cubes within reach of one scan
        limit = self.reach + self.margin
        diagonal = self.extent * math.sqrt(3) / 2
        gone = {c for c in held if self.evicted and self._far(c, centre)[1] + diagonal > limit}
        change = {c: v for c, v in held.items() if c in touched or c in gone}
        merged = merge_into_map(new, self._read(change), self.extent)
        if self.evicted:
            middle = [(F.col(i) + 0.5) * self.extent for i in CELL]
            off = F.sqrt(sum((m - F.lit(float(c))) ** 2 for m, c in zip(middle, centre, strict=True)))
            outside = merged.where(off + diagonal > limit)
            append_evicted(outside, centre, -1.0, self.evicted)
            merged = merged.where(off + diagonal <= limit)
        path = f"{self.folder}/v{version}"
        merged.withColumn("cube", F.concat_ws("_", *self._cube())).write.mode("overwrite").partitionBy("cube").parquet(path)
        system, at = storage(path)
        from pyarrow import fs

        there = {f.base_name.split("=", 1)[1] for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("cube=")}
        replaced = [(version, p) for p in self._paths(change if held else now.cubes)]
        cubes = {c: v for c, v in held.items() if c not in change} | dict.fromkeys(there, version)
        old = [(v, p) for v, p in now.replaced if v + self.keep <= version]
        after = Manifest(version, cubes, tuple(map(float, centre)), [(v, p) for v, p in now.replaced if v + self.keep > version] + replaced)
        put(f"{self.folder}/manifest.json", json.dumps(after.__dict__).encode())
        for _, p in old:
            system, gone_path = storage(p)
            if system.get_file_info(gone_path).type != fs.FileType.NotFound:
                system.delete_dir(gone_path)
        return True
