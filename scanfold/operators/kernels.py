"""Decisions of trained kernel machines as column expressions; a model's support vectors are part of the expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions.vec import dot, doubles


@dataclass(frozen=True)
class KernelPlane:
    """One decision value: the sum of coefficient times kernel with each support vector, less rho."""

    vectors: Sequence[Sequence[float]]
    coefficients: Sequence[float]
    rho: float
    kind: str = "rbf"
    gamma: float = 1.0
    offset: float = 0.0
    degree: int = 3
    extra: dict = field(default_factory=dict)

    def kernel(self, f: Column, v: Sequence[float]) -> Column:
        s = F.array(*[F.lit(float(x)) for x in v])
        if self.kind == "rbf":
            d2 = F.aggregate(F.zip_with(doubles(f), s, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
            return F.exp(-F.lit(self.gamma) * d2)
        inner = dot(f, s)
        if self.kind == "linear":
            return inner
        scaled = F.lit(self.gamma) * inner + F.lit(self.offset)
        return F.pow(scaled, F.lit(float(self.degree))) if self.kind == "poly" else F.tanh(scaled)

    def decision(self, f: Column) -> Column:
        return sum((F.lit(float(c)) * self.kernel(f, v) for c, v in zip(self.coefficients, self.vectors, strict=True)), F.lit(-float(self.rho)))


def vote(rows: DataFrame, planes: dict[tuple[int, int], KernelPlane]) -> DataFrame:
    """``rows`` with label: the class with most votes over pairs, ties to the lesser, and one decision column a pair."""
    values = {p: plane.decision(F.col("f")) for p, plane in planes.items()}
    classes = sorted({c for p in planes for c in p})
    votes = {c: sum((F.when(v > 0, int(p[0] == c)).otherwise(int(p[1] == c)) for p, v in values.items() if c in p), F.lit(0)) for c in classes}
    best = F.greatest(*votes.values()) if len(votes) > 1 else F.lit(0)
    label = F.coalesce(*[F.when(v == best, F.lit(c)) for c, v in votes.items()])
    return rows.withColumns({f"decision_{a}_{b}": v for (a, b), v in values.items()} | {"label": label})
