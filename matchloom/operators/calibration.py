"""Calibrators of margins: a logistic curve and a step function."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Platt:
    a: float
    b: float

    def __call__(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(self.a * x + self.b)))


@dataclass(frozen=True)
class Isotonic:
    x: tuple[float, ...]
    y: tuple[float, ...]

    def __call__(self, x: Column) -> Column:
        """Straight lines between knots, level outside; of knots with one x the last one counts at it."""
        if not self.x:
            return F.lit(None).cast("double")
        xs, ys = F.array(*map(F.lit, self.x)), F.array(*map(F.lit, self.y))
        i = F.size(F.filter(xs, lambda k: k <= x))
        n = len(self.x)
        at = lambda a, j: F.element_at(a, F.greatest(F.lit(1), F.least(F.lit(n), j)))
        x0, x1, y0, y1 = at(xs, i), at(xs, i + 1), at(ys, i), at(ys, i + 1)
        return F.when(i == 0, F.lit(self.y[0])).when(i >= n, F.lit(self.y[-1])).when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def fit_platt(rows: DataFrame, x: str, y: str, rounds: int = 200) -> Platt:
    """Newton's method from slope 1: five sums a round over all rows, and a 2 by 2 system on the driver. It stops at a step below 1e-10 or a singular system."""
    data = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).persist()
    a, b = 1.0, 0.0
    try:
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
            w = F.greatest(p * (1 - p), F.lit(1e-9))
            g = p - F.col("y")
            s = data.agg(F.sum(g * F.col("x")), F.sum(g), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
            if s[0] is None:
                break
            det = s[2] * s[4] - s[3] * s[3]
            if det == 0 or math.isnan(det):
                break
            da, db = (s[4] * s[0] - s[3] * s[1]) / det, (s[2] * s[1] - s[3] * s[0]) / det
            a, b = a - da, b - db
            if max(abs(da), abs(db)) < 1e-10:
                break
    finally:
        data.unpersist()
    return Platt(a, b)


def _pool(blocks: list[list[float]]) -> list[list[float]]:
    """Adjacent blocks [first x, last x, sum of y, weight] pooled until their means rise."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][2] * out[-1][3] > out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


def fit_isotonic(rows: DataFrame, x: str, y: str) -> Isotonic:
    """Pooled adjacent violators in order of x; equal x are one point. Ranges of x are pooled apart first, and only their blocks, few where y rises with x at all, are pooled on
    the driver: pooling what is pooled gives the same steps. Each block gives a knot at both its ends."""
    points = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").cast("double").alias("w"))

    def pool(frames):
        blocks: list[list[float]] = []
        for f in frames:
            blocks = _pool([*blocks, *([a, a, s, w] for a, s, w in zip(f["x"].tolist(), f["s"].tolist(), f["w"].tolist()))])
        yield pd.DataFrame(blocks, columns=["lo", "hi", "s", "w"], dtype="float64")

    parts = points.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(pool, "lo double, hi double, s double, w double")
    blocks = _pool(sorted([r["lo"], r["hi"], r["s"], r["w"]] for r in parts.collect()))
    return Isotonic(tuple(v for b in blocks for v in b[:2]), tuple(v for b in blocks for v in (b[2] / b[3],) * 2))


def to_json(calibrator: Platt | Isotonic, meta: dict | None = None) -> str:
    body = {"kind": "platt", "a": calibrator.a, "b": calibrator.b} if isinstance(calibrator, Platt) else {"kind": "isotonic", "x": list(calibrator.x), "y": list(calibrator.y)}
    return json.dumps(body | ({"_meta": meta} if meta else {}), indent=2)


def from_json(text: str) -> Platt | Isotonic:
    body = json.loads(text)
    if body.get("kind") == "platt":
        return Platt(float(body["a"]), float(body["b"]))
    if body.get("kind") == "isotonic":
        return Isotonic(tuple(map(float, body["x"])), tuple(map(float, body["y"])))
    raise ValueError(f"unknown calibrator: {body.get('kind')}")


def split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two halves by a hash of the key, the same in every run."""
    half = F.pmod(F.xxhash64(key), F.lit(2))
    return rows.filter(half == 0), rows.filter(half == 1)
