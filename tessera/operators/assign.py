"""Argmin assignment of points to cells: Euclidean, power, additive, anisotropic; margins to the runner-up.

Cells go to every task as arrays (their number is checked: `MAX_CELLS`); points are never shuffled, but meet the cells in
Arrow batches, a block of points by a block of cells at a time, with the best and the second best kept on the way.
Ties go to the lower cell id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Cells that are sent to each task at most: some 100 MB.
MAX_CELLS = 1_000_000
CELL_BLOCK, BLOCK = 4096, 1 << 18
#: measure(dx, dy, dz, cells, points): differences by point and cell; columns of both as arrays.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def euclid(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    return dx * dx + dy * dy + dz * dz


def distance(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    return np.sqrt(dx * dx + dy * dy + dz * dz)


def power(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    return dx * dx + dy * dy + dz * dz - s["w"]


def additive(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    return np.sqrt(dx * dx + dy * dy + dz * dz) - s["w"]


def anisotropic(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    return np.sqrt(s["m11"] * dx * dx + s["m22"] * dy * dy + s["m33"] * dz * dz)


def quadratic(dx, dy, dz, s, p):  # noqa: ANN001, ANN201
    """Root of the full quadratic form with m12, m13, m23 besides the diagonal."""
    return np.sqrt(s["m11"] * dx * dx + s["m22"] * dy * dy + s["m33"] * dz * dz + 2 * (s["m12"] * dx * dy + s["m13"] * dx * dz + s["m23"] * dy * dz))


def collected(cells: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of cells as arrays, in order of grain; its size is checked first."""
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    found = cells.toPandas().sort_values("grain", kind="stable")
    return {c: found[c].to_numpy() for c in cells.columns}


def two_best(x: list[np.ndarray], s: dict[str, np.ndarray], measure: Measure, row: dict[str, np.ndarray], box: tuple[float | None, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the cell of least measure, that measure, and the next larger or equal one."""
    n, m = len(x[0]), len(s["grain"])
    best, first, second = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.full(n, np.inf)
    for c in range(0, m, CELL_BLOCK):
        part = {k: v[c : c + CELL_BLOCK] for k, v in s.items()}
        step = max(1, BLOCK // len(part["grain"]))
        for a in range(0, n, step):
            at = slice(a, min(a + step, n))
            d = [x[k][at, None] - part[f"s{axis}"][None] for k, axis in enumerate("xyz")]
            d = [v if size is None else v - np.rint(v / size) * size for v, size in zip(d, box, strict=True)]
            got = measure(*d, part, {k: v[at, None] for k, v in row.items()})
            near = got.argmin(axis=1)
            least = got[np.arange(len(got)), near]
            got[np.arange(len(got)), near] = np.inf
            other = got.min(axis=1)
            better = least < first[at]
            second[at] = np.where(better, np.minimum(first[at], other), np.minimum(second[at], least))
            best[at] = np.where(better, c + near, best[at])
            first[at] = np.where(better, least, first[at])
    return best, first, second


def _assigned(points: DataFrame, cells: DataFrame, box: float | tuple[float | None, ...], measure: Measure, margins: bool, using: tuple[str, ...]) -> DataFrame:
    s = collected(cells)
    boxes = tuple(box) if isinstance(box, tuple) else (box,) * 3
    names = points.columns
    kind = next(f for f in cells.schema if f.name == "grain").dataType
    schema = StructType([*points.schema, StructField("grain", kind), StructField("margin" if margins else "d", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(s["grain"]):
                continue
            column = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.float64)
            best, first, second = two_best([column(c) for c in "xyz"], s, measure, {c: column(c) for c in using}, boxes)
            value = (second - first) / 2 if margins else first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s["grain"][best]).cast(out.field("grain").type), pa.array(value)], schema=out)

    return points.mapInArrow(run, schema)


def assign(points: DataFrame, cells: DataFrame, box: float | tuple[float | None, ...], measure: Measure = euclid, using: tuple[str, ...] = ()) -> DataFrame:
    """`points` with `grain` and `d`, its measure. `box`: one length, or one per axis, None where it is not periodic; `using`:
    columns of the points that the measure reads."""
    return _assigned(points, cells, box, measure, False, using)


def margin(points: DataFrame, cells: DataFrame, box: float | tuple[float | None, ...], measure: Measure = additive, using: tuple[str, ...] = ()) -> DataFrame:
    """`points` with `grain` and `margin`, half the gap to the runner-up (infinite with one cell)."""
    return _assigned(points, cells, box, measure, True, using)
