"""Functions over frame vectors held as array columns (row-major grids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_abs_difference(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def dhash(vector: Column, rows: int, columns: int) -> Column:
    """Bits of right neighbour > left neighbour, row by row, the first bit most significant."""
    cells = [r * columns + c for r in range(rows) for c in range(columns - 1)]
    return F.aggregate(F.array(*map(F.lit, cells)), F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR((F.get(vector, i + 1) > F.get(vector, i)).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def edges(vector: Column, columns: int, limit: float) -> Column:
    """Whether each cell differs from its right neighbour by more than ``limit``; the last of a row does not."""
    return F.transform(vector, lambda x, i: F.when((i + 1) % columns == 0, F.lit(False)).otherwise(F.abs(F.get(vector, i + 1) - x) > limit))


def share(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x)) / F.size(flags)


def contrast_std(vector: Column, scale: float) -> Column:
    """Population standard deviation over ``scale``."""
    mean = _sum(vector) / F.size(vector)
    return F.sqrt(_sum(F.transform(vector, lambda x: (x - mean) * (x - mean))) / F.size(vector)) / scale


def bbox_share(changed: Column, columns: int) -> Column:
    """Share of the grid that the box around the changed cells covers."""
    at = F.filter(F.transform(changed, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    row, column = F.transform(at, lambda i: F.floor(i / columns)), F.transform(at, lambda i: i % columns)
    area = (F.array_max(row) - F.array_min(row) + 1) * (F.array_max(column) - F.array_min(column) + 1)
    return F.when(F.size(at) == 0, F.lit(0.0)).otherwise(area / F.size(changed))
