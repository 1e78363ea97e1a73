"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for different lengths or a zero vector."""
    a, b = _wide(a), _wide(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot / norms)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))))


def l2_to_cosine(distance: Column) -> Column:
    """Cosine of unit vectors at a Euclidean distance."""
    return 1 - distance * distance / 2


def minmax(values: Column) -> Column:
    """Array scaled to 0..1; all zeros where its values are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(high == low, 0.0).otherwise((x - low) / (high - low)))
