"""Boxes on pages: origin at the bottom left, x0 <= x1, y0 <= y1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX = "struct<x0:double,x1:double,y0:double,y1:double>"


def area(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.round(F.abs(x0 - x1) * F.abs(y0 - y1), 3)


def overlaps(a: Column, b: Column) -> Column:
    """Two boxes (structs) share a point; touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def contains(outer: Column, inner: Column, tolerance: float = 10.0) -> Column:
    """``inner`` lies in ``outer``, each side let out by the tolerance."""
    return (outer["x0"] - tolerance <= inner["x0"]) & (outer["x1"] + tolerance >= inner["x1"]) & (outer["y0"] - tolerance <= inner["y0"]) & (outer["y1"] + tolerance >= inner["y1"])


def union_aggregates() -> list[Column]:
    """Aggregates of the columns x0, x1, y0, y1 to the box that holds all."""
    return [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]


def top_and_bottom(y0: Column, y1: Column, height: Column) -> tuple[Column, Column]:
    """Distances from the top edge of the page."""
    return F.round(height - y1, 3), F.round(height - y0, 3)


def rescale(x: Column, page: Column, image: Column) -> Column:
    """A page coordinate in image pixels."""
    return x * image / page


def is_valid(x0: Column, x1: Column, y0: Column, y1: Column, width: Column, height: Column, zero_size: bool = False) -> Column:
    """Inside the page and of some size, to two decimals."""
    a, b, c, d = (F.round(v, 2) for v in (x0, x1, y0, y1))
    size = (a <= b) & (c <= d) if zero_size else (a < b) & (c < d)
    return size & (a >= 0) & (c >= 0) & (b <= F.round(width, 2)) & (d <= F.round(height, 2))
