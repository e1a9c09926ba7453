"""Boxes as column expressions. A box is a struct of normalized centre x, y and size w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of box edges beyond the image, from rounding to eight decimals.
EDGE = 2e-8


def box(x, y, w, h) -> Column:
    return F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip((x, y, w, h), "xywh")])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def pixel_aspect(b: Column, width: Column, height: Column) -> Column:
    """Width over height in pixels of the original image; null for a box or image without height."""
    return F.try_divide(b["w"] * width, b["h"] * height)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    overlap = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s] / 2, b[p] + b[s] / 2) - F.greatest(a[p] - a[s] / 2, b[p] - b[s] / 2))
    shared = overlap("x", "w") * overlap("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def corners(b: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    """x0, y0, x1, y1 in pixels."""
    half_w, half_h = b["w"] / 2, b["h"] / 2
    edges = [(b["x"] - half_w) * width, (b["y"] - half_h) * height, (b["x"] + half_w) * width, (b["y"] + half_h) * height]
    return F.struct(*[e.alias(n) for e, n in zip(edges, ("x0", "y0", "x1", "y1"))])


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    return box((x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height)


def keeps(b: Column, width: Column, height: Column, min_area: float, max_area: float, max_aspect: float) -> Column:
    """The geometric filter: area within bounds, both inclusive, and neither side too long for the other."""
    a = pixel_aspect(b, width, height)
    return area(b).between(min_area, max_area) & (F.greatest(a, F.try_divide(F.lit(1.0), a)) <= max_aspect)


def is_valid(b: Column) -> Column:
    """Finite, of positive size, and within the image but for rounding."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    inside = (b["w"] > 0) & (b["w"] <= 1) & (b["h"] > 0) & (b["h"] <= 1) & b["x"].between(0, 1) & b["y"].between(0, 1)
    c = corners(b)
    edges = (F.least(c["x0"], c["y0"]) >= -EDGE) & (F.greatest(c["x1"], c["y1"]) <= 1 + EDGE)
    return F.coalesce(finite(b["x"]) & finite(b["y"]) & finite(b["w"]) & finite(b["h"]) & inside & edges, F.lit(False))
