"""Boxes: array<int or double> of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(box: Column, most: int = 1000) -> Column:
    """Four numbers, 0 <= x1 < x2 <= most and the same for y; never null."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (x1 >= 0) & (x1 < x2) & (x2 <= most) & (y1 >= 0) & (y1 < y2) & (y2 <= most), F.lit(False))


def read(box: Column) -> Column:
    """The box if valid, else null."""
    return F.when(valid(box), box)


def parts(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)).cast("double") for i in range(4)]


def area(box: Column) -> Column:
    x1, y1, x2, y2 = parts(box)
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def intersection(a: Column, b: Column) -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = parts(a), parts(b)
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; a null box or an empty union: 0."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.coalesce(F.when(union > 0, both / union), F.lit(0.0))


def center_distance(a: Column, b: Column) -> Column:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = parts(a), parts(b)
    return F.sqrt(F.pow((ax1 + ax2) / 2 - (bx1 + bx2) / 2, F.lit(2.0)) + F.pow((ay1 + ay2) / 2 - (by1 + by2) / 2, F.lit(2.0)))


def pair_metrics(a: Column, b: Column) -> Column:
    """Struct of the differences of a candidate box a from a reference box b; all null unless both are valid."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = parts(a), parts(b)
    ok = valid(a) & valid(b)
    fields = {
        "center_dx": (ax1 + ax2) / 2 - (bx1 + bx2) / 2,
        "center_dy": (ay1 + ay2) / 2 - (by1 + by2) / 2,
        "center_distance": center_distance(a, b),
        "area_candidate": area(a),
        "area_reference": area(b),
        "area_error": area(a) - area(b),
        "area_ratio": area(a) / F.when(area(b) > 0, area(b)),
        "l1": (F.abs(ax1 - bx1) + F.abs(ay1 - by1) + F.abs(ax2 - bx2) + F.abs(ay2 - by2)) / 4,
        "iou": iou(a, b),
    }
    return F.struct(ok.alias("valid"), *[F.when(ok, v).alias(k) for k, v in fields.items()])


def to_pixels(box: Column, width: Column, height: Column, scale: float = 1000.0) -> Column:
    """Normalised to pixels: rounded half to even, clamped to the image, corners in order."""
    x1, y1, x2, y2 = parts(box)
    at = lambda v, side: F.greatest(F.lit(0), F.least(side - 1, F.bround(v / scale * side, 0).cast("int")))
    xs, ys = (at(x1, width), at(x2, width)), (at(y1, height), at(y2, height))
    return F.when(F.size(box) == 4, F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)))


def coordinate_system(box: Column, width: Column, height: Column) -> Column:
    """'normalized_0_1000' if no number exceeds 1000 and a side of the image does, else 'pixel'."""
    small = F.array_max(box) <= 1000
    return F.when(small & (F.greatest(width, height) > 1000), F.lit("normalized_0_1000")).otherwise(F.lit("pixel"))
