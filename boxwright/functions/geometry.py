"""Box geometry as column expressions; boxes are corner coordinates x1, y1, x2, y2 as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _z() -> Column:
    return F.lit(0.0)


def corners(prefix: str = "") -> Box:
    """The box in columns named prefix + x1 and so on."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def fields(struct: Column) -> Box:
    return tuple(struct[c] for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(box: Box) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(_z(), x2 - x1) * F.greatest(_z(), y2 - y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty. Negative extents count as none."""
    width = F.greatest(_z(), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(_z(), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inner = width * height
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(_z())


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def xyxy_to_xywh(box: Box) -> Box:
    x1, y1, x2, y2 = box
    return x1, y1, F.greatest(_z(), x2 - x1), F.greatest(_z(), y2 - y1)


def clip(box: Box, width: Column, height: Column) -> Box:
    """The part of the box inside an image of this size."""
    inside = lambda v, most: F.least(F.greatest(v, _z()), most.cast("double"))
    return inside(box[0], width), inside(box[1], height), inside(box[2], width), inside(box[3], height)


def not_degenerate(box: Box) -> Column:
    return (box[2] > box[0]) & (box[3] > box[1])
