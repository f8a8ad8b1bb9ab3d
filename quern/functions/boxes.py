"""Boxes in texts and their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col

NUMBER_PATTERN = r"\s*(-?\d+\.?\d*)\s*"


def parse_box(text: Column | str, width: Column, height: Column) -> Column:
    """The last [x, y, x, y] of the text in pixels: thousandths where the numbers sum to 4 or more, shares otherwise; zeros
    where there is none."""
    found = F.regexp_extract_all(col(text), F.lit(r"\[\[?" + ",".join([NUMBER_PATTERN] * 4) + r"\]?\]"), F.lit(0))
    parts = F.transform(F.regexp_extract_all(F.element_at(found, -1), F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))
    box = F.when(F.size(found) > 0, parts).otherwise(F.array(*[F.lit(0.0)] * 4))
    total = F.aggregate(box, F.lit(0.0), lambda s, x: s + x)
    return F.transform(box, lambda x, i: F.when(total >= 4, x / 1000).otherwise(x) * F.when(i % 2 == 0, width).otherwise(height))


def parse_box_json(text: Column | str, width: Column, height: Column) -> Column:
    """The first box of a JSON list of boxes, thousandths to pixels, kept inside the image; null where there is none."""
    box = F.get(F.from_json(col(text), "array<array<double>>"), F.lit(0))
    inside = F.transform(box, lambda x, i: F.greatest(F.lit(0.0), F.least(F.when(i % 2 == 0, width).otherwise(height), F.floor(x / 1000 * F.when(i % 2 == 0, width).otherwise(height)))))
    return F.when(F.size(box) == 4, inside)


def _overlap(a: Column, b: Column, extra: int) -> Column:
    x1, y1, x2, y2 = (F.get(a, F.lit(i)) for i in range(4))
    u1, v1, u2, v2 = (F.get(b, F.lit(i)) for i in range(4))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(x2, u2) - F.greatest(x1, u1) + extra) * F.greatest(zero, F.least(y2, v2) - F.greatest(y1, v1) + extra)
    area = lambda p, q, r, s: (r - p + extra) * (s - q + extra)
    return F.coalesce(F.try_divide(inter, area(x1, y1, x2, y2) + area(u1, v1, u2, v2) - inter), zero)


def iou(a: Column | str, b: Column | str) -> Column:
    return _overlap(col(a), col(b), 0)


def iou_pixels(a: Column | str, b: Column | str) -> Column:
    """Overlap of boxes whose last pixel belongs to them."""
    return _overlap(col(a), col(b), 1)


def remap_tags(text: Column | str, offsets: dict[str, tuple[float, float]], scale: tuple[float, float]) -> Column:
    """Coordinates of <id,CAMERA,x,y> tags moved to the camera's place on a grid and scaled to thousandths."""
    out = col(text)
    for camera, (dx, dy) in offsets.items():
        pattern = rf"<([^,<>]*),{camera},(-?\d+\.?\d*),(-?\d+\.?\d*)>"
        tags = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
        moved = lambda tag: F.format_string(
            f"<%s,{camera},%s,%s>", F.regexp_extract(tag, pattern, 1),
            F.rint((F.regexp_extract(tag, pattern, 2).cast("double") + dx) / scale[0] * 1000).cast("int").cast("string"),
            F.rint((F.regexp_extract(tag, pattern, 3).cast("double") + dy) / scale[1] * 1000).cast("int").cast("string"))
        pieces = F.split(out, pattern, -1)
        out = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(tags), moved(F.get(tags, i))).otherwise(""))), "")
    return out
