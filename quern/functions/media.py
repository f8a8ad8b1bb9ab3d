"""Plans for image tiles and video frames, from sizes and counts alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col


def grids(least: int, most: int) -> list[tuple[int, int]]:
    """Grids (columns, rows) with least to most tiles, by tile count and then columns."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda g: (g[0] * g[1], g[0]))


def tile_grid(width: Column | str, height: Column | str, least: int = 1, most: int = 12, size: int = 448) -> Column:
    """The grid whose aspect ratio is nearest; of equally near ones, a later one wins only if the image has over half its area.

    Returns a struct (cols, rows).
    """
    w, h = col(width).cast("double"), col(height).cast("double")
    candidates = F.array(*(F.struct(F.lit(i).alias("cols"), F.lit(j).alias("rows")) for i, j in grids(least, most)))
    start = F.struct(F.lit(float("inf")).alias("gap"), F.lit(1).alias("cols"), F.lit(1).alias("rows"))

    def step(best: Column, g: Column) -> Column:
        gap = F.abs(w / h - g["cols"] / g["rows"])
        better = (gap < best["gap"]) | ((gap == best["gap"]) & (w * h > 0.5 * size * size * g["cols"] * g["rows"]))
        return F.when(better, F.struct(gap.alias("gap"), g["cols"].alias("cols"), g["rows"].alias("rows"))).otherwise(best)

    best = F.aggregate(candidates, start, step)
    return F.struct(best["cols"].alias("cols"), best["rows"].alias("rows"))


def tile_count(grid: Column, thumbnail: bool = True) -> Column:
    """Tiles of a grid, with a thumbnail where there is more than one."""
    n = grid["cols"] * grid["rows"]
    return n + F.when(n > 1, 1).otherwise(0) if thumbnail else n


def tile_budget(most: Column | int, images: Column | str, whole: int | None = None) -> Column:
    """Tiles that each of several images may have, at least one."""
    most = F.lit(most) if isinstance(most, int) else most
    if whole is not None:
        return F.greatest(F.lit(1), F.least(most, F.floor(F.lit(whole) / col(images)))).cast("int")
    return F.greatest(F.lit(1), F.floor(most / col(images))).cast("int")


def frame_indices(frames: Column | str, count: Column | int, sample: str = "middle", fps: Column | float | None = None, key: Column | None = None, most: int = 0) -> Column:
    """Indices of sampled frames: the middle (or, by a hash of ``key``, a random place) of equal intervals, padded with the
    last index; or ``fpsX``, the centres of steps of 1 / X seconds at a rate of ``fps``, the last of which may reach past the
    end if its centre does not, and at most ``most`` of them (0: all)."""
    n = col(frames)
    if sample.startswith("fps"):
        rate = float(sample[3:])
        step = F.lit(1 / rate)
        seconds = n / (F.lit(fps) if not isinstance(fps, Column) else fps)
        fps = F.lit(fps) if not isinstance(fps, Column) else fps
        steps = F.ceil(seconds / step).cast("int")
        places = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda i: F.rint((step / 2 + step * i) * fps).cast("int"))
        inside = F.filter(places, lambda p: p < n)
        return F.slice(inside, 1, most) if most > 0 else inside
    count = F.lit(count) if isinstance(count, int) else count
    wanted = F.least(count, n)
    edge = lambda i: F.floor(n * i / wanted).cast("int")

    def place(i: Column) -> Column:
        a, b = edge(i), edge(i + 1) - 1
        if sample == "rand":
            return a + F.pmod(F.xxhash64(key if key is not None else F.lit(0), i), F.greatest(b - a, F.lit(1))).cast("int")
        return F.floor((a + b) / 2).cast("int")

    found = F.transform(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0))), place)
    return F.concat(found, F.array_repeat(F.element_at(found, -1), F.greatest(count - F.size(found), F.lit(0)).cast("int")))


def segment_indices(last: Column | str, segments: int, fps: Column | float, start: Column | float | None = None, end: Column | float | None = None) -> Column:
    """Middle frames of equal segments between two times (seconds); halves round to even."""
    top = col(last)
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    first = F.greatest(F.lit(0.0), F.rint((start if isinstance(start, Column) else F.lit(float(start))) * fps)) if start is not None else F.lit(0.0)
    final = F.least(F.rint((end if isinstance(end, Column) else F.lit(float(end))) * fps), top.cast("double")) if end is not None else top.cast("double")
    size = (final - first) / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.floor(first + size / 2 + F.rint(size * i)).cast("int"))


def image_tokens(tiles: Column, each: int = 256) -> Column:
    return tiles * each
