"""Affine geo-referencing as columns. A transform is a STRUCT of doubles a..f: x = a*px + b*py + c, y = d*px + e*py + f."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SINGULAR = 1e-12
NAMES = "abcdef"


def transform(*values) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(NAMES, values)))


def from_origin_and_scale(x, y, scale_x, scale_y) -> Column:
    return transform(scale_x, 0.0, x, 0.0, scale_y, y)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def pixel_to_geo(t: Column, x: Column, y: Column) -> Column:
    return point(t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"])


def determinant(t: Column) -> Column:
    return t["a"] * t["e"] - t["b"] * t["d"]


def inverse(t: Column) -> Column:
    """Null if the transform is singular."""
    scale = F.lit(1.0) / F.when(F.abs(determinant(t)) >= SINGULAR, determinant(t))
    a, b, d, e = t["e"] * scale, -t["b"] * scale, -t["d"] * scale, t["a"] * scale
    return F.when(scale.isNotNull(), transform(a, b, -(a * t["c"] + b * t["f"]), d, e, -(d * t["c"] + e * t["f"])))


def geo_to_pixel(t: Column, x: Column, y: Column) -> Column:
    """Null if the transform is singular."""
    scale = F.lit(1.0) / F.when(F.abs(determinant(t)) >= SINGULAR, determinant(t))
    dx, dy = x - t["c"], y - t["f"]
    return F.when(scale.isNotNull(), point((t["e"] * dx - t["b"] * dy) * scale, (t["a"] * dy - t["d"] * dx) * scale))


def from_control_points(pixels: list[tuple[Column, Column]], geos: list[tuple[Column, Column]]) -> Column:
    """The transform through three control points (Cramer's rule); null if they are collinear."""
    (x0, y0), (x1, y1), (x2, y2) = pixels
    det = x0 * (y1 - y2) - x1 * (y0 - y2) + x2 * (y0 - y1)
    scale = F.lit(1.0) / F.when(F.abs(det) >= SINGULAR, det)

    def row(g0, g1, g2):
        return (
            (g0 * (y1 - y2) - g1 * (y0 - y2) + g2 * (y0 - y1)) * scale,
            (x0 * (g1 - g2) - x1 * (g0 - g2) + x2 * (g0 - g1)) * scale,
            (x0 * (y1 * g2 - y2 * g1) - x1 * (y0 * g2 - y2 * g0) + x2 * (y0 * g1 - y1 * g0)) * scale,
        )

    return F.when(scale.isNotNull(), transform(*row(*(g for g, _ in geos)), *row(*(g for _, g in geos))))


def image_bounds(t: Column, width: Column, height: Column) -> Column:
    """STRUCT min_x, min_y, max_x, max_y over the four corners."""
    zero = F.lit(0.0)
    corners = [pixel_to_geo(t, x, y) for x in (zero, width) for y in (zero, height)]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def tile_centre(t: Column, col: Column, row: Column, tile_size: Column) -> Column:
    return pixel_to_geo(t, (col + 0.5) * tile_size, (row + 0.5) * tile_size)


def contains(bounds: Column, x: Column, y: Column) -> Column:
    """Edges included."""
    return x.between(bounds["min_x"], bounds["max_x"]) & y.between(bounds["min_y"], bounds["max_y"])


def extent(bounds: Column) -> Column:
    """STRUCT width, height, centre_x, centre_y."""
    b = bounds
    return F.struct((b["max_x"] - b["min_x"]).alias("width"), (b["max_y"] - b["min_y"]).alias("height"), ((b["min_x"] + b["max_x"]) / 2).alias("centre_x"), ((b["min_y"] + b["max_y"]) / 2).alias("centre_y"))
