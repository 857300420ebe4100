"""Cutting tiles from pixel tables, padding, embedding and blank tests.

A pixel names the tiles that it is in, from its coordinates alone, so cutting is a projection (a generator where
tiles overlap) and one aggregation, not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tilemath import idiv, long
from .resample import channel_columns


def region(pixels: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int) -> DataFrame:
    """Pixels of a sub-rectangle, with their own coordinates."""
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > width or y + h > height:
        raise ValueError("region outside the raster")
    return pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def extract(pixels: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int) -> DataFrame:
    """The same with coordinates from 0."""
    return region(pixels, x, y, w, h, width, height).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def rows_of(pixels: DataFrame, *keys: str) -> DataFrame:
    """Scan lines: values in order of x (of one channel, c0)."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "c0"))), lambda p: p["c0"])
    return pixels.groupBy(*keys, "y").agg(line.alias("line"))


def background(pixel_format: str, rgb: tuple[int, int, int] = (255, 255, 255)) -> tuple[int, ...]:
    """Channel values of a background pixel; 16-bit formats repeat the red byte in every byte."""
    r, g, b = rgb
    return {"gray8": (r,), "rgb8": (r, g, b), "rgba8": (r, g, b, 255), "gray16": (r * 257,), "rgb16": (r * 257,) * 3, "rgba16": (r * 257,) * 4}[pixel_format]


def embed(pixels: DataFrame, offset_x: int, offset_y: int, width: int, height: int, fill: tuple[int, ...]) -> DataFrame:
    """Pixels moved onto a dense canvas of background."""
    names = channel_columns(pixels)
    keys = [c for c in pixels.columns if c not in (*names, "x", "y")]
    moved = pixels.withColumns({"x": F.col("x") + offset_x, "y": F.col("y") + offset_y})
    grid = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).select()
    grid = grid.withColumn("y", F.explode(F.sequence(long(0), long(height - 1)))).withColumn("x", F.explode(F.sequence(long(0), long(width - 1))))
    return grid.join(moved, [*keys, "y", "x"], "left").select(*keys, "y", "x", *(F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in zip(names, fill)))


def cut(pixels: DataFrame, width: Column | int, height: Column | int, tile_size: int, overlap: int = 0) -> DataFrame:
    """Pixels with the tile (col, row) that they are in, once for each; width and height of the level."""

    def spread(df: DataFrame, name: str, at: str, size: Column | int) -> DataFrame:
        last = idiv(long(size) - 1, tile_size)
        if not overlap:
            return df.withColumn(name, idiv(F.col(at), tile_size))
        from_ = F.greatest(long(0), F.floor((F.col(at) - overlap) / tile_size))
        return df.withColumn(name, F.explode(F.sequence(from_, F.least(last, idiv(F.col(at) + overlap, tile_size)))))

    return spread(spread(pixels, "col", "x", width), "row", "y", height)


def tile_stats(pixels: DataFrame, width: int, height: int, tile_size: int, overlap: int = 0, google: bool = False, fill: tuple[int, ...] | None = None, tolerance: int = 0, sample_bytes: int = 1) -> DataFrame:
    """Per tile: w, h as written, n_pad background pixels, channel sums with padding, blank (all pixels within
    tolerance of the first, byte by byte: with sample_bytes 2 either byte of a sample counts by itself). Without overlap,
    and for google always, tiles are padded to tile_size."""
    names = channel_columns(pixels)
    keys = [c for c in pixels.columns if c not in (*names, "x", "y")]
    fill = fill or (255,) * len(names)
    overlap = 0 if google else overlap
    own = cut(pixels, width, height, tile_size, overlap)
    byte = lambda c, i: idiv(F.col(c), 256**i) % 256 if sample_bytes > 1 else F.col(c)
    each = [(f"{c}_{i}", byte(c, i), v // 256**i % 256 if sample_bytes > 1 else v) for c, v in zip(names, fill) for i in range(sample_bytes)]
    per = own.groupBy(*keys, "col", "row").agg(
        F.count("*").alias("n"),
        (F.max("x") - F.min("x") + 1).cast("long").alias("w0"),
        (F.max("y") - F.min("y") + 1).cast("long").alias("h0"),
        *(F.sum(c).alias(f"sum_{c}") for c in names),
        *(a for c, x, _ in each for a in (F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.min_by(x, F.struct("y", "x")).alias(f"first_{c}"))),
    )
    padded = google or overlap == 0
    area = long(tile_size * tile_size) if padded else F.col("n")
    pad = area - F.col("n")

    def near(c: str, v: int) -> Column:
        low = F.when(pad > 0, F.least(F.col(f"min_{c}"), F.lit(v))).otherwise(F.col(f"min_{c}"))
        high = F.when(pad > 0, F.greatest(F.col(f"max_{c}"), F.lit(v))).otherwise(F.col(f"max_{c}"))
        return (high - F.col(f"first_{c}") <= tolerance) & (F.col(f"first_{c}") - low <= tolerance)

    blank = F.lit(True)
    for c, _, v in each:
        blank = blank & near(c, v)
    size = lambda c: long(tile_size) if padded else F.col(c)
    return per.select(*keys, "col", "row", size("w0").alias("w"), size("h0").alias("h"), pad.alias("n_pad"), *((F.col(f"sum_{c}") + pad * v).cast("long").alias(f"sum_{c}") for c, v in zip(names, fill)), blank.alias("blank"))


def blank_strategy(blank: Column, strategy: str) -> Column:
    """What counts as blank under emit, placeholder or placeholder_with_tolerance (blank already has the tolerance)."""
    if strategy not in ("emit", "placeholder", "placeholder_with_tolerance"):
        raise ValueError(f"unknown blank strategy: {strategy}")
    return F.lit(False) if strategy == "emit" else blank


def level_counts(tiles: DataFrame, planned: DataFrame) -> DataFrame:
    """Manifest counters: tiles (image_id, level, blank) against planned levels (image_id, level, cols, rows). Blank
    tiles, and those of the plan that were not written, count as skipped."""
    made, blanks = F.coalesce("made", F.lit(0)), F.least(F.coalesce("blanks", F.lit(0)), F.coalesce("made", F.lit(0)))
    return planned.select("image_id", "level", (F.col("cols") * F.col("rows")).alias("total")).join(
        tiles.groupBy("image_id", "level").agg(F.count("*").alias("made"), F.count_if("blank").alias("blanks")), ["image_id", "level"], "left"
    ).select("image_id", "level", (made - blanks).cast("long").alias("tiles_produced"), (blanks + F.greatest(F.lit(0), F.col("total") - made)).cast("long").alias("tiles_skipped"))
