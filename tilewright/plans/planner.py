"""Pyramid planning: images -> plan -> levels -> tiles, each a projection or a generator, without a shuffle (but for spread).

images: image_id, width, height, tile_size, overlap, layout (deep_zoom, xyz, google), centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tilemath import bytes_per_pixel, ceil_div, ceil_half, ceil_log2, idiv, long, power2, tile_path

IMAGES_A_TASK = 20_000


def validated(images: DataFrame) -> DataFrame:
    """images, raising on a row that has no plan."""
    fault = (
        F.when((F.col("width") <= 0) | (F.col("height") <= 0), "zero image dimension")
        .when(F.col("tile_size") <= 0, "zero tile size")
        .when((F.col("overlap") < 0) | (F.col("overlap") >= F.col("tile_size")), "overlap is not below tile size")
        .when(~F.col("layout").isin("deep_zoom", "xyz", "google"), "unknown layout")
    )
    return images.withColumn("layout", F.when(fault.isNull(), F.col("layout")).otherwise(F.raise_error(F.concat(fault, F.lit(" in image "), F.col("image_id").cast("string")))))


def is_valid() -> Column:
    return (F.col("width") > 0) & (F.col("height") > 0) & (F.col("tile_size") > 0) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("tile_size"))


def spread(images: DataFrame) -> DataFrame:
    """images, which are counted, dealt to tasks of about IMAGES_A_TASK, two for each core at least: a row becomes tens of
    tiles, but one task reads all of a file's row group, and Spark would merge partitions that are small as yet."""
    n = max(2 * images.sparkSession.sparkContext.defaultParallelism, -(-images.count() // IMAGES_A_TASK))
    return images.repartition(n, "image_id")


def plan(images: DataFrame) -> DataFrame:
    """images with n_levels, canvas_width, canvas_height, offset_x, offset_y."""
    w, h, ts, google = long(F.col("width")), long(F.col("height")), long(F.col("tile_size")), F.col("layout") == "google"
    cols, rows = ceil_div(w, ts), ceil_div(h, ts)
    grid = F.greatest(cols, rows)
    levels = F.when(google, ceil_log2(grid) + 1).otherwise(ceil_log2(F.greatest(w, h)) + 1)
    square = ts * power2(ceil_log2(grid))
    side = lambda own, tiles: F.when(google, square).when(F.col("centre"), tiles * ts).otherwise(own)
    out = images.withColumns({"n_levels": levels.cast("long"), "canvas_width": side(w, cols), "canvas_height": side(h, rows)})
    off = lambda canvas, own: F.when(F.col("centre"), idiv(F.col(canvas) - own, 2)).otherwise(long(0))
    return out.withColumns({"offset_x": off("canvas_width", w), "offset_y": off("canvas_height", h)})


def canvas_dimensions(planned: DataFrame) -> DataFrame:
    """As a caller asks before planning: the image's own size unless centred, also for google."""
    own = lambda canvas, size: F.when(F.col("centre"), F.col(canvas)).otherwise(long(F.col(size)))
    return planned.select("image_id", own("canvas_width", "width").alias("canvas_width"), own("canvas_height", "height").alias("canvas_height"))


def levels(planned: DataFrame) -> DataFrame:
    """A row for each level (0 the smallest): level_width, level_height, cols, rows, level_canvas_*, level_offset_*."""
    out = planned.withColumn("level", F.explode(F.sequence(long(0), F.col("n_levels") - 1)))
    google, down = F.col("layout") == "google", F.col("n_levels") - 1 - F.col("level")
    out = out.withColumns({"level_width": ceil_half(F.col("width"), down), "level_height": ceil_half(F.col("height"), down)})
    grid = lambda side: F.when(google, power2(F.col("level"))).otherwise(ceil_div(F.col(side), F.col("tile_size")))
    canvas = lambda side: F.when(google, long(F.col("tile_size")) * power2(F.col("level"))).otherwise(F.col(side))
    shifted = lambda c: F.call_function("shiftright", F.col(c), down.cast("int"))
    return out.withColumns(
        {"cols": grid("level_width"), "rows": grid("level_height"), "level_canvas_width": canvas("level_width"), "level_canvas_height": canvas("level_height"), "level_offset_x": shifted("offset_x"), "level_offset_y": shifted("offset_y")}
    )


def totals(levelled: DataFrame) -> DataFrame:
    return levelled.groupBy("image_id").agg(F.count("*").alias("level_count"), F.sum(F.col("cols") * F.col("rows")).alias("total_tiles"))


def tiles(levelled: DataFrame) -> DataFrame:
    """A row for each tile: col, row and its rectangle x, y, w, h in level space (overlap ignored for google)."""
    upto = lambda n: F.sequence(long(0), F.col(n) - 1)
    out = levelled.withColumn("row", F.explode(upto("rows"))).withColumn("col", F.explode(upto("cols")))
    ts, ov, google = long(F.col("tile_size")), long(F.col("overlap")), F.col("layout") == "google"

    def side(index: str, size: str) -> tuple[Column, Column]:
        at = F.col(index) * ts
        begin = F.when(google, at).otherwise(F.when(F.col(index) == 0, long(0)).otherwise(at - ov))
        end = F.when(google, at + ts).otherwise(F.least(at + ts + ov, F.col(size)))
        return begin, end - begin

    (x, w), (y, h) = side("col", "level_width"), side("row", "level_height")
    return out.withColumns({"x": x, "y": y, "w": w, "h": h})


def paths(tiled: DataFrame, extension: str = "png") -> DataFrame:
    return tiled.withColumn("path", tile_path(F.col("layout"), F.col("level"), F.col("col"), F.col("row"), F.lit(extension)))


# -- estimates ------------------------------------------------------------------------------------


def peak_memory() -> Column:
    """Bytes of an in-memory run over RGBA pixels, from a planned row."""
    own, canvas = long(F.col("width")) * F.col("height") * 4, F.col("canvas_width") * F.col("canvas_height") * 4
    same = ~F.col("centre") | (F.col("canvas_width") == F.col("width")) & (F.col("canvas_height") == F.col("height"))
    return F.when(same, own * 2).otherwise(own + canvas)


def peak_memory_for(pixel_format: Column) -> Column:
    canvas = F.col("canvas_width") * F.col("canvas_height") * bytes_per_pixel(pixel_format)
    return canvas + idiv(canvas, 4)


def strip_memory(pixel_format: Column, strip_height: Column) -> Column:
    """Bytes of a strip-wise run: two buffers at each level until a side is one pixel, that level once, and a tenth."""
    w, h, bpp = F.col("canvas_width"), long(strip_height), bytes_per_pixel(pixel_format)
    last = F.greatest(F.lit(1).cast("long"), F.least(ceil_log2(w), ceil_log2(h)))
    area = lambda k: ceil_half(w, k) * ceil_half(h, k) * bpp
    total = F.aggregate(F.sequence(long(0), last - 1), long(0), lambda acc, k: acc + 2 * area(k)) + area(last)
    return total + idiv(total, 10)


def strip_height(pixel_format: Column, budget: Column) -> Column:
    """Greatest multiple of two tile rows within budget and canvas; null if there is none."""
    unit = 2 * long(F.col("tile_size"))
    units = idiv(budget, strip_memory(pixel_format, unit))
    tall = idiv(F.least(units * unit, F.col("canvas_height")), unit) * unit
    return F.when(tall > 0, tall)


def monolithic_level(levelled: DataFrame, pixel_format: str, strip: Column) -> DataFrame:
    """Per image: threshold (the highest level whose raster is no larger than a strip, else 0), and the run's fixed and strip bytes."""
    bpp, h = bytes_per_pixel(F.lit(pixel_format)), long(strip)
    size = F.col("level_canvas_width") * F.col("level_canvas_height") * bpp
    wide = F.col("canvas_width") * bpp
    own = levelled.withColumns({"__bytes": size, "__strip": wide * h, "__two_rows": wide * F.col("tile_size") * 2, "__h": h})
    per = own.groupBy("image_id").agg(
        F.coalesce(F.max(F.when(F.col("__bytes") <= F.col("__strip"), F.col("level"))), long(0)).alias("threshold"),
        F.coalesce(F.max_by("__bytes", F.when(F.col("__bytes") <= F.col("__two_rows"), F.col("level"))), long(0)).alias("__mono"),
        F.max("__strip").alias("strip_bytes"),
        F.max("canvas_width").alias("__w"),
        F.max("__h").alias("__h"),
        F.max("level").alias("__top"),
    )
    held = F.aggregate(
        F.filter(F.sequence(long(0), F.col("__top")), lambda k: F.col("__top") - k > F.col("threshold")), long(0), lambda acc, k: acc + ceil_half(F.col("__w"), k) * ceil_div(ceil_half(F.col("__h"), k), 2) * bpp
    )
    return per.select("image_id", "threshold", "strip_bytes", (held + F.col("__mono")).alias("fixed_bytes"))


def inflight_strips(budget: Column) -> Column:
    """From strip_bytes and fixed_bytes; at least 1."""
    return F.greatest(long(1), idiv(F.greatest(long(0), budget - F.col("fixed_bytes")), F.greatest(long(1), F.col("strip_bytes"))))


def parallel_memory(strips: Column) -> Column:
    peak = strips * F.col("strip_bytes") + F.col("fixed_bytes")
    return peak + idiv(peak, 10)
