"""Raster inputs as pixel and block tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tilemath import idiv, long


def test_pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """RGB8: R = x*255/w, G = y*255/h, B = (x+y)*255/(w+h), by integer division."""
    grid = spark.range(width * height).select(idiv(F.col("id"), width).alias("y"), (F.col("id") % width).alias("x"))
    return grid.select("y", "x", idiv(F.col("x") * 255, max(width, 1)).alias("c0"), idiv(F.col("y") * 255, max(height, 1)).alias("c1"), idiv((F.col("x") + F.col("y")) * 255, max(width + height, 1)).alias("c2"))


def embedding_pixels(embeddings: DataFrame, rows: int | None = None) -> DataFrame:
    """A grey raster: a row for each vector, a column for each component."""
    at = embeddings.select(long(F.col("vec_id")).alias("y"), F.posexplode("embedding").alias("x", "e"))
    return at.select("y", long(F.col("x")).alias("x"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("long").alias("c0"))


def density_pixels(points: DataFrame, x: str, y: str, width: int, height: int) -> DataFrame:
    """A grey raster of counts, at most 255, zero where there are none."""
    spark = points.sparkSession
    grid = spark.range(width * height).select(idiv(F.col("id"), width).alias("y"), (F.col("id") % width).alias("x"))
    counts = points.groupBy((F.col(y) % height).cast("long").alias("y"), (F.col(x) % width).cast("long").alias("x")).agg(F.least(F.lit(255), F.count("*")).cast("long").alias("c0"))
    return grid.join(counts, ["y", "x"], "left").select("y", "x", F.coalesce("c0", F.lit(0)).cast("long").alias("c0"))


def test_raster(width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return np.stack((x * 255 // max(width, 1), y * 255 // max(height, 1), (x + y) * 255 // max(width + height, 1)), axis=2).astype(np.uint8)


class StripSource(DataSource):
    """A raster as horizontal strips, one for each partition. Options: width, height, strip_height, image_id.

    render_strip may be replaced by a subclass that renders pages; strips beyond the raster are all zero.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_strips"

    def schema(self) -> str:
        return "image_id string, level long, y0 long, x0 long, h long, w long, pixel_format string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return StripReader(dict(self.options))


class StripReader(DataSourceReader):
    def __init__(self, options: dict):
        self.width, self.height = int(options["width"]), int(options["height"])
        self.strip, self.image = int(options.get("strip_height", options.get("stripHeight", 256))), options.get("image_id", "image")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in range(0, self.height, self.strip)]

    def render_strip(self, y: int, h: int) -> np.ndarray:
        if y >= self.height:
            return np.zeros((h, self.width, 3), np.uint8)
        x = np.arange(self.width)[None, :]
        rows = np.arange(y, y + h)[:, None]
        w, t = max(self.width, 1), max(self.height, 1)
        parts = np.broadcast_arrays(x * 255 // w, rows * 255 // t, (x + rows) * 255 // max(self.width + self.height, 1))
        return np.stack(parts, axis=2).astype(np.uint8)

    def read(self, partition: InputPartition):
        y = partition.value
        h = min(self.strip, self.height - y)
        yield (self.image, 0, y, 0, h, self.width, "rgb8", self.render_strip(y, h).tobytes())
