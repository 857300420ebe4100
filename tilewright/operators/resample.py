"""Down-scaling on pixel tables (image_id, y, x, c0, c1, ...) and on blocks of pixels.

Pixel tables aggregate with partial sums before the shuffle. Block tables need none: a block that begins at a
multiple of 2^k holds all that k halvings of its pixels need, so a whole cascade runs inside a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.tilemath import ceil_div, idiv, long

BLOCK_SCHEMA = "image_id string, level long, y0 long, x0 long, h long, w long, pixel_format string, data binary"
#: name: (channels, little-endian type)
DTYPES = {"gray8": (1, "u1"), "gray16": (1, "<u2"), "rgb8": (3, "u1"), "rgba8": (4, "u1"), "rgb16": (3, "<u2"), "rgba16": (4, "<u2")}


def channel_columns(pixels: DataFrame) -> list[str]:
    return sorted(c for c in pixels.columns if c[:1] == "c" and c[1:].isdigit())


def halve(pixels: DataFrame, alpha: bool = False) -> DataFrame:
    """2x2 boxes, edges with what there is of them. Without alpha the mean is rounded half up; with alpha (the last
    channel) colours are weighted by it and truncated, and a transparent box is all zero."""
    names = channel_columns(pixels)
    keys = [c for c in pixels.columns if c not in (*names, "x", "y")]
    own = [*keys, idiv(F.col("y"), 2).alias("y"), idiv(F.col("x"), 2).alias("x")]
    if not alpha:
        rounded = [idiv(F.sum(c) + idiv(F.count("*"), 2), F.count("*")).alias(c) for c in names]
        return pixels.groupBy(*own).agg(*rounded)
    *colours, a = names
    sums = pixels.groupBy(*own).agg(F.count("*").alias("__n"), F.sum(a).cast("double").alias("__a"), *(F.sum(F.col(a) * F.col(c)).cast("double").alias(c) for c in colours))
    mean = F.col("__a") / F.col("__n")
    clear = F.col("__a") == 0
    return sums.select(
        *keys, "y", "x", *(F.when(clear, 0).otherwise((F.col(c) / (F.col("__n") * mean)).cast("long")).cast("long").alias(c) for c in colours), mean.cast("long").alias(a)
    )


def cascade(pixels: DataFrame, times: int, alpha: bool = False, top: int = 0) -> DataFrame:
    """The pixels at level `top` and `times` levels below, each halved from the one above."""
    now, out = pixels, pixels.withColumn("level", long(top))
    for k in range(1, times + 1):
        now = halve(now, alpha)
        out = out.unionByName(now.withColumn("level", long(top - k)))
    return out


def downscale_to(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Rounded means over the source spans of each target pixel. A source pixel names its targets itself (spans
    overlap where sizes don't divide), so there is no range join."""
    if min(width, height, to_width, to_height) <= 0:
        raise ValueError("zero dimension")
    names = channel_columns(pixels)
    keys = [c for c in pixels.columns if c not in (*names, "x", "y")]
    span = lambda c, own, to: F.explode(F.sequence(idiv(F.col(c) * to, own), ceil_div((long(F.col(c)) + 1) * to, own) - 1))
    dealt = pixels.withColumn("__x", span("x", width, to_width)).withColumn("__y", span("y", height, to_height))
    rounded = [idiv(F.sum(c) + idiv(F.count("*"), 2), F.count("*")).alias(c) for c in names]
    return dealt.groupBy(*keys, F.col("__y").alias("y"), F.col("__x").alias("x")).agg(*rounded)


# -- blocks ---------------------------------------------------------------------------------------


def halve_array(x: np.ndarray, alpha: bool) -> np.ndarray:
    """(h, w, channels) -> half, by the same rules."""
    h, w, c = x.shape
    y = np.zeros((h + h % 2, w + w % 2, c), np.int64)
    y[:h, :w] = x
    n = np.zeros((h + h % 2, w + w % 2), np.int64)
    n[:h, :w] = 1
    box = lambda z: z[0::2, 0::2] + z[1::2, 0::2] + z[0::2, 1::2] + z[1::2, 1::2]
    n = box(n)[..., None]
    if not alpha:
        return ((box(y) + n // 2) // n).astype(x.dtype)
    a = box(y[..., -1:]).astype(np.float64)
    mean = a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        colour = np.where(a == 0, 0, box(y[..., :-1] * y[..., -1:]).astype(np.float64) / (n * mean))
    return np.concatenate((np.trunc(colour), np.trunc(mean)), axis=2).astype(x.dtype)


def to_array(data: bytes, h: int, w: int, pixel_format: str) -> np.ndarray:
    channels, kind = DTYPES[pixel_format]
    return np.frombuffer(data, kind).reshape(h, w, channels)


def block_cascade(blocks: DataFrame, times: int) -> DataFrame:
    """Each block and its `times` halvings, without a shuffle. y0 and x0 must be multiples of 2^times, and so must h
    and w except at the image's edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.y0 | r.x0) % (1 << times):
                    raise ValueError(f"block at {r.y0}, {r.x0} is not aligned to {1 << times}")
                x, rows = to_array(r.data, r.h, r.w, r.pixel_format), [r]
                for k in range(1, times + 1):
                    x = halve_array(x, r.pixel_format.startswith("rgba"))
                    rows.append(r._replace(level=r.level - k, y0=r.y0 >> k, x0=r.x0 >> k, h=x.shape[0], w=x.shape[1], data=x.tobytes()))
                yield pd.DataFrame(rows)

    return blocks.mapInPandas(run, BLOCK_SCHEMA)


def block_pixels(blocks: DataFrame, channels: int) -> DataFrame:
    """Blocks as a pixel table."""
    names = [f"c{i}" for i in range(channels)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = to_array(r.data, r.h, r.w, r.pixel_format).astype(np.int64)
                y, z = np.mgrid[0 : r.h, 0 : r.w]
                yield pd.DataFrame({"image_id": r.image_id, "level": r.level, "y": y.ravel() + r.y0, "x": z.ravel() + r.x0} | {n: x[..., i].ravel() for i, n in enumerate(names)})

    return blocks.mapInPandas(run, "image_id string, level long, y long, x long, " + ", ".join(f"{n} long" for n in names))


def concat_vertical(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1:] != b.shape[1:]:
        raise ValueError("strips differ in width or channels")
    return np.vstack((a, b))
