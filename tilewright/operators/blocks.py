"""Blocks of a raster dealt anew: to squares that begin at multiples of a side, with a margin of their neighbours'
pixels, at an offset on a canvas. A source block names the squares that it touches from its own place, so this is one
equi-join by square (an aggregation of pieces), never a whole level in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .resample import BLOCK_SCHEMA, to_array

#: A block with its margin (y0, x0, h, w, data) and the part of it that is its own.
CORE_SCHEMA = BLOCK_SCHEMA + ", core_y long, core_x long, core_h long, core_w long"
PIECE_SCHEMA = "image_id string, level long, by long, bx long, y long, x long, h long, w long, pixel_format string, data binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def cored(blocks: DataFrame) -> DataFrame:
    """Blocks without a margin."""
    return blocks.withColumns({"core_y": F.col("y0"), "core_x": F.col("x0"), "core_h": F.col("h"), "core_w": F.col("w")})


def squares_of(start: int, size: int, side: int, margin: int, most: int) -> range:
    """Squares of `side` that, with their margin, a stretch touches; `most` is the canvas's extent."""
    first = max(0, (start - margin) // side)
    return range(first, min(-(-(start + size + margin) // side), -(-most // side)))


def reblocked(blocks: DataFrame, side: int, margin: int, canvas: tuple[int, int], offset: tuple[int, int] = (0, 0), fill: tuple[int, ...] = (0,), wanted: DataFrame | None = None) -> DataFrame:
    """CORE_SCHEMA rows of the squares that blocks touch; of those in `wanted` (by, bx) alone, if given, filtered before
    pieces are moved. Pixels that no block has are `fill`."""
    width, height = canvas

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = to_array(r.data, r.h, r.w, r.pixel_format)
                top, left, rows = r.y0 + offset[1], r.x0 + offset[0], []
                for by in squares_of(top, r.h, side, margin, height):
                    for bx in squares_of(left, r.w, side, margin, width):
                        y, z = max(top, by * side - margin), max(left, bx * side - margin)
                        part = x[y - top : (by + 1) * side + margin - top, z - left : (bx + 1) * side + margin - left]
                        if part.size:
                            rows.append((r.image_id, r.level, by, bx, y, z, *part.shape[:2], r.pixel_format, np.ascontiguousarray(part).tobytes()))
                for row in rows:
                    yield pd.DataFrame([row], columns=names(PIECE_SCHEMA))

    def assembled(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        image, level, by, bx = key
        y0, x0 = max(0, by * side - margin), max(0, bx * side - margin)
        y1, x1 = min(height, (by + 1) * side + margin), min(width, (bx + 1) * side + margin)
        name = batch["pixel_format"].iloc[0]
        first = to_array(batch["data"].iloc[0], batch["h"].iloc[0], batch["w"].iloc[0], name)
        out = np.broadcast_to(np.array(fill, first.dtype), (y1 - y0, x1 - x0, first.shape[2])).copy()
        for r in batch.itertuples(index=False):
            out[r.y - y0 : r.y - y0 + r.h, r.x - x0 : r.x - x0 + r.w] = to_array(r.data, r.h, r.w, name)
        core = by * side, bx * side, min(side, height - by * side), min(side, width - bx * side)
        return pd.DataFrame([(image, level, y0, x0, y1 - y0, x1 - x0, name, out.tobytes(), *core)], columns=names(CORE_SCHEMA))

    cut = blocks.select(*names(BLOCK_SCHEMA)).mapInPandas(pieces, PIECE_SCHEMA)
    if wanted is not None:
        cut = cut.join(wanted, ["by", "bx"], "left_semi")
    return cut.groupBy("image_id", "level", "by", "bx").applyInPandas(assembled, CORE_SCHEMA)
