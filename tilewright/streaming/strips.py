"""Strips of a raster that arrive one at a time, top to bottom, as a stream of blocks.

Each strip is halved where it arrives (strips begin at even rows), so only pairing its halves needs state: the
first of a pair waits, keyed by image, level and pair; when the second comes both are stacked in the order of
their index, not of arrival. Where the number of an image's strips is known, the last one of an odd count goes out alone
as it comes; else it stays in the state, for a stream has no end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tilemath import idiv
from ..operators.resample import concat_vertical, halve_array, to_array

STRIP_SCHEMA = "image_id string, level long, strip long, h long, w long, pixel_format string, data binary"
PAIR_SCHEMA = "image_id string, level long, pair long, h long, w long, pixel_format string, data binary"


def halved(strips: DataFrame) -> DataFrame:
    """Strips of an even height (but for an image's last), each halved; level one lower."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                x = halve_array(to_array(r.data, r.h, r.w, r.pixel_format), r.pixel_format.startswith("rgba"))
                rows.append(r._replace(level=r.level - 1, h=x.shape[0], w=x.shape[1], data=x.tobytes()))
            yield pd.DataFrame(rows, columns=batch.columns)

    return strips.mapInPandas(run, STRIP_SCHEMA)


def stacked(parts: list[tuple]) -> tuple[int, int, str, bytes]:
    """(strip, h, w, pixel_format, data) of one pair, in any order -> (h, w, pixel_format, data)."""
    arrays = [to_array(d, h, w, f) for _, h, w, f, d in sorted(parts)]
    x = arrays[0] if len(arrays) == 1 else concat_vertical(*arrays[:2])
    return x.shape[0], x.shape[1], parts[0][3], np.ascontiguousarray(x).tobytes()


def paired(strips: DataFrame) -> DataFrame:
    """Batch form: strips 2i and 2i + 1 of an image and level stacked; a last one without partner stays alone."""

    def run(key, batch: pd.DataFrame) -> pd.DataFrame:
        h, w, f, data = stacked(list(batch[["strip", "h", "w", "pixel_format", "data"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(*key, h, w, f, data)], columns=["image_id", "level", "pair", "h", "w", "pixel_format", "data"])

    return strips.groupBy("image_id", "level", idiv(F.col("strip"), 2).alias("pair")).applyInPandas(run, PAIR_SCHEMA)


class Pairing(StatefulProcessor):
    """Streaming form of paired(), for transformWithStateInPandas grouped by image_id, level, pair."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "strip long, h long, w long, pixel_format string, data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, alone = [tuple(self.waiting.get())] if self.waiting.exists() else [], False
        for batch in rows:
            alone = alone or bool(((batch["strip"] + 1 == batch["n_strips"]) & (batch["strip"] % 2 == 0)).any())
            parts += batch[["strip", "h", "w", "pixel_format", "data"]].itertuples(index=False, name=None)
        if len(parts) < 2 and not alone:
            self.waiting.update(parts[0])
            return
        self.waiting.clear()
        yield pd.DataFrame([(*key, *stacked(parts))], columns=["image_id", "level", "pair", "h", "w", "pixel_format", "data"])

    def close(self) -> None:
        pass


def paired_stream(strips: DataFrame, n_strips: Column | None = None) -> DataFrame:
    """n_strips: how many strips the strip's image has, if known."""
    keyed = strips.withColumns({"pair": idiv(F.col("strip"), 2), "n_strips": F.lit(None).cast("long") if n_strips is None else n_strips.cast("long")})
    return keyed.groupBy("image_id", "level", "pair").transformWithStateInPandas(Pairing(), PAIR_SCHEMA, "append", "none")


def blocks_of(strips: DataFrame, strip_height: int) -> DataFrame:
    return strips.select("image_id", "level", (F.col("strip") * strip_height).alias("y0"), F.lit(0).cast("long").alias("x0"), "h", "w", "pixel_format", "data")
