"""PyramidJob: a run from source blocks to written tiles, configured fluently and lazy until run().

A run has phases. Each takes squares of one level, halves them in place as often as memory allows, cuts, encodes and
writes the tiles of those levels, and leaves the smallest level in small blocks, from which the next phase's squares
are made. Pixels are computed once: tiles are written where they are cut, and all that the manifest, the counters, the
checkpoint, dedupe and events need is what the writers report.
"""

from __future__ import annotations

import functools
import hashlib
import logging
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing
from ..functions.tilemath import dzi, shared_path
from ..operators import contents
from ..operators.blocks import CORE_SCHEMA, cored, names, reblocked
from ..operators.resample import BLOCK_SCHEMA, DTYPES, halve_array, to_array
from ..operators.tiles import background
from ..sources import sinks
from ..sources.codec import FORMATS, decode, encode
from . import manifest, planner, verification

log = logging.getLogger("tilewright")
ENGINES = ("auto", "monolithic", "streaming", "map_reduce")
BUDGETS = ("error", "auto_adjust")
SQUARE_BYTES = 32 << 20  # of a square that a task holds, its margin aside
TILE_SCHEMA = "image_id string, level long, col long, row long, w long, h long, pixel_format string, data binary, blank boolean, uniform boolean"
#: What a phase makes: tiles, and blocks (kind) of its smallest level for the next one.
MADE_SCHEMA = "kind string, y0 long, x0 long, " + TILE_SCHEMA


@dataclass(frozen=True)
class PyramidJob:
    """One image. Setters return a new job; unknown settings raise at once."""

    width: int
    height: int
    tile_size: int = 256
    overlap: int = 0
    layout: str = "deep_zoom"
    centre: bool = False
    pixel_format: str = "rgb8"
    image_id: str = "image"
    settings: dict = field(default_factory=dict)
    observers: tuple = ()

    def _with(self, **more) -> PyramidJob:
        return replace(self, settings=self.settings | more)

    def _one_of(self, what: str, value: str, allowed) -> str:
        if value not in allowed:
            raise ValueError(f"unknown {what}: {value}")
        return value

    def with_engine(self, name: str) -> PyramidJob:
        return self._with(engine=self._one_of("engine", name, ENGINES))

    def with_observer(self, observe: Callable[[dict], None]) -> PyramidJob:
        return replace(self, observers=(*self.observers, observe))

    def with_failure_policy(self, policy: str) -> PyramidJob:
        return self._with(failures=self._one_of("failure policy", policy, sinks.POLICIES))

    def with_retry(self, max_retries: int, initial_ms: float = 50.0) -> PyramidJob:
        return self._with(max_retries=max_retries, initial_ms=initial_ms, failures=self.settings.get("failures", "retry_then_fail"))

    def with_resume(self, mode: str, checkpoint_every: int = 0, checkpoint_root: str | None = None) -> PyramidJob:
        """overwrite, resume or verify. Each task's finished tiles become durable every so many (0: at its end)."""
        return self._with(resume=self._one_of("resume mode", mode, ("overwrite", "resume", "verify")), checkpoint_every=checkpoint_every, checkpoint_root=checkpoint_root)

    def with_dedupe(self, strategy: str, links: bool = False) -> PyramidJob:
        """none; blanks (uniform tiles); all_content (every digest). links: a repeated tile links to the shared file
        (symbolic, else hard, else the one-byte placeholder); else it is the placeholder."""
        return self._with(dedupe=self._one_of("dedupe strategy", strategy, ("none", "blanks", "all_content")), links=links)

    def with_blank_strategy(self, strategy: str, tolerance: int = 0) -> PyramidJob:
        return self._with(blank=self._one_of("blank strategy", strategy, ("emit", "placeholder", "placeholder_with_tolerance")), tolerance=tolerance)

    def with_background(self, r: int, g: int, b: int) -> PyramidJob:
        return self._with(background=(r, g, b))

    def with_concurrency(self, tasks: int) -> PyramidJob:
        """At most so many tasks at a time write a phase; 0: as Spark has it."""
        return self._with(concurrency=tasks)

    def with_buffer_size(self, tiles: int) -> PyramidJob:
        """Tiles that a task hands on at a time."""
        return self._with(buffer_size=max(1, tiles))

    def with_memory_budget(self, bytes_: int, policy: str = "error") -> PyramidJob:
        return self._with(budget=bytes_).with_budget_policy(policy)

    def with_budget_policy(self, policy: str) -> PyramidJob:
        """error: two rows of tiles must fit. auto_adjust: squares shrink instead, to one tile at least."""
        return self._with(budget_policy=self._one_of("budget policy", policy, BUDGETS))

    def with_checksums(self, algorithm: str, mode: str = "emit_only") -> PyramidJob:
        """emit_only, or verify: written files are read and hashed again before the run ends."""
        return self._with(checksums=self._one_of("digest", algorithm, ("blake3", "sha256")), checksum_mode=self._one_of("checksum mode", mode, ("emit_only", "verify")))

    def with_source_hash(self, on: bool = True) -> PyramidJob:
        return self._with(source_hash=on)

    def with_format(self, tile_format: str, quality: int = 80) -> PyramidJob:
        return self._with(tile_format=self._one_of("format", tile_format, FORMATS), quality=quality)

    def with_sink(self, put: Callable[[str, bytes], None] | None) -> PyramidJob:
        """Executors hand tiles to put(path, data), with retries and failures as for files; documents still go to the output
        folder. Dedupe and verification are for files."""
        return self._with(sink=put)

    def with_extension(self, name: str, value) -> PyramidJob:
        return self._with(extensions=self.settings.get("extensions", {}) | {name: value})

    def with_config(self, **settings) -> PyramidJob:
        """Several at once, each by its setter: with_config(engine="streaming", memory_budget=1 << 20)."""
        job = self
        for name, value in settings.items():
            setter = getattr(job, f"with_{name}", None)
            if setter is None:
                raise ValueError(f"unknown setting: {name}")
            job = setter(*value) if isinstance(value, tuple) else setter(value)
        return job

    # -- plan -------------------------------------------------------------------------------------

    def images(self, spark: SparkSession) -> DataFrame:
        row = (self.image_id, self.width, self.height, self.tile_size, self.overlap, self.layout, self.centre)
        return spark.createDataFrame([row], "image_id string, width long, height long, tile_size long, overlap long, layout string, centre boolean")

    @property
    def _pixel_bytes(self) -> int:
        channels, kind = DTYPES[self.pixel_format]
        return channels * np.dtype(kind).itemsize

    def levels(self, spark: SparkSession) -> list:
        """Driver-side: as many rows as the plan has levels."""
        budget, need = self.settings.get("budget"), self.width * 2 * self.tile_size * self._pixel_bytes
        if budget is not None and need > budget and self.settings.get("budget_policy", "error") == "error":
            raise ValueError(f"memory budget exceeded: two tile rows take {need} bytes, the budget is {budget}")
        return planner.levels(planner.plan(planner.validated(self.images(spark)))).orderBy("level").collect()

    def plan_hash(self, spark: SparkSession) -> str:
        levels = self.levels(spark)
        r = levels[0]
        return hashing.plan_hash(self.width, self.height, self.tile_size, self.overlap, self.layout, (r.canvas_width, r.canvas_height), self.centre, (r.offset_x, r.offset_y), [(x.level, x.level_width, x.level_height, x.cols, x.rows) for x in levels])

    def planned(self, spark: SparkSession) -> DataFrame:
        return planner.tiles(planner.levels(planner.plan(self.images(spark)))).select("image_id", "level", "col", "row")

    def _fill(self) -> tuple[int, ...]:
        return background(self.pixel_format, self.settings.get("background", (255, 255, 255)))

    def _extents(self, levels: list) -> dict[int, tuple[int, int]]:
        """Width and height that tiles of each level are cut from."""
        if not self.centre:
            return {r.level: (r.level_width, r.level_height) for r in levels}
        top = levels[-1]
        return {r.level: (_half(top.canvas_width, top.level - r.level), _half(top.canvas_height, top.level - r.level)) for r in levels}

    # -- tiles ------------------------------------------------------------------------------------

    def _halvings(self, level: int) -> int:
        """Halvings inside a square: as many as SQUARE_BYTES and the budget have room for."""
        room = min(SQUARE_BYTES, self.settings.get("budget", SQUARE_BYTES))
        k = min(1, level)
        while k < level and (self.tile_size << (k + 1)) ** 2 * self._pixel_bytes <= room:
            k += 1
        return k

    def _margin(self) -> int:
        return 0 if self.layout == "google" else self.overlap

    def _squares(self, blocks: DataFrame, level: int, levels: list, source: bool, remaining: DataFrame | None) -> tuple[DataFrame, int]:
        """CORE_SCHEMA squares of a level and the halvings that they allow. The source's own blocks serve as they are where
        they begin at multiples of tile_size * 2^k and no tile takes pixels from another; else pixels move once."""
        tile, top = self.tile_size, levels[-1]
        blocks = blocks.withColumn("level", F.lit(level).cast("long"))
        if source and not self.centre and not self._margin():
            at = blocks.select("y0", "x0").agg(F.min(F.when(F.col("y0") > 0, F.col("y0"))).alias("y"), F.min(F.when(F.col("x0") > 0, F.col("x0"))).alias("x")).first()
            steps = [s or (tile << level) for s in at]
            k = min(_aligned(s, tile, level) for s in steps)
            if k >= min(1, level):
                if remaining is not None:
                    wanted = self._wanted(remaining, top.level, *steps).withColumnsRenamed({"by": "y_", "bx": "x_"})
                    own = blocks.withColumns({"y_": F.floor(F.col("y0") / steps[0]), "x_": F.floor(F.col("x0") / steps[1])})
                    blocks = own.join(wanted, ["y_", "x_"], "left_semi").drop("y_", "x_")
                return cored(blocks), k
        k = self._halvings(level)
        side = tile << k
        offset = (top.offset_x, top.offset_y) if source and self.centre else (0, 0)
        wanted = self._wanted(remaining, top.level, side, side) if remaining is not None and source else None
        return reblocked(blocks, side, self._margin() << k, self._extents(levels)[level], offset, self._fill(), wanted), k

    def _wanted(self, remaining: DataFrame, top: int, high: int, wide: int) -> DataFrame:
        """(by, bx) of the top level's squares under the tiles that remain."""
        scale = F.lit(self.tile_size) * F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(top) - F.col("level")).cast("int"))
        upto = lambda c, size: F.sequence(F.floor(F.col(c) * scale / size), F.floor(((F.col(c) + 1) * scale - 1) / size))
        last = lambda extent, size: -(-extent // size)
        extents = self._extents(self.levels(remaining.sparkSession))[top]
        rows = remaining.select(F.filter(upto("row", high), lambda v: v < last(extents[1], high)).alias("ys"), F.filter(upto("col", wide), lambda v: v < last(extents[0], wide)).alias("xs")).distinct()
        return rows.select(F.explode("ys").alias("by"), "xs").distinct().select("by", F.explode("xs").alias("bx")).distinct()

    def _phase(self, squares: DataFrame, halvings: int, levels: list, emit_top: bool) -> DataFrame:
        """MADE_SCHEMA rows: tiles of halvings + 1 levels (without the first unless emit_top), and blocks of the last unless it is 0."""
        job, extents, margin, fill = self, self._extents(levels), self._margin(), self._fill()
        held = self.settings.get("buffer_size", 64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    rows: list[tuple] = []
                    for row in job._made(r, halvings, extents, margin, fill, emit_top):
                        rows.append(row)
                        if len(rows) >= held:
                            yield pd.DataFrame(rows, columns=names(MADE_SCHEMA))
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names(MADE_SCHEMA))

        return squares.select(*names(CORE_SCHEMA)).mapInPandas(run, MADE_SCHEMA)

    def _made(self, r, halvings: int, extents: dict, margin: int, fill: tuple, emit_top: bool) -> Iterator[tuple]:
        if (r.y0 | r.x0) % (1 << halvings):
            raise ValueError(f"block at {r.y0}, {r.x0} is not aligned to {1 << halvings}")
        x, alpha = to_array(r.data, r.h, r.w, r.pixel_format), r.pixel_format.startswith("rgba")
        for k in range(halvings + 1):
            level = r.level - k
            if level < 0:
                return
            if k:
                x = halve_array(x, alpha)
            y0, x0, core_y, core_x = r.y0 >> k, r.x0 >> k, r.core_y >> k, r.core_x >> k
            core_h, core_w = _half(r.core_y + r.core_h, k) - core_y, _half(r.core_x + r.core_w, k) - core_x
            if k or emit_top:
                yield from self._cut(r, level, x, (y0, x0), (core_y, core_x, core_h, core_w), extents[level], margin, fill)
            if k == halvings and level:
                core = np.ascontiguousarray(x[core_y - y0 : core_y - y0 + core_h, core_x - x0 : core_x - x0 + core_w])
                yield ("block", core_y, core_x, r.image_id, level, None, None, core_w, core_h, r.pixel_format, core.tobytes(), False, False)

    def _cut(self, r, level: int, x: np.ndarray, at: tuple, core: tuple, extent: tuple, margin: int, fill: tuple) -> Iterator[tuple]:
        tile, strategy, tolerance = self.tile_size, self.settings.get("blank", "emit"), self.settings.get("tolerance", 0)
        near = tolerance if strategy == "placeholder_with_tolerance" else 0
        for row in range(core[0] // tile, -(-(core[0] + core[2]) // tile)):
            for col in range(core[1] // tile, -(-(core[1] + core[3]) // tile)):
                left, up = max(0, col * tile - margin), max(0, row * tile - margin)
                right, down = min((col + 1) * tile + margin, extent[0]), min((row + 1) * tile + margin, extent[1])
                part = x[up - at[0] : down - at[0], left - at[1] : right - at[1]]
                if (self.layout == "google" or not margin) and part.shape[:2] != (tile, tile):
                    full = np.broadcast_to(np.array(fill, x.dtype), (tile, tile, x.shape[2])).copy()
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                data = np.ascontiguousarray(part)
                own = data.view(np.uint8).reshape(-1, data.shape[2] * data.itemsize).astype(np.int16)
                apart = np.abs(own - own[0]).max()
                yield ("tile", None, None, r.image_id, level, col, row, data.shape[1], data.shape[0], r.pixel_format, data.tobytes(), strategy != "emit" and bool(apart <= near), bool(apart == 0))

    def _missing(self, spark: SparkSession, done: DataFrame) -> DataFrame:
        """MADE_SCHEMA rows of planned tiles that no pixel reaches: background."""
        tile, fill = self.tile_size, self._fill()
        empty = np.broadcast_to(np.array(fill, DTYPES[self.pixel_format][1]), (tile, tile, len(fill))).tobytes()
        rows = self.planned(spark).join(done.select("level", "col", "row"), ["level", "col", "row"], "left_anti")
        size, none = F.lit(tile).cast("long"), F.lit(None).cast("long")
        return rows.select(F.lit("tile").alias("kind"), none.alias("y0"), none.alias("x0"), "image_id", "level", "col", "row", size.alias("w"), size.alias("h"), F.lit(self.pixel_format).alias("pixel_format"), F.lit(bytearray(empty)).alias("data"), F.lit(self.settings.get("blank", "emit") != "emit").alias("blank"), F.lit(True).alias("uniform"))

    @property
    def _padded(self) -> bool:
        return self.centre or self.layout == "google"

    def tiles(self, blocks: DataFrame, least: int = 0) -> DataFrame:
        """TILE_SCHEMA rows with path, lazily (run() computes pixels once; here a later phase repeats the earlier ones), down
        to level `least`. blocks (BLOCK_SCHEMA; their level is set here) cover the image."""
        spark = blocks.sparkSession
        levels = self.levels(spark)
        level, source, out = levels[-1].level, True, None
        while True:
            squares, k = self._squares(blocks, level, levels, source, None)
            made = self._phase(squares, k, levels, source)
            own = made.where("kind = 'tile'")
            out = own if out is None else out.unionByName(own)
            level, source = level - k, False
            if level <= least:
                break
            blocks = made.where("kind = 'block'").select(*names(BLOCK_SCHEMA))
        if self._padded:
            out = out.unionByName(self._missing(spark, out))
        out = out.where(F.col("level") >= least) if least else out
        return planner.paths(out.drop("kind", "y0", "x0").withColumn("layout", F.lit(self.layout)), self._extension).drop("layout")

    @property
    def _extension(self) -> str:
        return FORMATS[self.settings.get("tile_format", "png")]

    # -- run --------------------------------------------------------------------------------------

    def run(self, blocks: DataFrame, out: str) -> dict:
        """Writes the tiles under `out` (a folder all executors share), the descriptor and the manifest; returns counters."""
        began, spark, mode = time.time(), blocks.sparkSession, self.settings.get("resume", "overwrite")
        if mode == "verify":
            return self.verify(blocks, out)
        if self.settings.get("sink") and (self.settings.get("dedupe", "none") != "none" or self.settings.get("checksum_mode") == "verify"):
            raise ValueError("dedupe and verification need files")
        out = out.rstrip("/")
        if mode == "overwrite" and os.path.isdir(out):
            for name in os.listdir(out):
                path = os.path.join(out, name)
                shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
        os.makedirs(out, exist_ok=True)
        levels, identity = self.levels(spark), self.plan_hash(spark)
        state = manifest.Progress(self.settings.get("checkpoint_root") or out, identity)
        now = spark.range(1).select(manifest.timestamp(F.current_timestamp()).alias("t")).first().t
        state.open(spark, now, fresh=mode == "overwrite")
        total = sum(r.cols * r.rows for r in levels)
        top = levels[-1]
        self._tell(kind="PlanCreated", levels=len(levels), total_tiles=total, canvas_width=top.canvas_width, canvas_height=top.canvas_height)
        for r in reversed(levels):
            self._tell(kind="LevelStarted", level=r.level, width=r.level_width, height=r.level_height, tile_count=r.cols * r.rows)
        planning = time.time() - began
        completed = state.completed(spark)
        remaining = None if completed is None else self.planned(spark).join(completed.select("level", "col", "row"), ["level", "col", "row"], "left_anti")
        folder = os.path.join(out, ".work-" + uuid.uuid4().hex)
        try:
            return self._finish(spark, blocks, levels, out, folder, state, completed, remaining, began, planning, now)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def _finish(self, spark: SparkSession, blocks: DataFrame, levels: list, out: str, folder: str, state: manifest.Progress, completed: DataFrame | None, remaining: DataFrame | None, began: float, planning: float, now: str) -> dict:
        facts, read = self._write_phases(spark, blocks, levels, out, folder, state, completed, remaining)
        written = time.time()
        done = state.completed(spark)  # also of earlier runs
        references = self._dedupe(spark, done, out)
        totals = facts.where("kind = 'tile'").agg(
            F.count_if(~F.col("skipped")).alias("tiles"), F.count_if(F.col("blank") & ~F.col("skipped")).alias("blanks"), F.sum(F.when(~F.col("skipped"), F.col("bytes"))).alias("bytes"), F.sum("retries").alias("retries"), F.count_if("skipped").alias("failed"), F.max("held").alias("held")
        ).first()
        described = self._described(done, levels)
        checks = self.settings.get("checksums")
        source = {"width": self.width, "height": self.height, "pixel_format": self.pixel_format} | ({"bytes_hash": self._source_hash(blocks)} if self.settings.get("source_hash") else {})
        generation = {"tile_size": self.tile_size, "overlap": self.overlap, "layout": self.layout, "format": self._format(), "concurrency": self.settings.get("concurrency", 0), "background_rgb": list(self.settings.get("background", (255, 255, 255))), "blank_strategy": self._blank()}
        document = manifest.build(generation, source, described, now, sparse={"tolerance": self.settings.get("tolerance", 0), "dedupe": self.settings.get("dedupe", "none") != "none"})
        digests = done.where("digest is not null").select("path", "digest").orderBy("path") if checks else None
        manifest.write(document, os.path.join(out, "manifest.json"), checks, digests, references.orderBy("path") if references is not None else None)
        shutil.copyfile(os.path.join(out, "manifest.json"), out + ".manifest.json")
        if self.layout == "deep_zoom":
            manifest.put(out + ".dzi", self._descriptor(spark))
        state.close(spark, done, [d["level_index"] for d, r in zip(described, levels) if d["done"] >= r.cols * r.rows], now)
        if checks and self.settings.get("checksum_mode") == "verify":
            bad = verification.verify_output(spark, out).asDict()
            if bad["tiles_mismatched"]:
                raise verification.ChecksumMismatch(f"{bad['tiles_mismatched']} of {bad['tiles_checked']} tiles differ from their digests")
        self._report(done, described, levels)
        result = {
            "tiles_produced": totals.tiles or 0, "tiles_skipped": totals.blanks or 0, "levels": len(levels), "bytes_written": totals.bytes or 0, "bytes_read": read, "retry_count": totals.retries or 0, "skipped_due_to_failure": totals.failed or 0,
            "peak_memory_bytes": totals.held or 0, "duration": time.time() - began, "stage_durations": {"planning": planning, "sink": written - began - planning, "finish": time.time() - written},
        }
        self._tell(kind="Finished", total_tiles=result["tiles_produced"], **result)
        return result

    def run_collect(self, blocks: DataFrame, out: str) -> tuple[dict, list]:
        """The counters of a run, and the tiles as rows."""
        return self.run(blocks, out), self.tiles(blocks).collect()

    def run_source(self, spark: SparkSession, load: Callable[[SparkSession], DataFrame], out: str, description: str = "") -> dict:
        """run() with the events that frame a pipeline."""
        self._tell(kind="SourceLoadStarted", source_description=description)
        blocks = load(spark)
        self._tell(kind="SourceLoaded", width=self.width, height=self.height, format=self.pixel_format, size_bytes=self.width * self.height * self._pixel_bytes)
        result = self.run(blocks, out)
        self._tell(kind="PipelineComplete")
        return result

    def _format(self) -> dict:
        kind = self.settings.get("tile_format", "png")
        return {"kind": kind} | ({"quality": self.settings.get("quality", 80)} if kind == "jpeg" else {})

    def _blank(self) -> dict:
        kind = self.settings.get("blank", "emit")
        return {"kind": kind} | ({"tolerance": self.settings.get("tolerance", 0)} if kind == "placeholder_with_tolerance" else {})

    def _descriptor(self, spark: SparkSession) -> str:
        return spark.range(1).select(dzi(F.lit(self._extension), F.lit(self.overlap), F.lit(self.tile_size), F.lit(self.width), F.lit(self.height)).alias("x")).first().x

    def _write_phases(self, spark: SparkSession, blocks: DataFrame, levels: list, out: str, folder: str, state: manifest.Progress, completed: DataFrame | None, remaining: DataFrame | None) -> tuple[DataFrame, int]:
        """Facts of all tiles tried, and the bytes read from the source."""
        level, source, facts, phase = levels[-1].level, True, [], 0
        while remaining is None or not remaining.where(F.col("level") <= level - (not source)).isEmpty():
            squares, k = self._squares(blocks, level, levels, source, remaining)
            made = self._phase(squares, k, levels, source)
            if completed is not None:
                made = made.join(completed.select("level", "col", "row"), ["level", "col", "row"], "left_anti").select(*names(MADE_SCHEMA))
            self._tell(kind="BatchStarted", batch_index=phase, levels=[level, max(0, level - k)])
            facts.append(self._written(spark, made, out, folder, state, f"{self.image_id}: levels {level} to {max(0, level - k)}"))
            self._tell(kind="BatchCompleted", batch_index=phase, tiles_produced=facts[-1].where("kind = 'tile' and not skipped").count() if self.observers else None)
            blocks = _staged(facts[-1].where("kind = 'block'"))
            level, source, phase = level - k, False, phase + 1
            if level <= 0:
                break
        if self._padded:
            tried = [f.where("kind = 'tile'").select("level", "col", "row") for f in facts] + ([completed.select("level", "col", "row")] if completed is not None else [])
            facts.append(self._written(spark, self._missing(spark, functools.reduce(DataFrame.unionByName, tried)).select(*names(MADE_SCHEMA)), out, folder, state, f"{self.image_id}: background"))
        read = 0 if source else self.width * self.height * self._pixel_bytes
        return functools.reduce(DataFrame.unionByName, facts, spark.createDataFrame([], sinks.FACT_SCHEMA)), read

    def _written(self, spark: SparkSession, made: DataFrame, out: str, folder: str, state: manifest.Progress, description: str) -> DataFrame:
        """Encodes and writes rows where they are; their facts, committed by Spark."""
        job, tile_format, quality, layout, extension = self, self.settings.get("tile_format", "png"), self.settings.get("quality", 80), self.layout, self._extension
        writer = sinks.FactWriter(out, os.path.join(folder, "blocks"), state.folder, self.settings.get("checkpoint_every", 0), self.settings.get("checksums"), {k: self.settings[k] for k in ("failures", "max_retries", "initial_ms") if k in self.settings}, self.settings.get("sink"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with writer.opened() as put:
                for batch in batches:
                    facts = []
                    for r in batch.itertuples(index=False):
                        if r.kind == "block":
                            facts.append(put.block(r))
                            continue
                        data = sinks.BLANK if r.blank else encode(r.data, int(r.w), int(r.h), r.pixel_format, tile_format, quality)
                        facts.append(put.tile(r, job.path_of(int(r.level), int(r.col), int(r.row), layout, extension), data))
                    yield pd.DataFrame(facts, columns=names(sinks.FACT_SCHEMA))

        if n := self.settings.get("concurrency"):
            made = made.coalesce(n)
        path = os.path.join(folder, "facts-" + uuid.uuid4().hex)
        log.info("writing %s", description)
        spark.sparkContext.setJobDescription(description)
        try:
            made.mapInPandas(run, sinks.FACT_SCHEMA).write.parquet(path)
        finally:
            spark.sparkContext.setJobDescription(None)
        return spark.read.schema(sinks.FACT_SCHEMA).parquet(path)

    @staticmethod
    def path_of(level: int, col: int, row: int, layout: str, extension: str) -> str:
        inner = f"{col}_{row}" if layout == "deep_zoom" else f"{col}/{row}" if layout == "xyz" else f"{row}/{col}"
        return f"{level}/{inner}.{extension}"

    def _described(self, done: DataFrame, levels: list) -> list[dict]:
        got = {r.level: r for r in done.groupBy("level").agg(F.count("*").alias("n"), F.count_if("blank").alias("blanks")).collect()}
        out = []
        for r in levels:
            made, blanks = (got[r.level].n, got[r.level].blanks) if r.level in got else (0, 0)
            out.append({"level_index": r.level, "width": r.level_width, "height": r.level_height, "tiles_produced": made - blanks, "tiles_skipped": blanks + max(0, r.cols * r.rows - made), "done": made})
        return out

    def _source_hash(self, blocks: DataFrame) -> str:
        """Of the digests of the blocks in row-major order: blocks are hashed where they are."""
        rows = blocks.select("y0", "x0", F.sha2("data", 256).alias("d")).orderBy("y0", "x0").select("d").toLocalIterator()
        total = hashlib.sha256()
        for r in rows:
            total.update(bytes.fromhex(r.d))
        return total.hexdigest()

    def _dedupe(self, spark: SparkSession, done: DataFrame, out: str) -> DataFrame | None:
        """Of tiles with equal content the first (by level, row, col) is also a shared file, the others refer to it: (path,
        shared_path). Over all tiles of the output, so a resumed run continues the index. blanks: tiles of one colour."""
        strategy, links = self.settings.get("dedupe", "none"), self.settings.get("links", False)
        if strategy == "none":
            return None
        able = done.where(~F.col("blank") if strategy == "all_content" else ~F.col("blank") & F.col("uniform"))
        decided = contents.deduped(able, "content", "level", "row", "col")
        again = decided.where("decision = 'reference'").select("path", "content", shared_path(F.col("content"), F.col("path")).alias("shared_path"))
        firsts = decided.where("decision = 'write_new'").join(again.select("content", "shared_path").distinct(), "content").select("path", "shared_path")

        def apply(act: Callable[[str, str], None], rows: DataFrame) -> None:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for path, shared in zip(batch["path"], batch["shared_path"]):
                        act(os.path.join(out, path), os.path.join(out, shared))
                    yield pd.DataFrame({"n": [len(batch)]})

            rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()

        apply(sinks.shared_file, firsts)
        apply(sinks.linked if links else sinks.placeholder, again)
        return again.select("path", "shared_path")

    def archive(self, blocks: DataFrame, out: str, stem: str) -> int:
        """tar, tar.gz or zip by its name, with the archive's manifest and the descriptor; tiles written, each under two names."""
        spark = blocks.sparkSession
        levels, tile_format, quality = self.levels(spark), self.settings.get("tile_format", "png"), self.settings.get("quality", 80)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["data"] = [b"" if blank else encode(d, int(w), int(h), f, tile_format, quality) for d, w, h, f, blank in zip(batch["data"], batch["w"], batch["h"], batch["pixel_format"], batch["blank"])]
                yield batch[["path", "data", "blank"]]

        tiles = self.tiles(blocks).mapInPandas(run, "path string, data binary, blank boolean")
        extra = [("manifest.json", manifest.archive(stem, self._extension, self.tile_size, self.overlap, self.width, self.height, self.layout, levels).encode())]
        if self.layout == "deep_zoom":
            extra.append((f"{stem}.dzi", self._descriptor(spark).encode()))
        return sinks.write_archive(tiles, out, stem, extra)

    # -- verify -----------------------------------------------------------------------------------

    def verify(self, blocks: DataFrame, out: str) -> dict:
        """Under the plan that wrote it: every tile is regenerated and held against its file (of any known extension). ok:
        blank tiles are placeholders, the manifest's digest holds, raw files and JPEG are equal byte for byte, PNG by
        pixels; repeated tiles by the shared file that the manifest refers them to."""
        spark, out = blocks.sparkSession, out.rstrip("/")
        manifest.Progress(self.settings.get("checkpoint_root") or out, self.plan_hash(spark)).check(spark)
        levels = self.levels(spark)
        found = verification.load(spark, out, missing_ok=True)
        tiles = self.tiles(blocks).withColumn("path", F.regexp_replace("path", r"\.[a-z]+$", ""))
        bare = lambda df, name: df.select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("path"), name)
        tiles = tiles.join(bare(found.digests, "digest"), "path", "left").join(bare(found.references, "shared_path"), "path", "left")
        algorithm, quality = found.algorithm, self.settings.get("quality", 80)

        def status(r) -> str:
            path = next((p for e in ("raw", "png", "jpeg", "jpg") if os.path.isfile(p := os.path.join(out, f"{r.path}.{e}"))), None)
            data = verification.content(path, r.shared_path, out) if path else None
            if data is None:
                return "missing"
            if r.digest and hashing.hex_digest(data, algorithm) != r.digest.lower():
                return "mismatched"
            if r.blank:
                return "ok" if data == sinks.BLANK else "mismatched"
            if path.endswith(".raw"):
                return "ok" if data == r.data else "mismatched"
            if path.endswith(".png"):
                try:
                    return "ok" if decode(data) == (r.w, r.h, r.pixel_format, r.data) else "mismatched"
                except ValueError:
                    return "mismatched"
            return "ok" if data == encode(r.data, r.w, r.h, r.pixel_format, "jpeg", quality) else "mismatched"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(r.level, status(r)) for r in batch.itertuples(index=False)]
                yield pd.DataFrame(rows, columns=["level", "status"])

        per = tiles.mapInPandas(run, "level long, status string").groupBy("level", "status").count().collect()
        n = lambda s: sum(r["count"] for r in per if r.status == s)
        for r in reversed(levels):
            self._tell(kind="LevelStarted", level=r.level, width=r.level_width, height=r.level_height, tile_count=r.cols * r.rows)
            self._tell(kind="LevelCompleted", level=r.level, tiles_produced=r.cols * r.rows)
        self._tell(kind="Finished", total_tiles=sum(r.cols * r.rows for r in levels), levels=len(levels))
        return {"tiles_produced": 0, "tiles_skipped": 0, "levels": len(levels), "bytes_written": 0, "retry_count": 0, "skipped_due_to_failure": 0, "ok": n("ok"), "missing": n("missing"), "mismatched": n("mismatched")}

    # -- events -----------------------------------------------------------------------------------

    def _report(self, done: DataFrame, described: list[dict], levels: list) -> None:
        """TileCompleted for every tile of the output, level by level, and LevelCompleted. Only if someone listens."""
        if not self.observers:
            return
        made = {d["level_index"]: d["done"] for d in described}
        rows = iter(done.select("level", "row", "col").orderBy(F.desc("level"), "row", "col").toLocalIterator())
        ahead = next(rows, None)
        for r in reversed(levels):
            while ahead is not None and ahead.level == r.level:
                self._tell(kind="TileCompleted", level=ahead.level, col=ahead["col"], row=ahead["row"])
                ahead = next(rows, None)
            self._tell(kind="LevelCompleted", level=r.level, tiles_produced=made.get(r.level, 0))

    def _tell(self, **event) -> None:
        log.debug("%s", event)
        for o in self.observers:
            o(event)


class Collecting(list):
    """An observer that keeps the events."""

    def __call__(self, event: dict) -> None:
        self.append(event)


def _half(n: int, times: int) -> int:
    return -(-n // (1 << times))


def _aligned(step: int, tile: int, level: int) -> int:
    """Halvings after which blocks of `step` still begin at whole tiles; -1 if they don't as they are."""
    if step % tile:
        return -1
    k = 0
    while k < level and step % (tile << (k + 1)) == 0:
        k += 1
    return k


def _staged(facts: DataFrame) -> DataFrame:
    """The blocks that a phase left, read by executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with open(r.path, "rb") as f:
                    yield pd.DataFrame([(r.image_id, r.level, r.y0, r.x0, r.h, r.w, r.pixel_format, f.read())], columns=names(BLOCK_SCHEMA))

    return facts.mapInPandas(run, BLOCK_SCHEMA)


def halvings(x: np.ndarray, times: int, alpha: bool) -> list[np.ndarray]:
    out = [x]
    for _ in range(times):
        out.append(halve_array(out[-1], alpha))
    return out
