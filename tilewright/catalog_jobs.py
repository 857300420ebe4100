"""Queries of jobs, files and output rules; the rest of the catalogue is in catalog.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .catalog import BLOBS, BOX, DENSITY, GRAY, blobs, density, gray_blocks, images, img_sql, levels_sql, query, stats_sql, table
from .functions import tilemath as tm
from .operators import contents, tiles as cut
from .operators.resample import to_array
from .plans import planner
from .plans.job import PyramidJob
from .sources import codec, sinks

CANVAS_DIMENSIONS = f"""
WITH {img_sql()} SELECT image_id, 'google' AS layout, width AS canvas_width, height AS canvas_height FROM img
UNION ALL SELECT image_id, 'deep_zoom', (width + 255) // 256 * 256, (height + 255) // 256 * 256 FROM img"""


@query(CANVAS_DIMENSIONS)
def canvas_dimensions(spark, sf):
    of = lambda layout, centre: planner.canvas_dimensions(planner.plan(images(spark, sf, layout, centre=centre))).withColumn("layout", F.lit(layout))
    return of("google", False).unionByName(of("deep_zoom", True))


COLOUR_TYPES = """
SELECT * FROM (VALUES ('L8', 'gray8'), ('l16', 'gray16'), ('Rgb8', 'rgb8'), ('rgba8', 'rgba8'), ('RGB16', 'rgb16'), ('rgba16', 'rgba16'), ('la8', 'rgba8'), ('La16', 'rgba16')) v(kind, format)"""


@query(COLOUR_TYPES)
def colour_types(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("L8", "l16", "Rgb8", "rgba8", "RGB16", "rgba16", "la8", "La16")], "kind string")
    return kinds.select("kind", tm.normalised_colour(F.col("kind")).alias("format"))


def _cost(dpi: str) -> str:
    return f"(CAST(trunc(CAST(CAST(w AS FLOAT) * CAST(CAST({dpi} AS FLOAT) / CAST(72 AS FLOAT) AS FLOAT) AS FLOAT)) AS BIGINT) * 512 * 4)"


STRIP_DPI = f"""
WITH p AS (SELECT p_partkey, 100.0 + p_size * 40 AS w FROM part), a AS (SELECT *, {_cost("300")} AS full_ FROM p),
b AS (SELECT *, greatest(1, CAST(floor(300 * (CAST(3000000 AS DOUBLE) / full_)) AS BIGINT)) AS scaled FROM a),
c AS (SELECT *, greatest(1, scaled - 1) AS less FROM b)
SELECT p_partkey, CASE WHEN full_ <= 3000000 THEN 300 WHEN scaled >= 72 THEN CASE WHEN {_cost("scaled")} <= 3000000 THEN scaled WHEN {_cost("less")} <= 3000000 AND less >= 72 THEN less END END AS dpi FROM c"""


@query(STRIP_DPI)
def page_strip_dpi(spark, sf):
    """DPI at which a strip fits a budget."""
    w = 100.0 + F.col("p_size") * 40
    return table(spark, sf, "part").select("p_partkey", tm.strip_dpi(w, F.lit(300), F.lit(72), F.lit(512), F.lit(3_000_000)).alias("dpi"))


BLANK_STRATEGIES = f"""
WITH e AS ({stats_sql(DENSITY, 16, True)}), t AS ({stats_sql(DENSITY, 16, True, tol=3)})
SELECT col, "row", 'emit' AS strategy, false AS placeholder FROM e UNION ALL SELECT col, "row", 'placeholder', blank FROM e
UNION ALL SELECT col, "row", 'placeholder_with_tolerance', blank FROM t"""


@query(BLANK_STRATEGIES)
def blank_strategies(spark, sf):
    out = None
    for strategy, tolerance in (("emit", 0), ("placeholder", 0), ("placeholder_with_tolerance", 3)):
        t = cut.tile_stats(density(spark, sf), 256, 128, 16, tolerance=tolerance)
        t = t.select("col", "row", F.lit(strategy).alias("strategy"), cut.blank_strategy(F.col("blank"), strategy).alias("placeholder"))
        out = t if out is None else out.unionByName(t)
    return out


WIDE = f"{DENSITY.replace('px AS', 'd8 AS')}, px AS (SELECT y, x, c0 * 256 + (x // 16) % 3 AS c0 FROM d8)"
BLANK_16_BITS = f"""
WITH {WIDE}, g AS (SELECT x // 16 AS col, y // 16 AS "row", CAST(sum(c0) AS BIGINT) AS sum_c0, min(c0 // 256) AS hi0, max(c0 // 256) AS hi1, arg_min(c0 // 256, y * 1000 + x) AS hi, min(c0 % 256) AS lo0, max(c0 % 256) AS lo1, arg_min(c0 % 256, y * 1000 + x) AS lo FROM px GROUP BY 1, 2)
SELECT col, "row", sum_c0, hi1 - hi <= 2 AND hi - hi0 <= 2 AND lo1 - lo <= 2 AND lo - lo0 <= 2 AS blank FROM g"""


@query(BLANK_16_BITS)
def blank_tolerance_16_bits(spark, sf):
    """Tolerance counts in bytes, so a step of 256 in a 16-bit sample is one."""
    wide = density(spark, sf).withColumn("c0", F.col("c0") * 256 + tm.idiv(F.col("x"), 16) % 3)
    return cut.tile_stats(wide, 256, 128, 16, fill=(65535,), tolerance=2, sample_bytes=2).select("col", "row", "sum_c0", "blank")


PACKFILE_ENTRIES = f"""
WITH {levels_sql("deep_zoom", 256)}, t AS (SELECT image_id, level, col, CAST(unnest(range(rows)) AS BIGINT) AS "row" FROM (SELECT *, CAST(unnest(range(cols)) AS BIGINT) AS col FROM lv)),
p AS (SELECT image_id, 'img' || image_id AS stem, level || '/' || col || '_' || "row" || '.png' AS path FROM t)
SELECT image_id, stem || '_files/' || path AS entry FROM p UNION ALL SELECT image_id, stem || '/' || path FROM p"""


@query(PACKFILE_ENTRIES)
def packfile_entries(spark, sf):
    """The names of every tile in its image's archive."""
    t = planner.paths(planner.tiles(planner.levels(planner.plan(images(spark, sf, spread=True)))))
    stem = F.concat(F.lit("img"), F.col("image_id").cast("string"))
    return t.select("image_id", F.explode(tm.archive_entries(stem, F.col("path"))).alias("entry"))


FAILURE_POLICIES = """
WITH p AS (SELECT p_partkey, p_size % 6 AS failures, list_extract(['fail_fast', 'retry_then_fail', 'retry_then_skip'], CAST(p_partkey % 3 + 1 AS INTEGER)) AS policy FROM part),
q AS (SELECT *, CASE WHEN policy = 'fail_fast' THEN 0 ELSE 3 END AS tries FROM p)
SELECT p_partkey, policy, CASE WHEN failures <= tries THEN 'written' WHEN policy = 'retry_then_skip' THEN 'skipped' ELSE 'failed' END AS outcome,
  CAST(CASE WHEN failures <= tries THEN failures WHEN policy = 'retry_then_skip' THEN tries END AS BIGINT) AS retries,
  coalesce(list_sum(list_transform(range(least(failures, tries)), lambda i: 50.0 * pow(2.0, i))), 0.0) AS waited_ms FROM q"""


@query(FAILURE_POLICIES)
def failure_policies(spark, sf):
    """Writes that fail so many times, under each policy: what becomes of the tile, retries, and the waits between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, failures, policy in batch.itertuples(index=False):
                left, waits = [failures], []

                def write(left=left) -> None:
                    left[0] -= 1
                    if left[0] >= 0:
                        raise OSError("busy")

                try:
                    retries, ok = sinks.attempt(write, sinks.RetryPolicy(jitter=False), policy, None, waits.append)
                    rows.append((key, policy, "written" if ok else "skipped", retries, 1000 * sum(waits)))
                except OSError:
                    rows.append((key, policy, "failed", None, 1000 * sum(waits)))
            yield pd.DataFrame(rows, columns=["p_partkey", "policy", "outcome", "retries", "waited_ms"]).astype({"retries": "Int64"})

    policy = F.element_at(F.array(*map(F.lit, sinks.POLICIES)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_size") % 6).cast("long").alias("failures"), policy.alias("policy"))
    return rows.mapInPandas(run, "p_partkey long, policy string, outcome string, retries long, waited_ms double").withColumn("waited_ms", F.round("waited_ms", 6))


LARGEST_PER_PAGE = """
SELECT l_orderkey AS page, l_linenumber AS image, pixels FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) * (l_partkey % 3 + 1) AS pixels FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pixels DESC, l_linenumber) = 1"""


@query(LARGEST_PER_PAGE)
def largest_per_page(spark, sf):
    """The largest image of each page, the first of equal ones: one partial aggregate, no window."""
    pixels = F.floor("l_quantity").cast("long") * (F.col("l_partkey") % 3 + 1)
    best = F.max(F.struct(pixels.alias("pixels"), (-F.col("l_linenumber")).alias("first"), F.col("l_linenumber").alias("image"))).alias("b")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(best).select("page", "b.image", "b.pixels")


INDEX = "i AS (SELECT DISTINCT digest FROM blobs WHERE bytes % 3 = 0 AND bytes % 2 = 0)"
DEDUPE_SEEDED = f"""
WITH {BLOBS}, {INDEX} SELECT path, CASE WHEN digest IN (SELECT digest FROM i) THEN 'reference' WHEN path = min(path) OVER (PARTITION BY digest) THEN 'write_new' ELSE 'reference' END AS decision FROM blobs"""


@query(DEDUPE_SEEDED)
def dedupe_seeded(spark, sf):
    """Dedupe that goes on from an earlier run's index, some of whose entries are forgotten."""
    b = blobs(spark, sf)
    index = contents.forgotten(b.where("bytes % 3 = 0"), b.where("bytes % 2 <> 0"))
    return contents.seeded(b, index, "digest", "path").select("path", "decision")


DECODED_FILES = """
WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT 64 * i AS y, least(64, n - 64 * i) AS h FROM (SELECT n, unnest(range((n + 63) // 64)) AS i FROM n))
SELECT y || '.' || f AS path, CAST(64 AS BIGINT) AS w, h, 'gray8' AS pixel_format, true AS decoded, true AS near FROM b, (VALUES ('png'), ('jpeg')) v(f)
UNION ALL SELECT y || '.cut', NULL, NULL, NULL, false, NULL FROM b UNION ALL SELECT y || '.junk', NULL, NULL, NULL, false, NULL FROM b"""


@query(DECODED_FILES)
def decoded_files(spark, sf):
    """Blocks as PNG, JPEG, a JPEG cut short and junk, decoded by their magic bytes: sizes, errors, and whether pixels are near the source's."""
    b = gray_blocks(spark, sf, 64)
    own = lambda f, q=95: codec.encoded(F.col("data"), F.col("w"), F.col("h"), F.col("pixel_format"), f, q)
    name = lambda f: F.concat(F.col("y0").cast("string"), F.lit(f".{f}"))
    files = b.select(name("png").alias("path"), own("png").alias("content"), "data").unionByName(b.select(name("jpeg").alias("path"), own("jpeg").alias("content"), "data"))
    files = files.unionByName(b.select(name("cut").alias("path"), F.substring(own("jpeg"), 1, 100).alias("content"), "data"))
    files = files.unionByName(b.select(name("junk").alias("path"), F.col("data").alias("content"), "data"))
    back = codec.decoded(files).join(files.select("path", F.col("data").alias("source")), "path")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flag = [None if d is None else bool(np.abs(np.frombuffer(d, np.uint8).astype(int) - np.frombuffer(s, np.uint8)).max() <= 24) for d, s in zip(batch["data"], batch["source"])]
            yield batch[["path", "w", "h", "pixel_format"]].assign(decoded=batch["error"].isna(), near=flag)

    return back.mapInPandas(near, "path string, w long, h long, pixel_format string, decoded boolean, near boolean")


def job_sums(tiles: DataFrame) -> DataFrame:
    """Tiles of a job as sums of their samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = [int(to_array(d, h, w, f).sum()) for d, h, w, f in zip(batch["data"], batch["h"], batch["w"], batch["pixel_format"])]
            yield batch[["level", "col", "row", "w", "h", "uniform"]].assign(sum_c0=sums)

    return tiles.mapInPandas(run, "level long, col long, row long, w long, h long, uniform boolean, sum_c0 long")


def _job(spark, sf, overlap: int, tile: int = 16) -> DataFrame:
    """The four largest levels of a job over the vectors' raster, numbered from 0."""
    n = table(spark, sf, "embeddings").count()
    job = PyramidJob(64, n, tile, overlap, pixel_format="gray8").with_memory_budget(16 * tile * tile, "auto_adjust")
    top = job.levels(spark)[-1].level
    return job_sums(job.tiles(gray_blocks(spark, sf, 64), top - 3)).withColumn("level", F.col("level") - (top - 3))


def job_sql(overlap: int, tile: int = 16) -> str:
    """Tiles of the cascade by rectangles: padded without overlap, of their own size with it."""
    k = [f"WITH {GRAY}, k0 AS (SELECT y, x, c0 FROM px)"] + [f"k{i} AS (SELECT y // 2 AS y, x // 2 AS x, {BOX.format(c='c0')} FROM k{i - 1} GROUP BY 1, 2)" for i in (1, 2, 3)]
    k.append("u AS (" + " UNION ALL ".join(f"SELECT CAST({3 - i} AS BIGINT) AS level, y, x, c0 FROM k{i}" for i in range(4)) + ")")
    k.append("s AS (SELECT level, max(x) + 1 AS lw, max(y) + 1 AS lh FROM u GROUP BY level)")
    k.append(f'r AS (SELECT level, lw, lh, CAST(unnest(range((lw + {tile - 1}) // {tile})) AS BIGINT) AS col FROM s), t AS (SELECT level, lw, lh, col, CAST(unnest(range((lh + {tile - 1}) // {tile})) AS BIGINT) AS "row" FROM r)')
    k.append(
        f'q AS (SELECT t.level, col, "row", max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n, CAST(sum(c0) AS BIGINT) AS s, min(c0) AS mn, '
        f'max(c0) AS mx FROM t JOIN u ON u.level = t.level '
        f'AND x >= col * {tile} - {overlap} AND x < (col + 1) * {tile} + {overlap} AND y >= "row" * {tile} - {overlap} AND y < ("row" + 1) * {tile} + {overlap} '
        f'GROUP BY 1, 2, 3)'
    )
    area = tile * tile
    if overlap:
        return ", ".join(k) + ' SELECT level, col, "row", w, h, s AS sum_c0, mn = mx AS uniform FROM q'
    return ", ".join(k) + f' SELECT level, col, "row", CAST({tile} AS BIGINT) AS w, CAST({tile} AS BIGINT) AS h, s + ({area} - n) * 255 AS sum_c0, mn = mx AND (n = {area} OR mn = 255) AS uniform FROM q'


@query(job_sql(0))
def job_tiles(spark, sf):
    """A job's tiles, made in squares and phases."""
    return _job(spark, sf, 0)


@query(job_sql(3))
def job_tiles_overlap(spark, sf):
    """The same with tiles that take pixels from neighbouring squares."""
    return _job(spark, sf, 3)
