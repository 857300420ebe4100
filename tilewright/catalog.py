"""Queries over the driver's tables, each with the SQL that DuckDB answers with the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import geo, hashing, tilemath as tm
from .operators import contents, resample, tiles as cut
from .plans import manifest, planner
from .shipping import ship
from .sources import codec, rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- plans of an image catalogue -------------------------------------------------------------------


def images(spark, sf_dir, layout="deep_zoom", tile_size=256, overlap=0, centre=False, where="true", spread=False) -> DataFrame:
    """spread: for plans that go on to tiles."""
    size = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"), (100 + (F.col("p_partkey") * 37) % 2000).cast("long").alias("width"), (100 + F.col("p_size").cast("long") * 31).alias("height")
    )
    size = planner.spread(size.where(where)) if spread else size.where(where)
    return size.withColumns({"tile_size": F.lit(tile_size).cast("long"), "overlap": F.lit(overlap).cast("long"), "layout": F.lit(layout), "centre": F.lit(centre)})


def img_sql(where: str = "true") -> str:
    return f"img AS (SELECT * FROM (SELECT p_partkey AS image_id, CAST(100 + (p_partkey * 37) % 2000 AS BIGINT) AS width, CAST(100 + p_size * 31 AS BIGINT) AS height FROM part) WHERE {where})"


def half(x: str, k: str) -> str:
    return f"(({x} + (CAST(1 AS BIGINT) << CAST({k} AS BIGINT)) - 1) // (CAST(1 AS BIGINT) << CAST({k} AS BIGINT)))"


def log2_sql(x: str) -> str:
    return f"(CASE WHEN {x} <= 1 THEN 0 ELSE length(bin({x} - 1)) END)"


def plan_sql(layout: str, ts: int, centre: bool, where: str = "true") -> str:
    cols, rows = f"((width + {ts} - 1) // {ts})", f"((height + {ts} - 1) // {ts})"
    grid = f"greatest({cols}, {rows})"
    if layout == "google":
        n, cw, ch = f"{log2_sql(grid)} + 1", f"{ts} * (CAST(1 AS BIGINT) << CAST({log2_sql(grid)} AS BIGINT))", f"{ts} * (CAST(1 AS BIGINT) << CAST({log2_sql(grid)} AS BIGINT))"
    else:
        n = f"{log2_sql('greatest(width, height)')} + 1"
        cw, ch = (f"{cols} * {ts}", f"{rows} * {ts}") if centre else ("width", "height")
    off = "(canvas_width - width) // 2 AS offset_x, (canvas_height - height) // 2 AS offset_y" if centre else "CAST(0 AS BIGINT) AS offset_x, CAST(0 AS BIGINT) AS offset_y"
    return f"{img_sql(where)}, pl AS (SELECT *, {off} FROM (SELECT *, CAST({n} AS BIGINT) AS n_levels, CAST({cw} AS BIGINT) AS canvas_width, CAST({ch} AS BIGINT) AS canvas_height FROM img))"


def levels_sql(layout: str, ts: int, centre: bool = False, where: str = "true") -> str:
    down = "(n_levels - 1 - level)"
    grid = "(CAST(1 AS BIGINT) << level), (CAST(1 AS BIGINT) << level)" if layout == "google" else f"((level_width + {ts} - 1) // {ts}), ((level_height + {ts} - 1) // {ts})"
    c, r = grid.split("), ", 1)
    return (
        f"{plan_sql(layout, ts, centre, where)}, l0 AS (SELECT *, CAST(unnest(range(n_levels)) AS BIGINT) AS level FROM pl), "
        f"l1 AS (SELECT *, {half('width', down)} AS level_width, {half('height', down)} AS level_height FROM l0), "
        f"lv AS (SELECT *, {c}) AS cols, {r} AS rows, offset_x >> {down} AS level_offset_x, offset_y >> {down} AS level_offset_y FROM l1)"
    )


def tiles_sql(layout: str, ts: int, ov: int, where: str) -> str:
    side = lambda i, size: (f"{i} * {ts}", f"{ts}") if layout == "google" else (f"CASE WHEN {i} = 0 THEN 0 ELSE {i} * {ts} - {ov} END", f"least(({i} + 1) * {ts} + {ov}, {size}) - CASE WHEN {i} = 0 THEN 0 ELSE {i} * {ts} - {ov} END")
    (x, w), (y, h) = side("col", "level_width"), side('"row"', "level_height")
    return (
        f'{levels_sql(layout, ts, False, where)}, t0 AS (SELECT *, CAST(unnest(range(rows)) AS BIGINT) AS "row" FROM lv), t1 AS (SELECT *, '
        f'CAST(unnest(range(cols)) AS BIGINT) AS col FROM t0), '
        f"tl AS (SELECT *, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST({w} AS BIGINT) AS w, CAST({h} AS BIGINT) AS h FROM t1)"
    )


LEVEL_COLUMNS = ["image_id", "level", "level_width", "level_height", "cols", "rows", "canvas_width", "canvas_height", "level_offset_x", "level_offset_y"]

for _layout in ("deep_zoom", "xyz", "google"):
    for _centre in (False, True):
        _name = f"plan_levels_{_layout}" + "_centred" * _centre
        QUERIES[_name] = lambda spark, sf, layout=_layout, centre=_centre: planner.levels(planner.plan(planner.validated(images(spark, sf, layout, centre=centre)))).select(LEVEL_COLUMNS)
        ORACLE_SQL[_name] = f"WITH {levels_sql(_layout, 256, _centre)} SELECT {', '.join(LEVEL_COLUMNS)} FROM lv"

TILE_COLUMNS = ["image_id", "level", "col", "row", "x", "y", "w", "h"]
for _layout, _ts, _ov in (("deep_zoom", 256, 0), ("deep_zoom", 254, 1), ("xyz", 128, 2), ("google", 256, 1)):
    _name = f"plan_tiles_{_layout}_{_ts}_{_ov}"
    QUERIES[_name] = lambda spark, sf, a=(_layout, _ts, _ov): planner.tiles(planner.levels(planner.plan(images(spark, sf, *a, spread=True)))).select(TILE_COLUMNS)
    ORACLE_SQL[_name] = f'WITH {tiles_sql(_layout, _ts, _ov, "true")} SELECT image_id, level, col, "row", x, y, w, h FROM tl'


@query(
    "WITH d AS (SELECT * FROM (VALUES ('deep_zoom'), ('xyz'), ('google')) v(layout)), "
    + levels_sql("xyz", 256)
    + """, t AS (SELECT image_id, level, c.col, r."row" FROM (SELECT image_id, level, CAST(unnest(range(cols)) AS BIGINT) AS col FROM lv) c JOIN (SELECT image_id, level, CAST(unnest(range(rows)) AS BIGINT) AS "row" FROM lv) r USING (image_id, level))
    SELECT image_id, level, col, "row", layout, CASE layout WHEN 'deep_zoom' THEN level || '/' || col || '_' || "row" WHEN 'xyz' THEN level || '/' || col || '/' || "row" ELSE level || '/' || "row" || '/' || col END || '.png' AS path FROM t, d"""
)
def tile_paths_all_layouts(spark, sf):
    t = planner.tiles(planner.levels(planner.plan(images(spark, sf, "xyz", spread=True)))).drop("layout")
    named = t.withColumn("layout", F.explode(F.array(*map(F.lit, ("deep_zoom", "xyz", "google")))))
    return planner.paths(named).select("image_id", "level", "col", "row", "layout", "path")


@query(ORACLE_SQL["tile_paths_all_layouts"])
def tile_paths_parsed(spark, sf):
    """Paths back to coordinates: the rows of tile_paths_all_layouts again."""
    p = tile_paths_all_layouts(spark, sf).select("image_id", "layout", "path")
    at = tm.parse_tile_path(F.col("layout"), F.col("path"))
    return p.withColumn("at", at).select("image_id", "at.level", "at.col", "at.row", "layout", "path")


@query(f"WITH {levels_sql('deep_zoom', 256)} SELECT image_id, count(*) AS level_count, CAST(sum(cols * rows) AS BIGINT) AS total_tiles FROM lv GROUP BY image_id")
def plan_tile_totals(spark, sf):
    return planner.totals(planner.levels(planner.plan(images(spark, sf))))


@query(
    "SELECT p_partkey AS image_id, CAST(p_size AS BIGINT) - 3 AS width, CAST(p_partkey % 300 AS BIGINT) AS overlap, (CAST(p_size AS BIGINT) - 3 > 0 "
    "AND p_partkey % 300 < 256) AS valid FROM part"
)
def plan_validation(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size").cast("long") - 3).alias("width"), F.lit(10).cast("long").alias("height"), F.lit(256).cast("long").alias("tile_size"), (F.col("p_partkey") % 300).alias("overlap"))
    return p.select("image_id", "width", "overlap", planner.is_valid().alias("valid"))


@query(
    f"WITH {plan_sql('google', 256, True)} SELECT image_id, canvas_width, canvas_height, offset_x, offset_y, CASE WHEN canvas_width = width "
    f"AND canvas_height = height THEN width * height * 8 ELSE width * height * 4 + canvas_width * canvas_height * 4 END AS peak, "
    f"canvas_width * canvas_height * 3 + canvas_width * canvas_height * 3 // 4 AS peak_rgb8 FROM pl"
)
def plan_memory_estimates(spark, sf):
    return planner.plan(images(spark, sf, "google", centre=True)).select("image_id", "canvas_width", "canvas_height", "offset_x", "offset_y", planner.peak_memory().alias("peak"), planner.peak_memory_for(F.lit("rgb8")).alias("peak_rgb8"))


def strip_sql(h: str, bpp: int) -> str:
    last = f"greatest(1, least({log2_sql('canvas_width')}, {log2_sql(h)}))"
    total = f"list_sum(list_transform(range({last}), lambda k: 2 * {half('canvas_width', 'k')} * {half(h, 'k')} * {bpp})) + {half('canvas_width', last)} * {half(h, last)} * {bpp}"
    return f"CAST({total} AS BIGINT)"


@query(
    f"WITH {plan_sql('deep_zoom', 64, False)}, c AS (SELECT image_id, canvas_height, {strip_sql('128', 4)} AS s FROM pl), u AS (SELECT *, "
    f"s + s // 10 AS unit_bytes FROM c), "
    "v AS (SELECT *, least(1500000 // unit_bytes * 128, canvas_height) // 128 * 128 AS tall FROM u) SELECT image_id, unit_bytes, CASE "
    "WHEN tall > 0 THEN tall END AS strip_height FROM v"
)
def strip_heights(spark, sf):
    p = planner.plan(images(spark, sf, tile_size=64))
    return p.select("image_id", planner.strip_memory(F.lit("rgba8"), F.lit(128)).alias("unit_bytes"), planner.strip_height(F.lit("rgba8"), F.lit(1_500_000)).alias("strip_height"))


@query(
    f"WITH {levels_sql('deep_zoom', 64)}, m AS (SELECT image_id, coalesce(max(CASE WHEN level_width * level_height * 4 <= canvas_width * 128 * 4 THEN level "
    f"END), 0) AS threshold, "
    "coalesce(max(CASE WHEN level_width * level_height * 4 <= canvas_width * 128 * 4 THEN level_width * level_height * 4 END), 0) AS mono, "
    "max(canvas_width * 128 * 4) AS strip_bytes, max(canvas_width) AS cw, max(level) AS top FROM lv GROUP BY image_id), "
    f"f AS (SELECT *, CAST(coalesce((SELECT sum({half('cw', 'k')} * (({half('128', 'k')} + 1) // 2) * 4) FROM (SELECT unnest(range(top - threshold)) AS k)), "
    f"0) AS BIGINT) + mono AS fixed_bytes FROM m), "
    "g AS (SELECT *, greatest(1, greatest(0, 4000000 - fixed_bytes) // strip_bytes) AS strips FROM f) SELECT image_id, threshold, strip_bytes, fixed_bytes, "
    "strips, strips * strip_bytes + fixed_bytes + (strips * strip_bytes + fixed_bytes) // 10 AS peak FROM g"
)
def inflight_strips(spark, sf):
    m = planner.monolithic_level(planner.levels(planner.plan(images(spark, sf, tile_size=64))), "rgba8", F.lit(128)).withColumn("strips", planner.inflight_strips(F.lit(4_000_000)))
    return m.withColumn("peak", planner.parallel_memory(F.col("strips")))


@query(
    "SELECT * FROM (VALUES ('gray8', 1, 1, 1, false, 'rgba8', 'gray8'), ('gray16', 1, 2, 2, false, 'rgba16', 'gray16'), ('rgb8', 3, 1, 3, false, 'rgba8', "
    "'rgb8'), ('rgba8', 4, 1, 4, true, 'rgba8', 'rgb8'), ('rgb16', 3, 2, 6, false, 'rgba16', 'rgb16'), ('rgba16', 4, 2, 8, true, 'rgba16', "
    "'rgb16')) v(format, channels, bytes_per_channel, bytes_per_pixel, has_alpha, with_alpha, without_alpha)"
)
def pixel_formats(spark, sf):
    f = F.col("format")
    names = spark.range(len(tm.PIXEL_FORMATS)).select(F.element_at(F.array(*(F.lit(n) for n, *_ in tm.PIXEL_FORMATS)), (F.col("id") + 1).cast("int")).alias("format"))
    return names.select("format", tm.channels(f).alias("channels"), tm.bytes_per_channel(f).alias("bytes_per_channel"), tm.bytes_per_pixel(f).alias("bytes_per_pixel"), tm.has_alpha(f).alias("has_alpha"), tm.with_alpha(f).alias("with_alpha"), tm.without_alpha(f).alias("without_alpha"))


# -- resampling -----------------------------------------------------------------------------------

GRAY = (
    "px AS (SELECT CAST(vec_id AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS BIGINT) AS c0 "
    "FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
)
BOX = "CAST((sum({c}) + count(*) // 2) // count(*) AS BIGINT) AS {c}"


def gray(spark, sf) -> DataFrame:
    return rasters.embedding_pixels(table(spark, sf, "embeddings"))


@query(f"WITH {GRAY} SELECT y // 2 AS y, x // 2 AS x, {BOX.format(c='c0')} FROM px GROUP BY 1, 2")
def halve_gray(spark, sf):
    return resample.halve(gray(spark, sf))


RGB = (
    "px AS (SELECT i // 301 AS y, i % 301 AS x, i % 301 * 255 // 301 AS c0, i // 301 * 255 // 211 AS c1, (i % 301 + i // 301) * 255 // 512 AS c2 "
    "FROM (SELECT unnest(range(301 * 211)) AS i))"
)


@query(f"WITH {RGB} SELECT y // 2 AS y, x // 2 AS x, {BOX.format(c='c0')}, {BOX.format(c='c1')}, {BOX.format(c='c2')} FROM px GROUP BY 1, 2")
def halve_rgb(spark, sf):
    return resample.halve(rasters.test_pixels(spark, 301, 211))


@query(
    f"WITH {RGB}, q AS (SELECT *, (x * 7 + y * 13) % 256 * (CASE WHEN (x // 4 + y // 4) % 5 = 0 THEN 0 ELSE 1 END) AS a FROM px), s AS (SELECT y // 2 AS y, "
    f"x // 2 AS x, count(*) AS n, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(a * c0) AS DOUBLE) AS s0, CAST(sum(a * c1) AS DOUBLE) AS s1, "
    f"CAST(sum(a * c2) AS DOUBLE) AS s2 FROM q GROUP BY 1, 2) "
    "SELECT y, x, " + ", ".join(f"CASE WHEN sa = 0 THEN 0 ELSE CAST(trunc(s{i} / (n * (sa / n))) AS BIGINT) END AS c{i}" for i in range(3)) + ", CAST(trunc(sa / n) AS BIGINT) AS c3 FROM s"
)
def halve_alpha(spark, sf):
    clear = F.when((tm.idiv(F.col("x"), 4) + tm.idiv(F.col("y"), 4)) % 5 == 0, 0).otherwise(1)
    px = rasters.test_pixels(spark, 301, 211).withColumn("c3", ((F.col("x") * 7 + F.col("y") * 13) % 256 * clear).cast("long"))
    return resample.halve(px, alpha=True)


def cascade_sql(source: str, times: int) -> str:
    parts = [f"WITH {source}, k0 AS (SELECT y, x, c0 FROM px)"]
    for k in range(1, times + 1):
        parts.append(f"k{k} AS (SELECT y // 2 AS y, x // 2 AS x, {BOX.format(c='c0')} FROM k{k - 1} GROUP BY 1, 2)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT y, x, c0, CAST({times - k} AS BIGINT) AS level FROM k{k}" for k in range(times + 1))


@query(cascade_sql(GRAY, 3))
def cascade_levels(spark, sf):
    return resample.cascade(gray(spark, sf), 3, top=3)


def gray_blocks(spark, sf, side: int) -> DataFrame:
    """The vectors' raster in strips of `side` rows (the whole width is 64)."""
    vectors = table(spark, sf, "embeddings").select(tm.idiv(F.col("vec_id"), side).alias("strip"), "vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int")).alias("line"))

    def pack(key, batch):
        import pandas as pd

        rows = np.stack(batch.sort_values("vec_id").line.map(np.asarray).tolist()).astype(np.uint8)
        return pd.DataFrame([("vectors", 3, key[0] * side, 0, *rows.shape, "gray8", rows.tobytes())], columns=["image_id", "level", "y0", "x0", "h", "w", "pixel_format", "data"])

    return vectors.groupBy("strip").applyInPandas(pack, resample.BLOCK_SCHEMA)


@query(cascade_sql(GRAY, 3))
def cascade_blocks(spark, sf):
    """The same by blocks: three halvings inside each block, no shuffle after the blocks are made."""
    return resample.block_pixels(resample.block_cascade(gray_blocks(spark, sf, 64), 3), 1).select("y", "x", "c0", "level")


@query(
    "WITH " + GRAY + ", s AS (SELECT *, 64 AS sw, (SELECT count(*) FROM embeddings) AS sh FROM px), d AS (SELECT dx.dx, dy.dy FROM (SELECT unnest(range(20)) AS dx) dx, (SELECT unnest(range(17)) AS dy) dy) "
    "SELECT d.dy AS y, d.dx AS x, CAST((sum(c0) + count(*) // 2) // count(*) AS BIGINT) AS c0 FROM s JOIN d ON s.x >= d.dx * sw // 20 "
    "AND s.x < ((d.dx + 1) * sw + 19) // 20 AND s.y >= d.dy * sh // 17 AND s.y < ((d.dy + 1) * sh + 16) // 17 GROUP BY 1, 2"
)
def downscale_to(spark, sf):
    return resample.downscale_to(gray(spark, sf), 64, table(spark, sf, "embeddings").count(), 20, 17)


# -- tiles ----------------------------------------------------------------------------------------


def stats_sql(source: str, ts: int, pad: bool, key: str = "", tol: int = 0) -> str:
    area = f"{ts * ts}" if pad else "n"
    low = "CASE WHEN n < {a} THEN least(mn, 255) ELSE mn END".format(a=area)
    high = "CASE WHEN n < {a} THEN greatest(mx, 255) ELSE mx END".format(a=area)
    size = f"CAST({ts} AS BIGINT) AS w, CAST({ts} AS BIGINT) AS h" if pad else "w, h"
    return (
        f'WITH {source}, g AS (SELECT x // {ts} AS col, y // {ts} AS "row", count(*) AS n, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, '
        f'CAST(sum(c0) AS BIGINT) AS s, min(c0) AS mn, max(c0) AS mx, arg_min(c0, y * 100000 + x) AS first FROM px GROUP BY 1, 2) '
        f'SELECT col, "row", {size}, {area} - n AS n_pad, s + ({area} - n) * 255 AS sum_c0, ({high}) - first <= {tol} AND first - ({low}) <= {tol} AS blank FROM g'
    )


@query(stats_sql(GRAY, 48, True))
def extract_tiles_pad(spark, sf):
    return cut.tile_stats(gray(spark, sf), 64, 1, 48)


@query(
    f"WITH {GRAY}, n AS (SELECT count(*) AS hh FROM embeddings), t AS (SELECT col, \"row\", CASE WHEN col = 0 THEN 0 ELSE col * 24 - 3 END AS x0, "
    f"least((col + 1) * 24 + 3, 64) AS x1, CASE WHEN \"row\" = 0 THEN 0 ELSE \"row\" * 24 - 3 END AS y0, least((\"row\" + 1) * 24 + 3, hh) AS y1 "
    'FROM (SELECT unnest(range(3)) AS col) a, (SELECT hh, unnest(range((hh + 23) // 24)) AS "row" FROM n) b) '
    'SELECT col, "row", max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(0 AS BIGINT) AS n_pad, CAST(sum(c0) AS BIGINT) AS sum_c0, '
    'min(c0) = max(c0) AS blank FROM t JOIN px ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2'
)
def extract_tiles_overlap(spark, sf):
    return cut.tile_stats(gray(spark, sf), 64, table(spark, sf, "embeddings").count(), 24, overlap=3)


@query(stats_sql(GRAY, 40, True))
def extract_tiles_google(spark, sf):
    return cut.tile_stats(gray(spark, sf), 64, 1, 40, overlap=2, google=True)


CANVAS = (
    f"{GRAY.replace('px AS', 'src AS')}, n AS (SELECT (count(*) + 47) // 48 * 48 AS ch, ((count(*) + 47) // 48 * 48 - count(*)) // 2 AS oy FROM embeddings), "
    f"grid AS (SELECT y, x, oy FROM (SELECT oy, unnest(range(ch)) AS y FROM n) a, (SELECT unnest(range(96)) AS x) b), px AS (SELECT g.y, g.x, coalesce(c0, "
    f"255) AS c0 FROM grid g LEFT JOIN src s ON s.y + g.oy = g.y AND s.x + 16 = g.x)"
)


@query(stats_sql(CANVAS, 48, True))
def centre_embed(spark, sf):
    n = table(spark, sf, "embeddings").count()
    high = -(-n // 48) * 48
    return cut.tile_stats(cut.embed(gray(spark, sf), 16, (high - n) // 2, 96, high, (255,)), 96, high, 48)


DENSITY = (
    "px AS (SELECT g.y, g.x, coalesce(c, 0) AS c0 FROM (SELECT i // 256 AS y, i % 256 AS x FROM (SELECT unnest(range(256 * 128)) AS i)) g LEFT "
    "JOIN (SELECT l_suppkey % 128 AS y, l_partkey % 256 AS x, CAST(least(count(*), 255) AS BIGINT) AS c FROM lineitem GROUP BY 1, 2) d ON d.y = g.y "
    "AND d.x = g.x)"
)


def density(spark, sf) -> DataFrame:
    return rasters.density_pixels(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", 256, 128)


@query(stats_sql(DENSITY, 16, True))
def blank_tiles(spark, sf):
    return cut.tile_stats(density(spark, sf), 256, 128, 16)


@query(stats_sql(DENSITY, 16, True, tol=3))
def blank_tolerance(spark, sf):
    return cut.tile_stats(density(spark, sf), 256, 128, 16, tolerance=3)


@query(
    f"WITH b AS ({stats_sql(DENSITY, 16, True)}) SELECT 'density' AS image_id, CAST(4 AS BIGINT) AS level, "
    f"CAST(count(*) - count(*) FILTER (blank) AS BIGINT) AS tiles_produced, CAST(count(*) FILTER (blank) + 128 - count(*) AS BIGINT) AS tiles_skipped FROM b "
    f"WHERE \"row\" < 7"
)
def level_counts_manifest(spark, sf):
    t = cut.tile_stats(density(spark, sf), 256, 128, 16).where("row < 7").withColumns({"image_id": F.lit("density"), "level": F.lit(4).cast("long")})
    planned = spark.range(1).select(F.lit("density").alias("image_id"), F.lit(4).cast("long").alias("level"), F.lit(16).cast("long").alias("cols"), F.lit(8).cast("long").alias("rows"))
    return cut.level_counts(t, planned)


@query(f"WITH {GRAY} SELECT y - 10 AS y, x - 5 AS x, c0 FROM px WHERE x BETWEEN 5 AND 36 AND y BETWEEN 10 AND 29")
def region_extract(spark, sf):
    return cut.extract(gray(spark, sf), 5, 10, 32, 20, 64, 200)


@query(f"WITH {GRAY} SELECT y, string_agg(CAST(c0 AS VARCHAR), ',' ORDER BY x) AS line FROM px WHERE x BETWEEN 5 AND 36 AND y BETWEEN 10 AND 29 GROUP BY y")
def region_rows(spark, sf):
    return cut.rows_of(cut.region(gray(spark, sf), 5, 10, 32, 20, 64, 200)).select("y", F.array_join(F.transform("line", lambda v: v.cast("string")), ",").alias("line"))


@query(
    "SELECT format, b FROM (VALUES ('gray8', '10'), ('gray16', '2570'), ('rgb8', '10,20,30'), ('rgba8', '10,20,30,255'), ('rgb16', '2570,2570,2570'), "
    "('rgba16', '2570,2570,2570,2570')) v(format, b)"
)
def background_pixels(spark, sf):
    return spark.createDataFrame([(n, ",".join(map(str, cut.background(n, (10, 20, 30))))) for n, *_ in tm.PIXEL_FORMATS], "format string, b string")


# -- contents -------------------------------------------------------------------------------------


def blobs(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("body"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("body"))
    return docs.unionByName(pages).select("path", F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("bytes"))


BLOBS = (
    "blobs AS (SELECT path, sha256(coalesce(body, '')) AS digest, CAST(coalesce(strlen(body), 0) AS BIGINT) AS bytes FROM (SELECT 'doc/' || doc_id "
    "|| '.txt' AS path, text AS body FROM documents UNION ALL SELECT 'page/' || page_id || '.html', html FROM pages))"
)


@query(f"WITH {BLOBS} SELECT path, digest, bytes FROM blobs")
def tile_sha256(spark, sf):
    return blobs(spark, sf)


FILES = (
    "m AS (SELECT path, CASE WHEN bytes % 7 = 0 THEN upper(digest) ELSE digest END AS digest FROM blobs), f AS (SELECT path, CASE "
    "WHEN bytes % 5 = 0 THEN sha256(digest) ELSE digest END AS digest FROM blobs WHERE bytes % 11 <> 0), s AS (SELECT m.path, CASE "
    "WHEN f.path IS NULL THEN 'missing' WHEN lower(m.digest) = lower(f.digest) THEN 'ok' ELSE 'mismatched' END AS status FROM m LEFT "
    "JOIN f ON m.path = f.path)"
)


def _statuses(spark, sf) -> DataFrame:
    b, n = blobs(spark, sf), F.col("bytes")
    listed = b.select("path", F.when(n % 7 == 0, F.upper("digest")).otherwise(F.col("digest")).alias("digest"))
    files = b.where(n % 11 != 0).select("path", F.when(n % 5 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return contents.verified(listed, files)


@query(f"WITH {BLOBS}, {FILES} SELECT path, status FROM s")
def verify_statuses(spark, sf):
    return _statuses(spark, sf)


@query(
    f"WITH {BLOBS}, {FILES} SELECT count(*) AS tiles_checked, count(*) FILTER (status = 'ok') AS tiles_ok, "
    f"count(*) FILTER (status = 'mismatched') AS tiles_mismatched, count(*) FILTER (status = 'missing') AS tiles_missing FROM s"
)
def verify_report(spark, sf):
    return contents.verify_report(_statuses(spark, sf))


DECIDED = "d AS (SELECT *, CASE WHEN path = min(path) OVER (PARTITION BY digest) THEN 'write_new' ELSE 'reference' END AS decision FROM blobs)"


@query(f"WITH {BLOBS}, {DECIDED} SELECT path, digest, decision FROM d")
def dedupe_decisions(spark, sf):
    return contents.deduped(blobs(spark, sf), "digest", "path").select("path", "digest", "decision")


@query(f"WITH {BLOBS}, {DECIDED} SELECT path, '_shared/blank_' || digest || '.' || regexp_extract(path, '([a-z]+)$') AS shared_path FROM d WHERE decision = 'reference'")
def dedupe_references(spark, sf):
    return contents.references(contents.deduped(blobs(spark, sf), "digest", "path"), "digest", "path")


@query(f"WITH {BLOBS} SELECT count(DISTINCT digest) AS distinct_contents, count(*) AS items FROM blobs")
def distinct_contents(spark, sf):
    return contents.distinct_contents(blobs(spark, sf), "digest")


DONE = '(level * 7 + col * 3 + "row") % 4 < 3'


def _planned_and_done(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = planner.tiles(planner.levels(planner.plan(images(spark, sf, spread=True)))).select("image_id", "level", "col", "row")
    return t, t.where("(level * 7 + col * 3 + row) % 4 < 3")


@query(f'WITH {tiles_sql("deep_zoom", 256, 0, "true")} SELECT image_id, level, col, "row" FROM tl WHERE NOT ({DONE})')
def resume_remaining(spark, sf):
    return contents.remaining(*_planned_and_done(spark, sf))


@query(f'WITH {tiles_sql("deep_zoom", 256, 0, "true")} SELECT image_id, level, col, "row" FROM tl WHERE {DONE}')
def resume_completed(spark, sf):
    return contents.completed_of(*_planned_and_done(spark, sf))


@query(f'WITH {tiles_sql("deep_zoom", 256, 0, "true")} SELECT image_id, level FROM tl GROUP BY 1, 2 HAVING count(*) = count(*) FILTER ({DONE})')
def resume_levels_completed(spark, sf):
    return contents.levels_completed(*_planned_and_done(spark, sf))


@query("SELECT i AS attempt, least(50.0 * pow(2.0, i), 5000.0) AS wait_ms, least(10.0 * pow(2.0, i), 3000.0) AS short_ms FROM (SELECT unnest(range(12)) AS i)")
def backoff_schedule(spark, sf):
    return spark.range(12).select(F.col("id").alias("attempt"), tm.backoff_ms(F.col("id")).alias("wait_ms"), tm.backoff_ms(F.col("id"), 10.0, 2.0, 3000.0).alias("short_ms"))


# -- geo ------------------------------------------------------------------------------------------

AFFINE = (0.5, -0.25, 1000.0, 0.125, -0.5, 5000.0)


@query("SELECT s_suppkey, round(0.5 * s_suppkey - 0.25 * s_nationkey + 1000, 6) AS gx, round(0.125 * s_suppkey - 0.5 * s_nationkey + 5000, 6) AS gy FROM supplier")
def geo_forward(spark, sf):
    g = geo.pixel_to_geo(geo.transform(*AFFINE), F.col("s_suppkey"), F.col("s_nationkey"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(g["x"], 6).alias("gx"), F.round(g["y"], 6).alias("gy"))


@query(
    "WITH d AS (SELECT s_suppkey, s_acctbal - 1000 AS dx, s_nationkey - 5000.0 AS dy FROM supplier) SELECT s_suppkey, "
    "round((-0.5 * dx + 0.25 * dy) / -0.21875, 6) AS px, round((-0.125 * dx + 0.5 * dy) / -0.21875, 6) AS py, round(-0.5 / -0.21875, 9) AS inv_a FROM d"
)
def geo_inverse(spark, sf):
    t = geo.transform(*AFFINE)
    p = geo.geo_to_pixel(t, F.col("s_acctbal"), F.col("s_nationkey").cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(p["x"], 6).alias("px"), F.round(p["y"], 6).alias("py"), F.round(geo.inverse(t)["a"], 9).alias("inv_a"))


BOUNDS = (
    "b AS (SELECT image_id, least(1000, 1000 + 0.5 * width, 1000 - 0.25 * height, 1000 + 0.5 * width - 0.25 * height) AS min_x, greatest(1000, "
    "1000 + 0.5 * width, 1000 - 0.25 * height, 1000 + 0.5 * width - 0.25 * height) AS max_x, least(5000, 5000 + 0.125 * width, 5000 - 0.5 * height, "
    "5000 + 0.125 * width - 0.5 * height) AS min_y, greatest(5000, 5000 + 0.125 * width, 5000 - 0.5 * height, 5000 + 0.125 * width - 0.5 * height) AS max_y "
    "FROM img)"
)


@query(
    f"WITH {img_sql()}, {BOUNDS} SELECT image_id, CAST(min_x AS DOUBLE) AS min_x, CAST(min_y AS DOUBLE) AS min_y, CAST(max_x AS DOUBLE) AS max_x, "
    f"CAST(max_y AS DOUBLE) AS max_y, CAST(max_x - min_x AS DOUBLE) AS width, CAST(max_y - min_y AS DOUBLE) AS height, "
    f"CAST((min_x + max_x) / 2 AS DOUBLE) AS centre_x, CAST((min_y + max_y) / 2 AS DOUBLE) AS centre_y FROM b"
)
def geo_bounds(spark, sf):
    b = images(spark, sf).select("image_id", geo.image_bounds(geo.transform(*AFFINE), F.col("width").cast("double"), F.col("height").cast("double")).alias("b"))
    return b.select("image_id", "b.*", geo.extent(F.col("b")).alias("e")).select("image_id", "min_x", "min_y", "max_x", "max_y", "e.*")


@query("SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 12 AS inside FROM customer")
def geo_contains(spark, sf):
    box = F.struct(F.lit(0.0).alias("min_x"), F.lit(3.0).alias("min_y"), F.lit(5000.0).alias("max_x"), F.lit(12.0).alias("max_y"))
    return table(spark, sf, "customer").select("c_custkey", geo.contains(box, F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("inside"))


@query(
    "SELECT s_suppkey, 1.5 AS a, 0.25 AS b, CAST(s_suppkey AS DOUBLE) AS c, -0.5 AS d, 2.0 AS e, CAST(s_nationkey AS DOUBLE) AS f FROM supplier "
    "WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0"
)
def geo_control_points(spark, sf):
    """Transforms found again from three points; every third supplier's are collinear and have none."""
    x, y = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    line = F.col("s_suppkey") % 3 == 0
    px = [(F.lit(0.0), F.lit(0.0)), (F.lit(128.0), F.lit(0.0)), (F.when(line, 256.0).otherwise(0.0), F.when(line, 0.0).otherwise(64.0))]
    gs = [(1.5 * a + 0.25 * b + x, -0.5 * a + 2.0 * b + y) for a, b in px]
    return table(spark, sf, "supplier").select("s_suppkey", geo.from_control_points(px, gs).alias("t")).select("s_suppkey", *(F.round(F.col("t")[n], 9).alias(n) for n in geo.NAMES))


@query(
    "SELECT c_custkey, (c_nationkey + 0.5) * 256 * 0.5 - (c_custkey % 9 + 0.5) * 256 * 0.25 + 1000 AS gx, "
    "(c_nationkey + 0.5) * 256 * 0.125 - (c_custkey % 9 + 0.5) * 256 * 0.5 + 5000 AS gy FROM customer"
)
def geo_tile_centre(spark, sf):
    g = geo.tile_centre(geo.transform(*AFFINE), F.col("c_nationkey"), F.col("c_custkey") % 9, F.lit(256))
    return table(spark, sf, "customer").select("c_custkey", g["x"].alias("gx"), g["y"].alias("gy"))


# -- outputs --------------------------------------------------------------------------------------


@query("WITH " + img_sql() + """ SELECT image_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Image xmlns="http://schemas.microsoft.com/deepzoom/2008"' || chr(10) || '  Format="png"' || chr(10) || '  Overlap="1"' || chr(10) || '  TileSize="254">' || chr(10) || '  <Size Width="' || width || '" Height="' || height || '"/>' || chr(10) || '</Image>' AS dzi FROM img""")
def dzi_descriptors(spark, sf):
    return images(spark, sf).select("image_id", tm.dzi(F.lit("png"), F.lit(1), F.lit(254), F.col("width"), F.col("height")).alias("dzi"))


@query(ORACLE_SQL["tile_paths_all_layouts"].replace("layout, CASE layout", "layout, 'maps/site/img' || CASE layout WHEN 'deep_zoom' THEN '_files/' ELSE '/' END || CASE layout").replace("AS path", "AS key"))
def object_keys(spark, sf):
    p = tile_paths_all_layouts(spark, sf)
    return p.select("image_id", "level", "col", "row", "layout", tm.object_key(F.lit("/maps/site/"), F.lit("img"), F.col("layout"), F.col("path")).alias("key"))


@query(
    "SELECT p_partkey, name, CASE WHEN name LIKE '%.tar.gz' THEN left(name, length(name) - 7) "
    "WHEN name LIKE '%.tgz' OR name LIKE '%.tar' OR name LIKE '%.zip' THEN left(name, length(name) - 4) ELSE name END AS stem FROM (SELECT p_partkey, "
    "'plan' || p_partkey || list_extract(['.tar', '.tar.gz', '.tgz', '.zip', ''], CAST(p_partkey % 5 + 1 AS INTEGER)) AS name FROM part)"
)
def packfile_stems(spark, sf):
    name = F.concat(F.lit("plan"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".tar", ".tar.gz", ".tgz", ".zip", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("stem", tm.archive_stem(F.concat(F.lit("out/"), F.col("name"))))


@query(
    "SELECT p_partkey, (p_size % 4) * 90 - 720 AS rotate, (p_size % 4) * 90 AS degrees, "
    "CAST(trunc(CAST((100 + p_size) * 3 AS FLOAT) * CAST(2 AS FLOAT)) AS BIGINT) AS pixels FROM part"
)
def page_geometry(spark, sf):
    r = (F.col("p_size") % 4) * 90 - 720
    return table(spark, sf, "part").select("p_partkey", r.alias("rotate"), tm.page_rotation(r).alias("degrees"), tm.rendered_size((100 + F.col("p_size")) * 3, F.lit(144)).alias("pixels"))


@query(
    "WITH w AS (SELECT p_partkey, 100.0 + p_size * 40 AS pw, 200.0 + p_size * 20 AS ph FROM part) SELECT p_partkey, CASE WHEN big THEN greatest(1, "
    "CAST(floor(sqrt(1000000 / (pw * ph)) * 72) AS BIGINT)) ELSE 300 END AS dpi, big AS capped FROM (SELECT *, "
    "trunc(pw * 300 / 72.0) * trunc(ph * 300 / 72.0) > 1000000 AS big FROM w)"
)
def page_dpi_budget(spark, sf):
    w, h = 100.0 + F.col("p_size") * 40, 200.0 + F.col("p_size") * 20
    return table(spark, sf, "part").select("p_partkey", tm.budgeted_dpi(w, h, F.lit(300), F.lit(1_000_000)).alias("d")).select("p_partkey", "d.*")


STRIP_MATRIX = """
WITH r AS (SELECT p_partkey, p_size % 4 * 90 AS rot, 600.0 AS w, 800.0 AS h, 2.0 AS s, CAST(p_size AS DOUBLE) AS y FROM part),
m AS (SELECT p_partkey, rot, CASE rot
  WHEN 0 THEN [s, 0, 0, -s, 0, s * h - y] WHEN 90 THEN [0, s, s, 0, 0, -y]
  WHEN 180 THEN [-s, 0, 0, s, s * w, -y] ELSE [0, -s, -s, 0, s * w, s * h - y] END AS m FROM r)
SELECT p_partkey, rot, """ + ", ".join(f"CAST(m[{i}] AS DOUBLE) + 0.0 AS m{i}" for i in range(1, 7)) + " FROM m"


@query(STRIP_MATRIX)
def page_strip_matrix(spark, sf):
    rot = F.col("p_size") % 4 * 90
    m = tm.strip_matrix(rot, F.lit(2.0), F.lit(600.0), F.lit(800.0), F.col("p_size"))
    rows = table(spark, sf, "part").select("p_partkey", rot.alias("rot"), m.alias("m"))
    return rows.select("p_partkey", "rot", *((F.col("m")[i] + F.lit(0.0)).alias(f"m{i + 1}") for i in range(6)))


FLOAT = "CAST({} AS FLOAT)".format


def cmyk_sql(x: str, name: str) -> str:
    part = lambda v: f"({FLOAT(1)} - {FLOAT(v)} / {FLOAT(255)})"
    return f"CAST(trunc({part(x)} * {part('k')} * {FLOAT(255)}) AS INTEGER) AS {name}"


@query(
    "WITH v AS (SELECT CAST(i AS BIGINT) AS i, i % 256 AS c, i * 7 % 256 AS m, i * 13 % 256 AS y, i * 29 // 4 % 256 AS k FROM (SELECT unnest(range(2048)) AS i)) "
    f"SELECT i, {cmyk_sql('c', 'r')}, {cmyk_sql('m', 'g')}, {cmyk_sql('y', 'b')} FROM v"
)
def cmyk(spark, sf):
    v = F.col("id")
    return spark.range(2048).select(v.alias("i"), tm.cmyk_to_rgb(v % 256, v * 7 % 256, v * 13 % 256, tm.idiv(v * 29, 4) % 256).alias("p")).select("i", "p.*")


# -- runs -----------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS amount FROM events "
    "WHERE value IS NOT NULL), r AS (SELECT user_id, amount, sum(amount) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held "
    "FROM e) SELECT user_id, CAST(max(held) AS BIGINT) AS peak, CAST(sum(amount) AS BIGINT) AS held, count(*) AS events FROM r GROUP BY user_id"
)
def event_peaks(spark, sf):
    amount = F.floor("value").cast("long") * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return contents.running_peak(table(spark, sf, "events").where("value is not null").withColumn("amount", amount), "user_id", ["event_id"], "amount")


@query(
    "SELECT event_type AS kind, count(*) AS n, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS first_at, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS last_at "
    "FROM events GROUP BY 1"
)
def event_progress(spark, sf):
    at = manifest.timestamp(F.col("ts"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


@query(
    "WITH m AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '2' ELSE '1' END AS v, CAST(p_size AS BIGINT) AS s FROM part) SELECT p_partkey, CASE "
    "WHEN v = '1' THEN s END AS tile_size, CASE WHEN v = '1' THEN 'xyz' END AS layout, CASE WHEN v = '1' THEN s * 2 END AS tiles FROM m"
)
def manifest_json(spark, sf):
    """Manifest documents written as JSON and read back; unknown versions come back empty."""
    s = F.col("p_size").cast("long")
    doc = F.struct(
        F.when(F.col("p_size") % 10 == 0, "2").otherwise("1").alias("schema_version"),
        F.struct(s.alias("tile_size"), F.lit(0).alias("overlap"), F.lit("xyz").alias("layout")).alias("generation"),
        F.array(F.struct(F.lit(0).alias("level_index"), s.alias("tiles_produced")), F.struct(F.lit(1).alias("level_index"), s.alias("tiles_produced"))).alias("levels"),
        F.lit("kept aside").alias("unknown_field"),
    )
    back = table(spark, sf, "part").select("p_partkey", manifest.parsed(F.to_json(doc)).alias("m"))
    total = F.aggregate("m.levels", F.lit(0).cast("long"), lambda a, x: a + x["tiles_produced"])
    return back.select("p_partkey", F.col("m.generation.tile_size").alias("tile_size"), F.col("m.generation.layout").alias("layout"), total.alias("tiles"))


def _identities(spark, sf) -> DataFrame:
    """image_id and the bytes that tell its plan from others."""
    levels = planner.levels(planner.plan(images(spark, sf, "google", overlap=1, centre=True)))
    row = F.struct("level", "level_width", "level_height", "cols", "rows")
    keys = ["image_id", "width", "height", "tile_size", "overlap", "layout", "canvas_width", "canvas_height", "centre", "offset_x", "offset_y"]
    return hashing.plan_bytes_of(levels.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("levels")))


@query()
def plan_hashes(spark, sf):
    """The identity of every plan of the catalogue."""
    return _identities(spark, sf).select("image_id", hashing.digest(F.col("identity")).alias("plan_hash"))


def _le32(x: str) -> str:
    h = f"printf('%08x', CAST({x} AS BIGINT))"
    return " || ".join(f"substr({h}, {i}, 2)" for i in (7, 5, 3, 1))


_HEAD = [_le32(x) for x in ("width", "height", "256", "1")] + ["'03'"] + [_le32("canvas_width"), _le32("canvas_height"), "'01'", _le32("offset_x"), _le32("offset_y")]
PLAN_IDENTITY = (
    f"WITH {levels_sql('google', 256, True)}, l AS (SELECT image_id, "
    f"string_agg({' || '.join(_le32(x) for x in ('level', 'level_width', 'level_height', 'cols', 'rows'))}, '' ORDER BY level) AS body, count(*) AS n "
    f"FROM lv GROUP BY image_id) "
    f"SELECT image_id, sha256(unhex(hex('tilewright plan 1') || {' || '.join(_HEAD)} || {_le32('n')} || '00000000' || body)) AS sha256 FROM pl JOIN l USING (image_id)"
)


@query(PLAN_IDENTITY)
def plan_identity(spark, sf):
    """The same bytes under a digest that SQL has."""
    return _identities(spark, sf).select("image_id", F.sha2("identity", 256).alias("sha256"))


@query(f"WITH {GRAY}, n AS (SELECT count(*) AS hh FROM embeddings) SELECT y, x, c0 FROM px")
def png_round_trip(spark, sf):
    """Blocks encoded as PNG, decoded again, as pixels: the raster itself."""
    blocks = gray_blocks(spark, sf, 64)
    files = blocks.select(F.col("y0").cast("string").alias("path"), codec.encoded(F.col("data"), F.col("w"), F.col("h"), F.col("pixel_format")).alias("content"))
    back = codec.decoded(files).select(F.lit("vectors").alias("image_id"), F.lit(0).cast("long").alias("level"), F.col("path").cast("long").alias("y0"), F.lit(0).cast("long").alias("x0"), "h", "w", "pixel_format", "data")
    return resample.block_pixels(back, 1).select("y", "x", "c0")


@query(f"WITH {RGB.replace('301', '200').replace('211', '150').replace('512', '350')} SELECT y, x, c0, c1, c2 FROM px")
def strip_source(spark, sf):
    """A Python data source: a partition for each strip."""
    ship(spark)
    spark.dataSource.register(rasters.StripSource)
    blocks = spark.read.format("raster_strips").options(width="200", height="150", strip_height="32").load()
    return resample.block_pixels(blocks, 3).select("y", "x", "c0", "c1", "c2")


@query(
    f"WITH {GRAY}, k0 AS (SELECT y // 2 AS y, x // 2 AS x, {BOX.format(c='c0')} FROM px GROUP BY 1, 2) SELECT y, x, c0 FROM k0"
)
def strip_pairs(spark, sf):
    """Strips halved one by one and paired: the halved raster."""
    from .streaming import strips

    own = gray_blocks(spark, sf, 32).select("image_id", "level", tm.idiv(F.col("y0"), 32).alias("strip"), "h", "w", "pixel_format", "data")
    pairs = strips.paired(strips.halved(own))
    blocks = pairs.select("image_id", "level", (F.col("pair") * 32).alias("y0"), F.lit(0).cast("long").alias("x0"), "h", "w", "pixel_format", "data")
    return resample.block_pixels(blocks, 1).select("y", "x", "c0")


FLAGSHIP = [f"t{k} AS (SELECT CAST({3 - k} AS BIGINT) AS level, x // 16 AS col, y // 16 AS \"row\", count(*) AS n, CAST(sum(c0) AS BIGINT) AS s, min(c0) AS mn, max(c0) AS mx FROM k{k} GROUP BY 2, 3)" for k in range(4)]


@query(
    cascade_sql(GRAY, 3).split(" SELECT y, x, c0, CAST(3")[0] + ", " + ", ".join(FLAGSHIP)
    + ', u AS (' + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(4)) + ') SELECT level, col, "row", CAST(16 AS BIGINT) AS w, CAST(16 AS BIGINT) AS h, 256 - n AS n_pad, s + (256 - n) * 255 AS sum_c0, CASE WHEN n < 256 THEN mn = 255 AND mx = 255 ELSE mn = mx END AS blank FROM u'
)
def pyramid_tiles(spark, sf):
    """Raster, cascade, tiles with padding, sums and blank test, level by level."""
    return cut.tile_stats(resample.cascade(gray(spark, sf), 3, top=3), 64, 1, 16)


@query(
    "WITH w AS (SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS pixels FROM lineitem GROUP BY 1) SELECT l_suppkey, n, pixels, "
    "row_number() OVER (ORDER BY pixels DESC, l_suppkey) AS rank FROM w QUALIFY rank <= 10"
)
def largest_images(spark, sf):
    """The largest of a group, first on ties: the ten suppliers with the most."""
    w = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("pixels"))
    top = w.orderBy(F.desc("pixels"), "l_suppkey").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pixels"), "l_suppkey")).cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid_tiles(spark, sf_dir)


from . import catalog_jobs  # noqa: E402, F401  adds its queries to those above
