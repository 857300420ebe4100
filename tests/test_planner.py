import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.plans import planner

COLUMNS = "image_id long, width long, height long, tile_size long, overlap long, layout string, centre boolean"


def model(w, h, ts, ov, layout, centre):
    """Levels and tiles by plain loops."""
    ceil = lambda a, b: -(-a // b)
    if layout == "google":
        grid, n = max(ceil(w, ts), ceil(h, ts)), 1
        while (1 << (n - 1)) < grid:
            n += 1
        sizes = [(w, h)]
        for _ in range(n - 1):
            sizes.append((ceil(sizes[-1][0], 2), ceil(sizes[-1][1], 2)))
        levels = [(z, *s, 1 << z, 1 << z) for z, s in enumerate(reversed(sizes))]
    else:
        sizes = [(w, h)]
        while sizes[-1] != (1, 1):
            sizes.append((ceil(sizes[-1][0], 2), ceil(sizes[-1][1], 2)))
        levels = [(z, *s, ceil(s[0], ts), ceil(s[1], ts)) for z, s in enumerate(reversed(sizes))]
    tiles = []
    for z, lw, lh, cols, rows in levels:
        for r in range(rows):
            for c in range(cols):
                if layout == "google":
                    tiles.append((z, c, r, c * ts, r * ts, ts, ts))
                else:
                    x, y = (0 if c == 0 else c * ts - ov), (0 if r == 0 else r * ts - ov)
                    tiles.append((z, c, r, x, y, min((c + 1) * ts + ov, lw) - x, min((r + 1) * ts + ov, lh) - y))
    return levels, tiles


def test_levels_and_tiles_against_loops(spark):
    r = random.Random(5)
    images = [(i, r.randint(1, 700), r.randint(1, 700), ts := r.choice([16, 64, 100]), r.randint(0, 5), r.choice(["deep_zoom", "xyz", "google"]), r.random() < 0.5) for i in range(25)]
    images += [(25, 1, 1, 16, 0, "deep_zoom", False), (26, 256, 256, 256, 0, "google", True), (27, 500, 300, 256, 0, "google", True)]
    levels = planner.levels(planner.plan(planner.validated(spark.createDataFrame(images, COLUMNS))))
    got = {}
    for x in levels.select("image_id", "level", "level_width", "level_height", "cols", "rows").collect():
        got.setdefault(x[0], []).append(tuple(x[1:]))
    tiles = {}
    for x in planner.tiles(levels).select("image_id", "level", "col", "row", "x", "y", "w", "h").collect():
        tiles.setdefault(x[0], []).append(tuple(x[1:]))
    for i, w, h, ts, ov, layout, centre in images:
        a, b = model(w, h, ts, ov, layout, centre)
        assert sorted(got[i]) == a
        assert sorted(tiles[i]) == sorted(b)


def test_google_centre_offsets(spark):
    r = planner.plan(spark.createDataFrame([(1, 500, 300, 256, 0, "google", True)], COLUMNS)).first()
    assert (r.canvas_width, r.canvas_height, r.offset_x, r.offset_y) == (512, 512, 6, 106)
    r = planner.plan(spark.createDataFrame([(1, 16820, 11888, 256, 0, "google", True)], COLUMNS)).select("canvas_width", planner.peak_memory().alias("p")).first()
    assert (r.canvas_width, r.p) == (32768, 5094791936)


@pytest.mark.parametrize("bad", [(1, 0, 100, 256, 0, "xyz", False), (1, 100, 100, 0, 0, "xyz", False), (1, 100, 100, 256, 256, "xyz", False), (1, 9, 9, 8, 0, "spiral", False)])
def test_faults_raise(spark, bad):
    with pytest.raises(Exception, match="in image 1"):
        planner.plan(planner.validated(spark.createDataFrame([bad], COLUMNS))).collect()


def test_paths_and_back(spark):
    df = spark.createDataFrame([("deep_zoom", "3/4_5.png"), ("xyz", "3/4/5.png"), ("google", "3/4/5.png"), ("xyz", "3/4_5.png"), ("xyz", "x"), ("xyz", None)], "layout string, path string")
    got = [r.at for r in df.select(tm.parse_tile_path(F.col("layout"), F.col("path")).alias("at")).collect()]
    assert [tuple(g) if g else None for g in got] == [(3, 4, 5), (3, 4, 5), (3, 5, 4), None, None, None]


def test_odd_paths(spark):
    big = "99999999999999999999"
    cases = {
        ("deep_zoom", "03/4_5.png"): (3, 4, 5), ("deep_zoom", "3/4_5.png\n"): (3, 4, 5), ("google", "1/20/300.webp"): (1, 300, 20), ("other", "3/4/5.png"): (3, 4, 5),
        ("deep_zoom", f"3/{big}_5.png"): (3, None, 5), ("xyz", f"{big}/4/5.png"): (None, 4, 5), ("google", f"3/{big}/5.png"): (3, 5, None),
    } | dict.fromkeys([(None, "3/4/5.png"), (None, "3/4_5.png"), ("deep_zoom", "3/4/5.png"), ("xyz", "/4/5.png"), ("xyz", "3/4/5.tar.gz"), ("xyz", "3/4/5"), ("xyz", "-3/4/5.png"), ("xyz", " 3/4/5.png"), ("google", "2/3/4/5.png"), ("deep_zoom", "3/4_5_6.png"), ("xyz", "")])
    df = spark.createDataFrame(list(cases), "layout string, path string")
    got = {(r.layout, r.path): tuple(r.at) if r.at else None for r in df.select("*", tm.parse_tile_path(F.col("layout"), F.col("path")).alias("at")).collect()}
    assert got == cases


def test_strip_memory_against_loop(spark):
    def loop(w, h, bpp):
        total = 0
        while True:
            total += 2 * w * h * bpp
            w, h = -(-w // 2), -(-h // 2)
            if h <= 1 or w <= 1:
                total += w * h * bpp
                return total + total // 10

    images = [(w, w, 4096, 64, 0, "xyz", False) for w in (1, 2, 3, 64, 1000, 4097)]
    for r in planner.plan(spark.createDataFrame(images, COLUMNS)).select("width", planner.strip_memory(F.lit("rgba8"), F.lit(128)).alias("m")).collect():
        assert r.m == loop(r.width, 128, 4)


def test_backoff_and_dpi(spark):
    got = [r.w for r in spark.range(5).orderBy("id").select(tm.backoff_ms(F.col("id"), 10.0).alias("w")).collect()]
    assert got == [10, 20, 40, 80, 160]
    r = spark.range(1).select(tm.strip_dpi(F.lit(612.0), F.lit(300), F.lit(10), F.lit(512), F.lit(1_000_000)).alias("a"), tm.strip_dpi(F.lit(612.0), F.lit(300), F.lit(200), F.lit(512), F.lit(1_000_000)).alias("b")).first()
    assert (r.a, r.b) == (57, None)
    with pytest.raises(Exception, match="unsupported rotation"):
        spark.range(1).select(tm.page_rotation(F.lit(45))).collect()
