import io
import json
import os
import shutil
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo, hashing
from tilewright.operators import contents, resample, tiles as cut
from tilewright.plans import job as job_module, manifest, verification
from tilewright.plans.job import PyramidJob
from tilewright.sources import codec, jpeg, pages, rasters, sinks

rng = np.random.default_rng(3)


def pixels(spark, x):
    h, w, c = x.shape
    y, z = np.mgrid[0:h, 0:w]
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel(), "x": z.ravel()} | {f"c{i}": x[..., i].ravel().astype(np.int64) for i in range(c)}))


def image(df, h, w, c):
    out = np.full((h, w, c), -1, np.int64)
    for r in df.collect():
        out[r.y, r.x] = [r[f"c{i}"] for i in range(c)]
    return out


def blocks(spark, x, name, side, top=0):
    rows = [("i", top, a, b, *(p := x[a : a + side, b : b + side]).shape[:2], name, np.ascontiguousarray(p).tobytes()) for a in range(0, x.shape[0], side) for b in range(0, x.shape[1], side)]
    return spark.createDataFrame(rows, resample.BLOCK_SCHEMA)


@pytest.mark.parametrize(("h", "w", "name"), [(5, 7, "gray8"), (8, 3, "rgb8"), (9, 9, "rgba8"), (1, 4, "rgb16"), (6, 5, "rgba16")])
def test_halving_of_pixels_blocks_and_by_hand(spark, h, w, name):
    c, kind = resample.DTYPES[name]
    x = rng.integers(0, 1 << (16 if kind == "<u2" else 8), (h, w, c)).astype(kind)
    if c == 4:
        x[: h // 2, :, 3] = 0
    hand = np.zeros((-(-h // 2), -(-w // 2), c), np.int64)
    for y in range(hand.shape[0]):
        for z in range(hand.shape[1]):
            box = x[2 * y : 2 * y + 2, 2 * z : 2 * z + 2].reshape(-1, c).astype(int)
            n = len(box)
            if c < 4:
                hand[y, z] = [(int(s) + n // 2) // n for s in box.sum(0)]
            else:
                a = box[:, 3].sum() / n
                hand[y, z] = [0] * 4 if a == 0 else [*(int((box[:, k] * box[:, 3]).sum() / (n * a)) for k in range(3)), int(a)]
    assert (resample.halve_array(x, c == 4) == hand).all()
    assert (image(resample.halve(pixels(spark, x), c == 4), *hand.shape) == hand).all()


def test_cascade_in_blocks_is_the_global_cascade(spark):
    x = rng.integers(0, 256, (61, 83, 3)).astype(np.uint8)
    want = image(resample.cascade(pixels(spark, x), 3, top=3).where("level = 0").drop("level"), 8, 11, 3)
    got = resample.block_pixels(resample.block_cascade(blocks(spark, x, "rgb8", 16, 3), 3), 3).where("level = 0")
    assert (image(got, 8, 11, 3) == want).all()
    with pytest.raises(Exception, match="not aligned"):
        resample.block_cascade(blocks(spark, x, "rgb8", 12, 3), 3).collect()


@pytest.mark.parametrize("to", [(20, 17), (7, 50), (64, 50), (1, 1)])
def test_downscale_to(spark, to):
    x, (tw, th) = rng.integers(0, 256, (50, 64, 1)), to
    got = image(resample.downscale_to(pixels(spark, x), 64, 50, tw, th), th, tw, 1)
    for dy in range(th):
        for dx in range(tw):
            box = x[dy * 50 // th : -(-(dy + 1) * 50 // th), dx * 64 // tw : -(-(dx + 1) * 64 // tw)]
            assert got[dy, dx, 0] == (int(box.sum()) + box.size // 2) // box.size


@pytest.mark.parametrize(("overlap", "google"), [(0, False), (3, False), (0, True)])
def test_tile_stats(spark, overlap, google):
    x = rng.integers(0, 256, (37, 50, 1))
    x[:16, 16:32] = 7
    got = {(r.col, r.row): r for r in cut.tile_stats(pixels(spark, x), 50, 37, 16, overlap, google).collect()}
    for col in range(4):
        for row in range(3):
            part = x[max(0, row * 16 - overlap) : (row + 1) * 16 + overlap, max(0, col * 16 - overlap) : (col + 1) * 16 + overlap, 0]
            if not overlap:
                full = np.full((16, 16), 255)
                full[: part.shape[0], : part.shape[1]] = part
                part = full
            r = got[col, row]
            assert (r.h, r.w, r.sum_c0, r.blank) == (*part.shape, part.sum(), bool((part == part[0, 0]).all()))


def test_canvas_region_and_background(spark):
    x = rng.integers(0, 256, (3, 4, 1))
    want = np.full((6, 8, 1), 9)
    want[1:4, 2:6] = x
    assert (image(cut.embed(pixels(spark, x), 2, 1, 8, 6, (9,)), 6, 8, 1) == want).all()
    assert (image(cut.extract(pixels(spark, x), 1, 1, 2, 2, 4, 3), 2, 2, 1) == x[1:3, 1:3]).all()
    with pytest.raises(ValueError):
        cut.region(pixels(spark, x), 3, 0, 2, 2, 4, 3)
    assert cut.background("rgb16", (1, 2, 3)) == (257, 257, 257)


@pytest.mark.parametrize("name", list(resample.DTYPES))
def test_png_round_trip(name):
    c, kind = resample.DTYPES[name]
    x = rng.integers(0, 1 << (16 if kind == "<u2" else 8), (5, 9, c)).astype(kind)
    assert codec.decode_png(codec.encode_png(x.tobytes(), 9, 5, name)) == (9, 5, name, x.tobytes())


def test_png_filters():
    x = rng.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    rows, above = [], np.zeros(18, np.uint8)
    for y, kind in enumerate((1, 2, 3, 4)):
        row = x[y].reshape(-1)
        left, corner = np.concatenate((np.zeros(3, np.uint8), row[:-3])), np.concatenate((np.zeros(3, np.uint8), above[:-3]))
        a, b, c = (v.astype(int) for v in (left, above, corner))
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]
        rows.append(bytes([kind]) + ((row.astype(int) - guess) % 256).astype(np.uint8).tobytes())
        above = row
    part = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    data = codec.PNG + part(b"IHDR", struct.pack(">2I5B", 6, 4, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")
    assert codec.decode_png(data)[3] == x.tobytes()


def test_decoding_keeps_errors_as_rows(spark):
    good = codec.encode_png(bytes(6), 3, 2, "gray8")
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"junk")), ("c", bytearray(b"")), ("d", None), ("e", bytearray(good[:40]))], "path string, content binary")
    got = {r.path: r for r in codec.decoded(df).collect()}
    assert (got["a"].w, got["a"].h, got["a"].error) == (3, 2, None)
    assert all(got[k].data is None and got[k].error for k in "bcde")


def plain_blake3(data, chunk=0, flags=8):
    """BLAKE3 block by block, after its specification."""
    m32 = 0xFFFFFFFF

    def compress(cv, block, counter, length, flags):
        m, v = list(struct.unpack("<16I", block.ljust(64, b"\0"))), [*cv, *hashing.IV[:4], counter & m32, counter >> 32, length, flags]

        def mix(a, b, c, d, x, y):
            for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
                v[a] = (v[a] + v[b] + word) & m32
                t = v[d] ^ v[a]
                v[d] = (t >> r1 | t << (32 - r1)) & m32
                v[c] = (v[c] + v[d]) & m32
                t = v[b] ^ v[c]
                v[b] = (t >> r2 | t << (32 - r2)) & m32

        for _ in range(7):
            for i in range(4):
                mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
            for i in range(4):
                mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
            m = [m[k] for k in hashing.PERMUTATION]
        return [v[i] ^ v[i + 8] for i in range(8)]

    if len(data) <= 1024:
        cv, n = hashing.IV, max(1, -(-len(data) // 64))
        for i in range(n):
            block = data[64 * i : 64 * i + 64]
            cv = compress(cv, block, chunk, len(block), (1 if i == 0 else 0) | ((2 | flags) if i == n - 1 else 0))
        return cv
    left = 1 << ((len(data) - 1) // 1024).bit_length() - 1
    a, b = plain_blake3(data[: left * 1024], chunk, 0), plain_blake3(data[left * 1024 :], chunk + left, 0)
    return compress(hashing.IV, struct.pack("<16I", *a, *b), 0, 64, 4 | flags)


def test_blake3_of_many_values():
    values = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 7168, 8193)]
    assert hashing.blake3_all(values) == [struct.pack("<8I", *plain_blake3(v)).hex() for v in values] and hashing.blake3_all([]) == []


def test_digests(spark):
    assert hashing.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    r = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(hashing.digest(F.col("b"), "sha256").alias("s"), hashing.digest(F.col("b")).alias("h")).first()
    assert r.s == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and r.h == hashing.blake3_hex(b"abc")


def test_geo(spark):
    t = geo.transform(1.5, 0.25, 10.0, -0.5, 2.0, 20.0)
    flat = geo.transform(1.0, 2.0, 0.0, 2.0, 4.0, 0.0)
    g = geo.pixel_to_geo(t, F.lit(3.0), F.lit(4.0))
    r = spark.range(1).select(g.alias("g"), geo.geo_to_pixel(t, g["x"], g["y"]).alias("p"), geo.inverse(flat).alias("n"), geo.geo_to_pixel(flat, F.lit(1.0), F.lit(1.0)).alias("m")).first()
    assert tuple(r.g) == (15.5, 26.5) and np.allclose(tuple(r.p), (3, 4)) and r.n is None and r.m is None


def test_contents(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "path string, digest string")
    got = {r.path: r.decision for r in contents.deduped(df, "digest", "path").collect()}
    assert got == {"a": "write_new", "b": "reference", "c": "write_new"}
    files = spark.createDataFrame([("a", "X"), ("c", "z")], "path string, digest string")
    r = contents.verify_report(contents.verified(df, files)).first()
    assert tuple(r) == (3, 1, 1, 1)
    assert tuple(contents.verify_report(contents.verified(df.limit(0), files)).first()) == (0, 0, 0, 0)


def test_retries():
    waits, left = [], [2]

    def write():
        if left[0]:
            left[0] -= 1
            raise OSError("busy")

    policy = sinks.RetryPolicy(jitter=False)
    assert sinks.attempt(write, policy, "retry_then_fail", None, waits.append) == (2, True)
    assert waits == [0.05, 0.1]
    left[0] = 99
    assert sinks.attempt(write, policy, "retry_then_skip", None, waits.append) == (3, False)
    with pytest.raises(OSError):
        sinks.attempt(write, policy, "fail_fast", None, waits.append)


def pdf(parts):
    out = b"%PDF-1.4\n"
    for i, p in enumerate(parts, 1):
        out += f"{i} 0 obj\n".encode() + p + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf(spark):
    gray = zlib.compress(bytes(range(12)))
    small = b"<< /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray >>\nstream\n\x05\nendstream"
    doc = pdf([
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Rotate 90 /MediaBox [0 0 200 100] >>",
        b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /A 6 0 R /B 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Rotate -360 >>",
        b"<< /Subtype /Image /Width 4 /Height 3 /ColorSpace /DeviceGray /Filter /FlateDecode /Length " + str(len(gray)).encode() + b" >>\nstream\n" + gray + b"\nendstream", small,
    ])
    assert pages.page_facts(doc) == [(1, 100.0, 200.0, 90, True), (2, 200.0, 100.0, 0, False)]
    assert pages.page_image(doc, 1) == (4, 3, "gray8", bytes(range(12)))
    for n in (0, 2, 3):
        with pytest.raises(pages.PageError):
            pages.page_image(doc, n)
    df = spark.createDataFrame([("a", bytearray(doc)), ("b", bytearray(b"no"))], "path string, content binary")
    got = pages.pdf_info(df).orderBy("path", "page_number").collect()
    assert [(r.path, r.page_number, r.error is None) for r in got] == [("a", 1, True), ("a", 2, True), ("b", None, False)]


def test_cmyk_image():
    doc = pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Resources << /XObject << /A 4 0 R >> >> >>", b"<< /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceCMYK >>\nstream\n\xff\x00\x00\x00\nendstream"])
    assert pages.page_image(doc, 1) == (1, 1, "rgb8", b"\x00\xff\xff")


def test_jpeg_image_of_a_page():
    x = np.broadcast_to(np.arange(16, dtype=np.uint8)[:, None, None] * 9, (16, 24, 1))
    data = jpeg.encode(x, 95)
    for filters, raw in ((b"/DCTDecode", data), (b"[/FlateDecode /DCTDecode]", zlib.compress(data))):
        head = b"<< /Subtype /Image /Width 24 /Height 16 /ColorSpace /DeviceGray /Filter " + filters + b" /Length " + str(len(raw)).encode() + b" >>\nstream\n" + raw + b"\nendstream"
        doc = pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Resources << /XObject << /A 4 0 R >> >> >>", head])
        w, h, name, samples = pages.page_image(doc, 1)
        assert (w, h, name) == (24, 16, "gray8") and np.abs(np.frombuffer(samples, np.uint8).reshape(16, 24, 1).astype(int) - x).max() <= 3


def test_manifest():
    text = json.dumps(manifest.build({"tile_size": 1}, {"width": 1}, [], "now") | {"more": 1})
    assert manifest.read(text)["generation"] == {"tile_size": 1}
    for bad in ("{", json.dumps({"schema_version": "2"})):
        with pytest.raises(manifest.ManifestError):
            manifest.read(bad)
    state = manifest.checkpoint("h", [(0, 0, 0)], [0], "a", "b")
    assert manifest.read_checkpoint(state, "h")["completed_tiles"] == [(0, 0, 0)] and manifest.read_checkpoint(None, "h") is None
    with pytest.raises(manifest.ManifestError, match="another plan"):
        manifest.read_checkpoint(state, "g")


def reference_tiles(x, job, layers, fill=255):
    out, size = {}, job.tile_size
    for level, y in layers.items():
        h, w, c = y.shape
        cols, rows = (1 << level, 1 << level) if job.layout == "google" else (-(-w // size), -(-h // size))
        for col in range(cols):
            for row in range(rows):
                o = 0 if job.layout == "google" else job.overlap
                part = y[max(0, row * size - o) : (row + 1) * size + o, max(0, col * size - o) : (col + 1) * size + o]
                if job.layout == "google" or not o:
                    full = np.full((size, size, c), fill, y.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                out[level, col, row] = part.tobytes()
    return out


@pytest.mark.parametrize(("layout", "overlap", "side"), [("deep_zoom", 0, 16), ("deep_zoom", 0, 64), ("deep_zoom", 2, 16), ("google", 0, 32)])
def test_job_tiles(spark, layout, overlap, side):
    x = rng.integers(0, 256, (70, 90, 3)).astype(np.uint8)
    job = PyramidJob(90, 70, 16, overlap, layout)
    levels = job.levels(spark)
    layers, now = {}, x
    for r in reversed(levels):
        layers[r.level] = now
        now = resample.halve_array(now, False)
    got = {(r.level, r.col, r.row): bytes(r.data) for r in job.tiles(blocks(spark, x, "rgb8", side)).collect()}
    assert got == reference_tiles(x, job, layers)


@pytest.mark.parametrize(
    ("layout", "overlap", "centre", "name", "side"),
    [("deep_zoom", 3, False, "rgb8", 40), ("deep_zoom", 0, False, "gray16", 48), ("deep_zoom", 1, True, "rgb8", 16), ("google", 0, True, "rgba8", 33), ("xyz", 2, True, "gray8", 64), ("google", 2, False, "gray8", 16)],
)
def test_job_tiles_in_squares(spark, monkeypatch, layout, overlap, centre, name, side):
    """Squares of two tiles, so that margins, offsets and later phases matter."""
    monkeypatch.setattr(job_module, "SQUARE_BYTES", 1)
    c, kind = resample.DTYPES[name]
    x = rng.integers(0, 1 << (16 if kind == "<u2" else 8), (130, 171, c)).astype(kind)
    job = PyramidJob(171, 130, 16, overlap, layout, centre, name)
    levels, fill = job.levels(spark), cut.background(name)
    now = x
    if centre:
        top = levels[-1]
        now = np.broadcast_to(np.array(fill, x.dtype), (top.canvas_height, top.canvas_width, c)).copy()
        now[top.offset_y : top.offset_y + 130, top.offset_x : top.offset_x + 171] = x
    layers = {}
    for r in reversed(levels):
        layers[r.level] = now
        now = resample.halve_array(now, c == 4)
    rows = job.tiles(blocks(spark, x, name, side)).collect()
    got = {(r.level, r.col, r.row): bytes(r.data) for r in rows}
    want = {k: v for k, v in reference_tiles(layers[levels[-1].level], job, layers, fill).items() if any(k[0] == r.level and k[1] < r.cols and k[2] < r.rows for r in levels)}
    assert len(rows) == len(got) == sum(r.cols * r.rows for r in levels) and got == want


def failing(out, path):
    """A folder where a tile's file should be: it can't be written."""
    os.makedirs(f"{out}/{path}/x")
    return lambda: (os.rmdir(f"{out}/{path}/x"), os.rmdir(f"{out}/{path}"))


@pytest.mark.parametrize("square", [1, 1 << 20])
def test_a_tile_that_cannot_be_written_is_not_done(spark, tmp_path, monkeypatch, square):
    monkeypatch.setattr(job_module, "SQUARE_BYTES", square)
    x = rng.integers(0, 256, (60, 60, 1)).astype(np.uint8)
    source, out = blocks(spark, x, "gray8", 16), str(tmp_path / "img")
    job = PyramidJob(60, 60, 16, pixel_format="gray8").with_checksums("blake3").with_failure_policy("retry_then_skip").with_retry(1, 1.0).with_resume("resume")
    assert job.settings["failures"] == "retry_then_skip"
    os.makedirs(out)
    mend, total = failing(out, "6/2_1.png"), sum(r.cols * r.rows for r in job.levels(spark))
    first = job.run(source, out)
    assert (first["tiles_produced"], first["skipped_due_to_failure"], first["retry_count"]) == (total - 1, 1, 1)
    m, state = manifest.read(open(out + "/manifest.json").read()), json.loads(open(out + "/.checkpoint.json").read())
    assert "6/2_1.png" not in m["checksums"]["per_tile"] and len(m["checksums"]["per_tile"]) == total - 1
    assert [v["tiles_skipped"] for v in m["levels"]] == [0] * 6 + [1]
    assert {"level": 6, "col": 2, "row": 1} not in state["completed_tiles"] and state["levels_completed"] == list(range(6))
    mend()
    again = job.run(source, out)
    assert again["tiles_produced"] == 1 and os.path.isfile(out + "/6/2_1.png") and job.with_resume("verify").run(source, out)["ok"] == total
    assert json.loads(open(out + "/.checkpoint.json").read())["levels_completed"] == list(range(7))
    assert not [n for n in os.listdir(out) if n.startswith(".work")]


def test_a_run_that_failed_goes_on(spark, tmp_path):
    x = rng.integers(0, 256, (60, 60, 1)).astype(np.uint8)
    source, out = blocks(spark, x, "gray8", 32), str(tmp_path / "img")
    job = PyramidJob(60, 60, 16, pixel_format="gray8").with_format("raw").with_checksums("sha256", "verify").with_resume("resume", checkpoint_every=1)
    os.makedirs(out)
    mend = failing(out, "6/3_3.raw")
    with pytest.raises(Exception, match="3_3|directory"):
        job.run(source, out)
    assert not os.path.exists(out + "/manifest.json")
    mend()
    total = sum(r.cols * r.rows for r in job.levels(spark))
    again = job.run(source, out)
    assert 0 < again["tiles_produced"] < total and job.with_resume("verify").run(source, out)["ok"] == total
    # a checkpoint that another program wrote, without the writers' files
    state = open(out + "/.checkpoint.json").read()
    shutil.rmtree(out + "/.checkpoint.d")
    assert job.run(source, out)["tiles_produced"] == 0 and json.loads(open(out + "/.checkpoint.json").read())["completed_tiles"] == json.loads(state)["completed_tiles"]
    assert PyramidJob(60, 60, 16, pixel_format="gray8").with_format("raw").run(source, out)["tiles_produced"] == total


def test_verification(spark, tmp_path):
    x = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    source = blocks(spark, x, "rgb8", 16)
    for kind, algorithm in (("png", "sha256"), ("jpeg", None), ("raw", "blake3")):
        out = str(tmp_path / kind)
        job = PyramidJob(40, 40, 16).with_format(kind)
        job = job.with_checksums(algorithm) if algorithm else job
        job.run(source, out)
        n = sum(r.cols * r.rows for r in job.levels(spark))
        assert job.with_resume("verify").run(source, out)["ok"] == n
        report = verification.verify_output(spark, out)
        assert tuple(report) == ((n, n, 0, 0) if algorithm else (0, 0, 0, 0))
        path = f"{out}/6/1_1.{kind}"
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 255
        open(path, "wb").write(data)
        os.remove(f"{out}/5/0_0.{kind}")
        got = job.with_resume("verify").run(source, out)
        assert (got["ok"], got["missing"], got["mismatched"]) == (n - 2, 1, 1)
        if algorithm:
            assert tuple(verification.verify_output(spark, out)) == (n, n - 2, 1, 1)
        with pytest.raises(manifest.ManifestError, match="another plan"):
            PyramidJob(40, 40, 8).with_resume("verify").run(source, out)
    with pytest.raises(verification.ManifestNotFound):
        verification.verify_output(spark, str(tmp_path / "nothing"))
    os.remove(str(tmp_path / "png.manifest.json"))
    assert verification.verify_output(spark, str(tmp_path / "png")).tiles_checked > 0


def test_events_and_builder(spark, tmp_path):
    x = rng.integers(0, 256, (40, 40, 1)).astype(np.uint8)
    seen = job_module.Collecting()
    job = PyramidJob(40, 40, 16, pixel_format="gray8").with_config(engine="streaming", concurrency=1, buffer_size=2, memory_budget=(1 << 20, "auto_adjust"), format=("jpeg", 70), source_hash=True).with_observer(seen)
    out = str(tmp_path / "img")
    result = job.run_source(spark, lambda s: blocks(s, x, "gray8", 16), out, "memory")
    n = sum(r.cols * r.rows for r in job.levels(spark))
    kinds = [e["kind"] for e in seen]
    assert kinds[:3] == ["SourceLoadStarted", "SourceLoaded", "PlanCreated"] and kinds[-2:] == ["Finished", "PipelineComplete"] and kinds.count("TileCompleted") == n
    assert kinds.count("LevelStarted") == kinds.count("LevelCompleted") == 7 and kinds.count("BatchStarted") == kinds.count("BatchCompleted") >= 1
    assert result["bytes_read"] == 1600 and result["peak_memory_bytes"] == 256 and result["duration"] > 0
    m = manifest.read(open(out + "/manifest.json").read())
    assert m["generation"]["format"] == {"kind": "jpeg", "quality": 70} and len(m["source"]["bytes_hash"]) == 64
    counters, rows = PyramidJob(40, 40, 16, pixel_format="gray8").run_collect(blocks(spark, x, "gray8", 16), out)
    assert counters["tiles_produced"] == len(rows) == n and os.path.isfile(out + "/6/0_0.png") and not os.path.exists(out + "/6/0_0.jpeg")
    with pytest.raises(ValueError, match="unknown setting"):
        job.with_config(colour="red")


class Store:
    """An object store in a folder, that fails on its first write of a key that ends with _1.raw."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, path, data):
        key = os.path.join(self.folder, path.replace("/", "+"))
        if path.endswith("_1.raw") and not os.path.exists(key + ".once"):
            open(key + ".once", "w").close()
            raise OSError("busy")
        with open(key, "wb") as f:
            f.write(data)


def test_a_sink_of_the_users(spark, tmp_path):
    x = rng.integers(0, 256, (40, 40, 1)).astype(np.uint8)
    job = PyramidJob(40, 40, 16, pixel_format="gray8").with_format("raw").with_retry(2, 1.0).with_sink(Store(str(tmp_path)))
    result = job.run(blocks(spark, x, "gray8", 16), str(tmp_path / "img"))
    keys = [n for n in os.listdir(tmp_path) if n.endswith(".raw")]
    assert len(keys) == result["tiles_produced"] == sum(r.cols * r.rows for r in job.levels(spark)) and result["retry_count"] > 0
    assert open(tmp_path / "6+0_0.raw", "rb").read() == x[:16, :16].tobytes() and not os.path.exists(tmp_path / "img/6") and os.path.exists(tmp_path / "img/manifest.json")
    with pytest.raises(ValueError, match="need files"):
        job.with_dedupe("blanks").run(blocks(spark, x, "gray8", 16), str(tmp_path / "img"))


def test_links_and_slow_writers(spark, tmp_path):
    x = np.zeros((32, 48, 1), np.uint8)
    out, job = str(tmp_path / "img"), PyramidJob(48, 32, 16, pixel_format="gray8").with_format("raw").with_dedupe("blanks", links=True)
    job.run(blocks(spark, x, "gray8", 16), out)
    refs = manifest.read(open(out + "/manifest.json").read())["blank_references"]
    assert len(refs) > 3 and all(os.path.islink(f"{out}/{p}") and open(f"{out}/{p}", "rb").read() == bytes(256) for p in refs)
    assert job.with_resume("verify").run(blocks(spark, x, "gray8", 16), out)["mismatched"] == 0
    spark.dataSource.register(sinks.TileDirectory)
    rows = [(f"1/{i}.raw", bytearray(b"abc"), i == 1) for i in range(3)]
    spark.createDataFrame(rows, "path string, data binary, blank boolean").coalesce(1).write.format("tile_directory").mode("append").option("path", out).option("delay_ms", "20").save()
    assert open(out + "/1/1.raw", "rb").read() == b"\0" and json.load(open(out + "/_committed.json"))["tiles"] == 3
    assert "secret" not in repr(sinks.ObjectConfig(bucket="b", secret_key="secret"))
    with pytest.raises(ValueError, match="put"):
        sinks.write_objects(None, None)


def test_job_run_resume_verify_and_archives(spark, tmp_path):
    x = np.full((40, 40, 1), 9, np.uint8)
    x[:16, :16, 0] = rng.integers(0, 256, (16, 16))
    source, out, seen = blocks(spark, x, "gray8", 16), str(tmp_path / "img"), []
    job = PyramidJob(40, 40, 16, pixel_format="gray8").with_format("raw").with_blank_strategy("placeholder").with_checksums("sha256").with_observer(seen.append)
    first = job.run(source, out)
    n = len(job.tiles(source).collect())
    assert first["tiles_produced"] == n and first["tiles_skipped"] > 0 and seen[-1]["kind"] == "Finished"
    m = manifest.read(open(out + "/manifest.json").read())
    assert sum(v["tiles_produced"] + v["tiles_skipped"] for v in m["levels"]) == n and len(m["checksums"]["per_tile"]) == n
    assert open(out + ".dzi").read().startswith("<?xml") and open(out + "/6/1_1.raw", "rb").read() == b"\x00"
    assert job.with_resume("resume").run(source, out)["tiles_produced"] == 0
    assert job.with_resume("verify").run(source, out)["ok"] == n
    os.remove(out + "/6/0_0.raw")
    assert job.with_resume("verify").run(source, out)["missing"] == 1
    with pytest.raises(manifest.ManifestError):
        PyramidJob(40, 40, 8, pixel_format="gray8").with_resume("resume").run(source, out)
    written = job.archive(source, str(tmp_path / "a.tar.gz"), "a")
    with tarfile.open(tmp_path / "a.tar.gz") as t:
        assert len(t.getnames()) == 2 * written + 2 < 2 * n and t.getnames()[-2:] == ["manifest.json", "a.dzi"]
        assert json.loads(t.extractfile("manifest.json").read())["levels"][0] == {"level": 0, "width": 1, "height": 1, "cols": 1, "rows": 1}
    job.archive(source, str(tmp_path / "a.zip"), "a")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "a.zip").read_bytes())) as z:
        assert len(z.namelist()) == 2 * written + 2


def test_job_dedupe(spark, tmp_path):
    x = np.zeros((32, 48, 1), np.uint8)
    x[:, 16:32] = 5
    x[16:, 32:, 0] = x[:16, 32:, 0] = rng.integers(0, 256, (16, 16))
    source = blocks(spark, x, "gray8", 16)
    for strategy, n in (("blanks", 2), ("all_content", 3)):
        out, job = str(tmp_path / strategy), PyramidJob(48, 32, 16, pixel_format="gray8").with_format("raw").with_dedupe(strategy)
        job.run(source, out)
        refs = {k: v for k, v in manifest.read(open(out + "/manifest.json").read())["blank_references"].items() if k.startswith("6/")}
        assert len(refs) == n
        for path, shared in refs.items():
            _, col, row = path.replace("_", "/").removesuffix(".raw").split("/")
            assert open(f"{out}/{path}", "rb").read() == b"\x00"
            assert open(f"{out}/{shared}", "rb").read() == x[int(row) * 16 : int(row) * 16 + 16, int(col) * 16 : int(col) * 16 + 16].tobytes()
        assert job.with_resume("verify").run(source, out)["mismatched"] == 0


def test_budget_and_settings(spark):
    with pytest.raises(ValueError, match="budget"):
        PyramidJob(10_000, 10, 256).with_memory_budget(1000).levels(spark)
    for bad in (lambda j: j.with_engine("x"), lambda j: j.with_failure_policy("x"), lambda j: j.with_dedupe("x"), lambda j: j.with_resume("x")):
        with pytest.raises(ValueError):
            bad(PyramidJob(1, 1))


@pytest.mark.parametrize("height", [48, 40, 37])
def test_strips_as_a_stream(spark, tmp_path, height):
    from tilewright.streaming import strips

    x = rng.integers(0, 256, (height, 5, 1)).astype(np.uint8)
    n = -(-height // 8)
    rows = [("i", 3, k, min(8, height - 8 * k), 5, "gray8", x[8 * k : 8 * k + 8].tobytes()) for k in (1, 0, 2, 5, 4, 3) if k < n]
    want = resample.halve_array(x, False)
    batch = strips.paired(strips.halved(spark.createDataFrame(rows, strips.STRIP_SCHEMA))).orderBy("pair").collect()
    assert b"".join(bytes(r.data) for r in batch) == want.tobytes()
    for i, r in enumerate(rows):
        spark.createDataFrame([r], strips.STRIP_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(strips.STRIP_SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    q = strips.paired_stream(strips.halved(stream), F.lit(n)).writeStream.format("memory").queryName(f"pairs{height}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table(f"pairs{height}").orderBy("pair").collect()
    assert b"".join(bytes(r.data) for r in got) == want.tobytes()


def test_page_strips(spark):
    page = rng.integers(0, 256, (30, 20, 4)).astype(np.uint8)
    calls = []

    class Renderer(pages.PageRenderer):
        def render(self, data, number, dpi, y, h):
            calls.append((y, h))
            return page[y : y + h]

    for cached in (True, False):
        calls.clear()
        strips = pages.PageStrips(Renderer(), b"", 1, 72, 20, 30, cached=cached)
        assert b"".join(strips.strip(y, 8).tobytes() for y in (0, 8, 16, 24)) == page.tobytes()
        assert calls == ([(0, 30)] if cached else [(0, 8), (8, 8), (16, 8), (24, 6)])
        assert strips.strip(24, 8).shape == (6, 20, 4) and strips.strip(30, 5).shape == (5, 20, 4) and not strips.strip(99, 5).any()
    df = spark.createDataFrame([("a", 1, bytearray(page.tobytes()), 20, 30)], "path string, page_number long, content binary, width long, height long")
    got = pages.page_strips(df, RawRenderer(), 72, 8).orderBy("y0").collect()
    assert b"".join(bytes(r.data) for r in got) == page.tobytes() and [r.h for r in got] == [8, 8, 8, 6] and {r.image_id for r in got} == {"a#1"}
    with pytest.raises(pages.PageError):
        pages.PageStrips(pages.PageRenderer(), b"", 1, 72, 20, 30, cached=True).strip(0, 8)


class RawRenderer(pages.PageRenderer):
    """Takes the file for the page's pixels."""

    def render(self, data, number, dpi, y, h):
        return np.frombuffer(data, np.uint8).reshape(-1, 20, 4)[y : y + h]


def test_strip_source(spark):
    spark.dataSource.register(rasters.StripSource)
    got = spark.read.format("raster_strips").options(width="20", height="15", strip_height="4").load().orderBy("y0").collect()
    assert b"".join(bytes(r.data) for r in got) == rasters.test_raster(20, 15).tobytes() and len(got) == 4
