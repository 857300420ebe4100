import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import codec, jpeg, tiff

rng = np.random.default_rng(8)


def picture(h, w, n, bits=8):
    y, x = np.mgrid[0:h, 0:w]
    planes = [x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h), 255 - x * 200 // w]
    out = np.stack(planes[:n], axis=2)
    return out.astype(np.uint8) if bits == 8 else (out * 257 - (out > 9) * 31).astype("<u2")


@pytest.fixture(scope="module")
def java(spark):
    """Another implementation: the JVM's image writers and readers."""
    jvm = spark._jvm
    io, streams = jvm.javax.imageio.ImageIO, jvm.java.io
    io.setUseCache(False)

    class Java:
        def read(self, data):
            image = io.read(streams.ByteArrayInputStream(bytearray(data)))
            h, w, raster = image.getHeight(), image.getWidth(), image.getData()
            n = raster.getNumBands()
            samples = raster.getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(jvm.int, h * w * n))
            return np.array(list(samples), np.int64).reshape(h, w, n)

        def write(self, x, kind, compression=None, progressive=False):
            w, h, name, raw = codec.normalised(x)
            image = io.read(streams.ByteArrayInputStream(bytearray(codec.encode_png(raw, w, h, name))))
            writer = io.getImageWritersByFormatName(kind).next()
            param, out = writer.getDefaultWriteParam(), streams.ByteArrayOutputStream()
            if compression:
                param.setCompressionMode(2)
                param.setCompressionType(compression)
            if progressive:
                param.setProgressiveMode(1)
            stream = io.createImageOutputStream(out)
            writer.setOutput(stream)
            writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
            stream.flush()
            return bytes(out.toByteArray())

    return Java()


@pytest.mark.parametrize("shape", [(75, 101, 3), (75, 101, 1), (8, 8, 1), (1, 1, 3), (16, 300, 3)])
def test_jpeg_is_read_by_another_decoder(java, shape):
    x = picture(*shape)
    data = jpeg.encode(x, 90)
    own, other = jpeg.decode(data).astype(int), java.read(data)
    assert own.shape == x.shape and np.abs(own - x).max() <= 12
    assert np.abs(own - other[..., : shape[2]]).max() <= 3


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("shape", [(75, 101, 3), (40, 33, 1), (7, 5, 3)])
def test_jpeg_of_another_encoder(java, shape, progressive):
    x = picture(*shape)
    data = java.write(x, "jpeg", progressive=progressive)
    own, other = jpeg.decode(data).astype(int), java.read(data)
    assert own.shape == x.shape
    assert np.abs(own - other[..., : shape[2]]).max() <= 4
    noise = rng.integers(0, 256, shape).astype(np.uint8)
    data = java.write(noise, "jpeg", progressive=progressive)
    assert np.abs(jpeg.decode(data).astype(int)[..., 0] - java.read(data)[..., 0]).max() <= 6


def test_jpeg_quality_and_errors():
    noise = rng.integers(0, 256, (64, 64, 3)).astype(np.uint8)
    sizes = [len(jpeg.encode(noise, q)) for q in (10, 50, 100)]
    assert sizes == sorted(sizes) and np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 6
    good = jpeg.encode(picture(40, 40, 3))
    for bad in (b"", b"\xff\xd8", good[:60], good[:200], b"\xff\xd8\xff\xd9", good[:2] + b"\xff\xda\x00\x02"):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode(bad)
    for _ in range(200):  # nothing but its own error
        broken = bytearray(good)
        for i in rng.integers(0, len(good), 4):
            broken[i] = int(rng.integers(256))
        try:
            jpeg.decode(bytes(broken))
        except jpeg.JpegError:
            pass


@pytest.mark.parametrize("compression", [None, "LZW", "Deflate", "PackBits"])
@pytest.mark.parametrize(("n", "bits"), [(1, 8), (3, 8), (4, 8), (1, 16), (3, 16)])
def test_tiff_of_another_encoder(java, n, bits, compression):
    for x in (picture(45, 70, n, bits), rng.integers(0, 1 << bits, (33, 20, n)).astype("<u2" if bits == 16 else "u1")):
        assert (tiff.decode(java.write(x, "tiff", compression)) == x).all()


def test_tiff_errors():
    for bad in (b"", b"II*\x00", b"II*\x00\x08\x00\x00\x00\x00\x00", b"MM\x00*" + b"\xff" * 40):
        with pytest.raises(tiff.TiffError):
            tiff.decode(bad)


def test_decoding_by_magic_bytes(spark, java):
    x = picture(20, 30, 3)
    files = [("a", java.write(x, "tiff", "LZW")), ("b", jpeg.encode(x, 95)), ("c", codec.encode_png(x.tobytes(), 30, 20, "rgb8")), ("d", b"\xff\xd8\xffjunk"), ("e", b"II*\x00junk")]
    got = {r.path: r for r in codec.decoded(spark.createDataFrame([(p, bytearray(d)) for p, d in files], "path string, content binary")).collect()}
    assert all((got[p].w, got[p].h, got[p].pixel_format, got[p].error) == (30, 20, "rgb8", None) for p in "abc")
    assert bytes(got["a"].data) == bytes(got["c"].data) == x.tobytes() and all(got[p].error and got[p].data is None for p in "de")


def test_formats_of_tiles(spark):
    x = picture(16, 16, 4)
    df = spark.createDataFrame([(bytearray(x.tobytes()), 16, 16, "rgba8")], "data binary, w long, h long, f string")
    data = bytes(df.select(codec.encoded(F.col("data"), F.col("w"), F.col("h"), F.col("f"), "jpeg", 90).alias("d")).first().d)
    assert np.abs(jpeg.decode(data).astype(int) - x[..., :3]).max() < 12
    with pytest.raises(ValueError, match="can't hold"):
        codec.encode(b"\0\0", 1, 1, "gray16", "jpeg")
    with pytest.raises(ValueError, match="no encoder"):
        codec.encode(b"\0", 1, 1, "gray8", "webp")
