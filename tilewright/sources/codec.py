"""PNG in plain Python and numpy (all six pixel formats, 8 and 16 bits), JPEG, TIFF and raw tiles, and decoding by
magic bytes. `decoders` takes more decoders by their magic bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.resample import DTYPES, to_array
from . import jpeg, tiff

PNG = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 3: 2, 4: 6}
decoders: dict[bytes, object] = {}


class DecodeError(ValueError):
    pass


def encode_png(data: bytes, w: int, h: int, pixel_format: str) -> bytes:
    channels, kind = DTYPES[pixel_format]
    x = np.frombuffer(data, kind).reshape(h, w * channels)
    rows = x.astype(">u2").view(np.uint8).reshape(h, -1) if kind == "<u2" else x
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows), axis=1).tobytes()
    part = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return PNG + part(b"IHDR", struct.pack(">2I5B", w, h, 16 if kind == "<u2" else 8, COLOUR[channels], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, str, bytes]:
    """(w, h, pixel format, samples); grey with alpha becomes RGBA, palettes RGB. Interlaced files are refused."""
    if data[:8] != PNG:
        raise DecodeError("not a PNG")
    at, idat, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        (n,), tag = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if tag == b"IHDR":
            head = struct.unpack(">2I5B", body)
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            idat.append(body)
        at += 12 + n
    if not head or not idat:
        raise DecodeError("truncated PNG")
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlace or depth not in (8, 16):
        raise DecodeError(f"unsupported PNG: colour {colour}, depth {depth}, interlace {interlace}")
    try:
        raw = zlib.decompress(b"".join(idat))
    except zlib.error as e:
        raise DecodeError(str(e)) from e
    step, line = channels * depth // 8, w * channels * depth // 8
    if len(raw) < h * (line + 1):
        raise DecodeError("truncated PNG")
    out, above = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        kind, row = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).copy()
        above = out[y] = _unfilter(kind, row, above, step)
    if depth == 16:
        samples = out.view(">u2").astype("<u2").reshape(h, w, channels)
    else:
        samples = out.reshape(h, w, channels)
    if colour == 3:
        if palette is None:
            raise DecodeError("palette missing")
        samples = palette[samples[..., 0]]
    return normalised(samples)


def normalised(samples: np.ndarray) -> tuple[int, int, str, bytes]:
    """(w, h, pixel format, samples) of (h, w, channels): one of the six pixel formats; grey with alpha becomes RGBA."""
    if samples.shape[2] == 2:
        samples = samples[..., [0, 0, 0, 1]]
    h, w, n = samples.shape
    return w, h, {1: "gray", 3: "rgb", 4: "rgba"}[n] + str(8 * samples.itemsize), np.ascontiguousarray(samples).tobytes()


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        pixels = row.reshape(-1, step)
        return np.cumsum(pixels, axis=0, dtype=np.uint8).reshape(-1)
    out, up = row.astype(np.int32).tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        elif kind == 4:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
            out[i] = (out[i] + near[2]) & 255
        else:
            raise DecodeError(f"filter {kind}")
    return np.array(out, np.uint8)


def decode(data: bytes) -> tuple[int, int, str, bytes]:
    if data[:8] == PNG:
        return decode_png(data)
    if data[:3] == jpeg.MAGIC:
        return normalised(jpeg.decode(data))
    if data[:4] in tiff.MAGICS:
        return normalised(tiff.decode(data))
    for magic, decoder in decoders.items():
        if data.startswith(magic):
            return decoder(data)
    raise DecodeError("unknown image format" if data else "empty input")


def decoded(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, w, h, pixel_format, data, error: one row for each file; what can't be decoded has an error instead of pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    rows.append((p, *decode(bytes(raw if raw is not None else b"")), None))
                except (DecodeError, struct.error, ValueError) as e:
                    rows.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "pixel_format", "data", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, w long, h long, pixel_format string, data binary, error string")


FORMATS = {"png": "png", "jpeg": "jpeg", "raw": "raw"}  # and their extensions


def encode(data: bytes, w: int, h: int, pixel_format: str, tile_format: str = "png", quality: int = 80) -> bytes:
    """Tile bytes. JPEG has 8 bits and no alpha: rgba8 loses its alpha, 16-bit formats are refused."""
    if tile_format == "raw":
        return bytes(data)
    if tile_format == "png":
        return encode_png(data, w, h, pixel_format)
    if tile_format != "jpeg":
        raise ValueError(f"no encoder for {tile_format}")
    if pixel_format.endswith("16"):
        raise ValueError(f"JPEG can't hold {pixel_format}")
    return jpeg.encode(to_array(data, h, w, pixel_format)[..., :3], quality)


def encoded(data: Column, w: Column, h: Column, pixel_format: Column, tile_format: str = "png", quality: int = 80) -> Column:
    """Tile bytes: png, jpeg or raw."""
    if tile_format not in FORMATS:
        raise ValueError(f"no encoder for {tile_format}")
    if tile_format == "raw":
        return data

    @F.pandas_udf("binary")
    def tile(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, x, y, f in batches:
            yield pd.Series([encode(bytes(a), int(b), int(c), e, tile_format, quality) for a, b, c, e in zip(d, x, y, f)], dtype=object)

    return tile(data, w, h, pixel_format)
