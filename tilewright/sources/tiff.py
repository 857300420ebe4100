"""TIFF after its published specification (revision 6.0): the first image of a file, in strips or tiles, 8 or 16 bits,
grey, RGB, either with alpha, or a palette; plain, PackBits, LZW or Deflate, with or without horizontal differences."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGICS = (b"II*\x00", b"MM\x00*")
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MOST_PIXELS = 1 << 31


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, held, n, at, width = bytearray(), 0, 0, 0, 9
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    while len(out) < size:
        while n < width:
            if at >= len(data):
                return bytes(out)
            held, n, at = (held << 8 | data[at]) & 0xFFFFFFFF, n + 8, at + 1
        code = held >> (n - width) & ((1 << width) - 1)
        n -= width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += now
        if last and len(table) < 4096:
            table.append(last + now[:1])
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return unpack_lzw(data, size)
    if compression in (8, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == 32773:
        return unpack_bits(data, size)
    raise TiffError(f"unsupported compression {compression}")


def _tags(data: bytes, end: str) -> dict[int, tuple]:
    (at,) = struct.unpack(end + "I", data[4:8])
    (n,) = struct.unpack(end + "H", data[at : at + 2])
    out = {}
    for i in range(n):
        place = at + 2 + 12 * i
        tag, kind, count = struct.unpack(end + "HHI", data[place : place + 8])
        size = SIZES.get(kind, 0) * count
        if not size or size > len(data):
            continue
        begin = place + 8 if size <= 4 else struct.unpack(end + "I", data[place + 8 : place + 12])[0]
        if kind in (1, 3, 4):
            out[tag] = struct.unpack(end + {1: "B", 3: "H", 4: "I"}[kind] * count, data[begin : begin + size])
    return out


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) bytes or little-endian 16-bit samples; 1 to 4 channels."""
    if data[:4] not in MAGICS:
        raise TiffError("not a TIFF")
    try:
        return _decode(data, "<" if data[:2] == b"II" else ">")
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise TiffError(f"corrupt TIFF: {e!r}") from e


def _decode(data: bytes, end: str) -> np.ndarray:
    tags = _tags(data, end)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, n, light, packing = tags[256][0], tags[257][0], one(277, 1), tags[262][0], one(259, 1)
    bits, planar, predictor = set(tags.get(258, (1,))), one(284, 1), one(317, 1)
    if bits not in ({8}, {16}) or light > 3 or not 1 <= n <= 4 or predictor > 2 or set(tags.get(339, (1,))) != {1} or not 0 < w * h <= MOST_PIXELS:
        raise TiffError(f"unsupported TIFF: bits {sorted(bits)}, photometric {light}, samples {n}, predictor {predictor}")
    kind = np.dtype(end + "u2" if bits == {16} else "u1")
    per = 1 if planar == 2 else n
    if 322 in tags:
        tw, th, offsets, counts = tags[322][0], tags[323][0], tags[324], tags[325]
        wide, high = -(-w // tw), -(-h // th)
    else:
        tw, th, offsets, counts = w, min(one(278, h), h), tags[273], tags.get(279)
        wide, high = 1, -(-h // th)
        counts = counts or tuple([len(data)] * len(offsets))
    if not tw or not th or len(offsets) < wide * high * (n if planar == 2 else 1):
        raise TiffError("parts are missing")
    out = np.zeros((h, w, n), kind.newbyteorder("<") if bits == {16} else kind)
    for i, (begin, size) in enumerate(zip(offsets, counts)):
        plane, k = divmod(i, wide * high)
        if plane >= n // per:
            break
        y, x = k // wide * th, k % wide * tw
        rows = th if 322 in tags else min(th, h - y)
        need = rows * tw * per * kind.itemsize
        raw = _unpacked(data[begin : begin + size], packing, need)
        if len(raw) < need:
            raise TiffError("image data is short")
        part = np.frombuffer(raw[:need], kind).reshape(rows, tw, per)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        part = part[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane if planar == 2 else slice(None)] = part[..., 0] if planar == 2 else part
    if light == 0:
        out[..., 0] = np.iinfo(out.dtype).max - out[..., 0]
    if light == 3:
        palette = np.array(tags[320], np.uint16).reshape(3, -1).T
        out = (palette[out[..., 0]] >> 8).astype(np.uint8)
    return out
