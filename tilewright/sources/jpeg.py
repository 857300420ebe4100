"""JPEG after its published specification (ITU-T T.81): a baseline encoder and a decoder of baseline, extended
sequential and progressive files, 8 bits, any sampling, restart intervals, grey, YCbCr, RGB and (inverted) CMYK.

Transforms, colour and the encoder's entropy coding are numpy over all blocks at once; the decoder's entropy coding
is sequential by nature and a loop over symbols.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the specification's annex K: quantisation of brightness and of colour at quality 50, row by row.
BRIGHT = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
MAGIC = b"\xff\xd8\xff"
#: Row-major positions in zigzag order: by diagonals, every second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


class JpegError(ValueError):
    pass


# -- encoding -------------------------------------------------------------------------------------


def quantisation(base: tuple, quality: int) -> np.ndarray:
    q = min(max(int(quality), 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of symbols by their counts, at most 16 bits and no code of ones alone."""
    used = [(int(c), int(s)) for s, c in enumerate(counts) if c] + [(0, -1)]  # the last one takes the code of ones
    if len(used) == 2:
        return {used[0][1]: 1}
    heap, parents, tie = [(c, i, [s]) for i, (c, s) in enumerate(used)], dict.fromkeys((s for _, s in used), 0), len(used)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            parents[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    many = [0] * 300
    for n in parents.values():
        many[n] += 1
    for n in range(299, 16, -1):  # a pair too deep moves up, beside a leaf that moves down
        while many[n]:
            k = n - 2
            while not many[k]:
                k -= 1
            many[n] -= 2
            many[n - 1] += 1
            many[k + 1] += 2
            many[k] -= 1
    last = max(n for n in range(1, 17) if many[n])
    many[last] -= 1
    lengths = [n for n in range(1, 17) for _ in range(many[n])]
    ordered = sorted((s for _, s in used if s >= 0), key=lambda s: (-int(counts[s]), s))
    return dict(zip(ordered, lengths))


def codes(ordered: list[int], lengths: list[int]) -> dict[int, int]:
    """Canonical codes of symbols in order of length."""
    out, code, n = {}, 0, lengths[0] if lengths else 1
    for s, k in zip(ordered, lengths):
        code <<= k - n
        out[s], n = code, k
        code += 1
    return out


def _size(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(int) + 1)


def _symbols(z: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks in zigzag order (n, 64): per symbol its block, place in it, symbol and extra value; DC as differences."""
    diff = z[:, 0] - previous
    block, at = np.nonzero(z[:, 1:])
    at = at + 1
    value = z[block, at]
    first = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.empty(0, bool)
    run = at - np.where(first, 0, np.concatenate(([0], at[:-1]))) - 1
    # runs of 16 zeros get symbols of their own, before the value's
    skips = run // 16
    zb, zk = np.repeat(block, skips), np.repeat(at, skips)
    last = np.zeros(len(z), int)
    np.maximum.at(last, block, at)
    short = np.flatnonzero(last < 63)
    n = np.arange(len(z))
    blocks = np.concatenate((n, zb, block, short))
    places = np.concatenate((np.zeros(len(z), int), 3 * zk - 1, 3 * at, np.full(len(short), 1000)))
    symbols = np.concatenate((_size(diff), np.full(len(zb), 0xF0), run % 16 * 16 + _size(value), np.zeros(len(short), int)))
    extra = np.concatenate((diff, np.zeros(len(zb), int), value, np.zeros(len(short), int)))
    return blocks, places, symbols, extra


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(x: np.ndarray, quality: int = 80) -> bytes:
    """(h, w, 1 or 3) bytes; every component at full resolution."""
    h, w, n = x.shape
    if not (0 < h < 65536 and 0 < w < 65536):
        raise JpegError("size out of range")
    f = x.astype(np.float64)
    if n == 3:
        r, g, b = f[..., 0], f[..., 1], f[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [f[..., 0]]
    tables = [quantisation(BRIGHT, quality), quantisation(COLOUR, quality)][: 1 + (n == 3)]
    parts = []
    for i, plane in enumerate(planes):
        q = tables[min(i, 1)].reshape(8, 8)
        z = np.rint((DCT @ (_blocks(plane) - 128) @ DCT.T) / q).astype(int).reshape(-1, 64)[:, ZIGZAG]
        z[:, 1:] = np.clip(z[:, 1:], -1023, 1023)
        block, place, symbol, extra = _symbols(z, np.concatenate(([0], z[:-1, 0])))
        parts.append((block, np.full(len(block), i), place, symbol, extra))
    block, part, place, symbol, extra = (np.concatenate(c) for c in zip(*parts))
    by = np.lexsort((place, part, block))
    part, place, symbol, extra = part[by], place[by], symbol[by], extra[by]
    which = 2 * np.minimum(part, 1) + (place > 0)
    code, size, huffman = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    for t in np.unique(which).tolist():
        own = which == t
        lengths = code_lengths(np.bincount(symbol[own], minlength=256))
        order = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
        table = codes(order, [lengths[s] for s in order])
        lookup, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s in order:
            lookup[s], bits[s] = table[s], lengths[s]
        code[own], size[own] = lookup[symbol[own]], bits[symbol[own]]
        per = [sum(lengths[s] == k for s in order) for k in range(1, 17)]
        huffman += _marker(0xC4, bytes([16 * (t % 2) + t // 2, *per, *order]))
    more = symbol & 15
    tail = np.where(extra < 0, extra + (1 << more) - 1, extra)
    value, n_bits = (code << more) | tail, size + more
    at = np.repeat(np.arange(len(value)), n_bits)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(n_bits) - n_bits, n_bits)
    stream = (value[at] >> (n_bits[at] - 1 - offset)) & 1
    stream = np.concatenate((stream, np.ones(-len(stream) % 8, np.int64)))
    body = np.packbits(stream.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(n))
    scan = bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + b"\x00\x3f\x00"
    head = _marker(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + b"".join(_marker(0xDB, bytes([i, *q[ZIGZAG].tolist()])) for i, q in enumerate(tables))
    return b"\xff\xd8" + head + _marker(0xC0, frame) + huffman + _marker(0xDA, scan) + body + b"\xff\xd9"


# -- decoding -------------------------------------------------------------------------------------


class _Bits:
    """Bits of a stretch between markers; beyond its end they are zero, as far as a block may need."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
        self.words, self.at, self.end = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]).tolist(), 0, 8 * (len(b) - 5)

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at > self.end:
            raise JpegError("truncated")
        out = (self.words[self.at >> 3] >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: list[int]) -> int:
        if self.at > self.end:
            raise JpegError("truncated")
        found = table[(self.words[self.at >> 3] >> (16 - (self.at & 7))) & 0xFFFF]
        if not found:
            raise JpegError("bad code")
        self.at += found & 31
        return found >> 5

    def value(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _table(per: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits to come: symbol << 5 | length, 0 where there is no code."""
    out, at = np.zeros(65536, np.int64), 0
    lengths = [n + 1 for n in range(16) for _ in range(per[n])]
    for s, n in zip(symbols, lengths):
        step = 1 << (16 - n)
        if at + step > 65536:
            raise JpegError("bad table")
        out[at : at + step] = s << 5 | n
        at += step
    return out.tolist()


class _Decoder:
    def __init__(self, data: bytes):
        self.data, self.quant, self.dc, self.ac, self.restart, self.adobe, self.frame, self.scanned = data, {}, {}, {}, 0, None, None, False

    def run(self) -> np.ndarray:
        at, data = 2, self.data
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            code = data[at + 1]
            if code in (0xFF, 0x00, 0x01) or 0xD0 <= code <= 0xD8:
                at += 1 if code == 0xFF else 2
                continue
            if code == 0xD9:
                break
            (n,) = struct.unpack(">H", data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if code == 0xDB:
                self._quantisation(body)
            elif code == 0xC4:
                self._huffman(body)
            elif code in (0xC0, 0xC1, 0xC2):
                self._frame(body, code == 0xC2)
            elif 0xC3 <= code <= 0xCF and code not in (0xC8, 0xCC):
                raise JpegError("unsupported JPEG process")
            elif code == 0xDD:
                (self.restart,) = struct.unpack(">H", body[:2])
            elif code == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif code == 0xDA:
                at = self._scan(body, at)
        if not self.scanned:
            raise JpegError("no image")
        return self._image()

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else "u1")
            self.quant[k], at = table, at + 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            kind, per = body[at], body[at + 1 : at + 17]
            n = sum(per)
            (self.ac if kind >> 4 else self.dc)[kind & 15] = _table(per, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        bits, self.h, self.w, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.h or not self.w or n not in (1, 3, 4):
            raise JpegError("unsupported JPEG frame")
        self.progressive, self.frame = progressive, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.most = max(c[1] for c in self.frame), max(c[2] for c in self.frame)
        self.mcus = -(-self.w // (8 * self.most[0])), -(-self.h // (8 * self.most[1]))
        if sum(self.mcus[0] * a * self.mcus[1] * b for _, a, b, _ in self.frame) > 8 * len(self.data):
            raise JpegError("truncated")  # every block has a bit at least
        self.coefficients = {c: [[0] * 64 for _ in range(self.mcus[0] * a * self.mcus[1] * b)] for c, a, b, _ in self.frame}

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        parts = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        low, high, approx = body[1 + 2 * n : 4 + 2 * n]
        self.scanned = True
        stretches, begin = [], at
        while True:  # the scan's stretches end at restart markers, the scan at any other
            k = self.data.find(b"\xff", at)
            if k < 0 or k + 1 >= len(self.data):
                stretches.append(self.data[begin:])
                at = len(self.data)
                break
            code = self.data[k + 1]
            if code == 0:
                at = k + 2
            elif 0xD0 <= code <= 0xD7:
                stretches.append(self.data[begin:k])
                begin = at = k + 2
            elif code == 0xFF:
                at = k + 1
            else:
                stretches.append(self.data[begin:k])
                at = k
                break
        units = self._units(parts)
        step = self.restart * (len(units) // self._mcu_count(parts)) if self.restart else len(units)
        for i, raw in enumerate(stretches):
            bits, self.last, self.skip = _Bits(raw), dict.fromkeys((p[0] for p in parts), 0), 0
            for c, dc, ac, block in units[i * step : (i + 1) * step]:
                if not self.progressive:
                    self._sequential(bits, c, self.dc[dc], self.ac[ac], block)
                elif low == 0:
                    self._first_dc(bits, c, self.dc.get(dc), block, approx >> 4, approx & 15)
                elif approx >> 4 == 0:
                    self._first_ac(bits, self.ac[ac], block, low, high, approx & 15)
                else:
                    self._more_ac(bits, self.ac[ac], block, low, high, approx & 15)
        return at

    def _mcu_count(self, parts: list) -> int:
        if len(parts) > 1:
            return self.mcus[0] * self.mcus[1]
        _, a, b, _ = next(c for c in self.frame if c[0] == parts[0][0])
        return -(-(-(-self.w * a // self.most[0])) // 8) * -(-(-(-self.h * b // self.most[1])) // 8)

    def _units(self, parts: list) -> list[tuple]:
        """(component, tables, coefficients) of blocks in the order of the scan."""
        shape, out = {c: (a, b) for c, a, b, _ in self.frame}, []
        if len(parts) == 1:
            c, dc, ac = parts[0]
            a, b = shape[c]
            wide, high = -(-(-(-self.w * a // self.most[0])) // 8), -(-(-(-self.h * b // self.most[1])) // 8)
            line = self.mcus[0] * a
            return [(c, dc, ac, self.coefficients[c][y * line + x]) for y in range(high) for x in range(wide)]
        for my in range(self.mcus[1]):
            for mx in range(self.mcus[0]):
                for c, dc, ac in parts:
                    a, b = shape[c]
                    line, own = self.mcus[0] * a, self.coefficients[c]
                    out += [(c, dc, ac, own[(my * b + y) * line + mx * a + x]) for y in range(b) for x in range(a)]
        return out

    def _sequential(self, bits: _Bits, c: int, dc: list, ac: list, block: list) -> None:
        self.last[c] += bits.value(bits.symbol(dc))
        block[0], k = self.last[c], 1
        while k < 64:
            s = bits.symbol(ac)
            run, n = s >> 4, s & 15
            if not n:
                if run < 15:
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise JpegError("bad run")
            block[k] = bits.value(n)
            k += 1

    def _first_dc(self, bits: _Bits, c: int, dc: list | None, block: list, again: int, low: int) -> None:
        if again:
            block[0] |= bits.take(1) << low
        else:
            self.last[c] += bits.value(bits.symbol(dc))
            block[0] = self.last[c] << low

    def _first_ac(self, bits: _Bits, ac: list, block: list, k: int, high: int, low: int) -> None:
        if self.skip:
            self.skip -= 1
            return
        while k <= high:
            s = bits.symbol(ac)
            run, n = s >> 4, s & 15
            if n:
                k += run
                if k > 63:
                    raise JpegError("bad run")
                block[k] = bits.value(n) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) + bits.take(run) - 1
                return

    def _more_ac(self, bits: _Bits, ac: list, block: list, k: int, high: int, low: int) -> None:
        one = 1 << low

        def refine(k: int) -> None:
            if bits.take(1) and not abs(block[k]) & one:
                block[k] += one if block[k] > 0 else -one

        while k <= high and not self.skip:
            s = bits.symbol(ac)
            run, n = s >> 4, s & 15
            if n:
                new = one if bits.take(1) else -one
            elif run < 15:
                self.skip = (1 << run) + bits.take(run)
                break
            while k <= high:
                if block[k]:
                    refine(k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if n and k <= 63:
                block[k] = new
            k += 1
        if self.skip:
            for j in range(k, high + 1):
                if block[j]:
                    refine(j)
            self.skip -= 1

    def _image(self) -> np.ndarray:
        planes = []
        for c, a, b, q in self.frame:
            if q not in self.quant:
                raise JpegError("no quantisation table")
            z = np.array(self.coefficients[c], np.int64)
            x = np.zeros_like(z)
            x[:, ZIGZAG] = z
            x = DCT.T @ (x * self.quant[q]).reshape(-1, 8, 8).astype(float) @ DCT
            wide, high = self.mcus[0] * a, self.mcus[1] * b
            plane = np.rint(x + 128).clip(0, 255).reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)
            plane = plane[: -(-self.h * b // self.most[1]), : -(-self.w * a // self.most[0])]
            planes.append(_spread(_spread(plane, self.most[1] // b, self.h).T, self.most[0] // a, self.w).T)
        if len(planes) == 1:
            return planes[0].astype(np.uint8)[..., None]
        ids = bytes(c[0] for c in self.frame)
        turned = self.adobe in (1, 2) if self.adobe is not None else len(planes) == 3 and ids != b"RGB"
        if turned:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes[:3] = [np.rint(v).clip(0, 255) for v in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)]
        out = np.stack(planes[:3], axis=2)
        if len(planes) == 4:  # inverted, as all writers have it
            out = np.floor(out * planes[3][..., None] / 255)
        return np.rint(out).astype(np.uint8)


def _spread(plane: np.ndarray, times: int, size: int) -> np.ndarray:
    """Rows at full resolution: of half as many, three quarters of the nearest and one of the next nearest; else repeated."""
    if times != 2:
        return plane.repeat(times, axis=0)[:size]
    before, after = np.concatenate((plane[:1], plane[:-1])), np.concatenate((plane[1:], plane[-1:]))
    return np.stack(((3 * plane + before) / 4, (3 * plane + after) / 4), axis=1).reshape(-1, plane.shape[1])[:size]


def decode(data: bytes) -> np.ndarray:
    """(h, w, 1 or 3) bytes."""
    if data[:2] != MAGIC[:2]:
        raise JpegError("not a JPEG")
    try:
        return _Decoder(bytes(data)).run()
    except JpegError:
        raise
    except (KeyError, IndexError, struct.error, StopIteration, AttributeError, TypeError, ValueError, ZeroDivisionError) as e:
        raise JpegError(f"corrupt JPEG: {e!r}") from e
