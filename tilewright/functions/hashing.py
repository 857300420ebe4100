"""Digests of BINARY columns: SHA-256 by Spark itself, BLAKE3 (from its published specification) as a pandas UDF, all
chunks of a batch of rows at once in numpy."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of BLAKE3: initial words, message permutation, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, AT_ONCE = 1024, 64, 1 << 15


def _mix(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word
        t = v[d] ^ v[a]
        v[d] = t >> np.uint32(r1) | t << np.uint32(32 - r1)
        v[c] = v[c] + v[d]
        t = v[b] ^ v[c]
        v[b] = t >> np.uint32(r2) | t << np.uint32(32 - r2)


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (n, 8) of n blocks: cv (n, 8), words m (n, 16), chunk counters, lengths and flags (n)."""
    words = [m[:, i] for i in range(16)]
    fixed = [np.full(len(cv), x, np.uint32) for x in IV[:4]]
    v = [*(cv[:, i] for i in range(8)), *fixed, counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    for _ in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
        words = [words[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def _chunks(raw: list[bytes], counters: list[int], alone: list[bool]) -> np.ndarray:
    """Chaining values of chunks (of at most CHUNK bytes); a chunk that is alone is its value's root."""
    sizes = np.array([len(x) for x in raw])
    m = np.frombuffer(b"".join(x.ljust(CHUNK, b"\0") for x in raw), "<u4").reshape(len(raw), CHUNK // BLOCK, 16)
    blocks = np.maximum(-(-sizes // BLOCK), 1)
    cv, counter, root = np.tile(np.array(IV, np.uint32), (len(raw), 1)), np.array(counters, np.uint64), np.array(alone)
    for i in range(int(blocks.max())):
        on = np.flatnonzero(blocks > i)
        last = blocks[on] == i + 1
        flags = np.where(last, CHUNK_END + np.where(root[on], ROOT, 0), 0) + (CHUNK_START if i == 0 else 0)
        cv[on] = _compress(cv[on], m[on, i], counter[on], np.where(last, sizes[on] - BLOCK * i, BLOCK), flags)
    return cv


def _parents(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    n = len(left)
    return _compress(np.tile(np.array(IV, np.uint32), (n, 1)), np.concatenate((left, right), axis=1), np.zeros(n, np.uint64), np.full(n, BLOCK), PARENT + np.where(root, ROOT, 0))


def blake3_all(values: list[bytes]) -> list[str]:
    """Digests of many values. A tree's left side is the largest power of two of chunks, which pairing neighbours level by
    level gives: what has no neighbour goes up as it is."""
    pieces = [(v[i : i + CHUNK], i // CHUNK, len(v) <= CHUNK, k) for k, v in enumerate(map(bytes, values)) for i in range(0, max(len(v), 1), CHUNK)]
    if not pieces:
        return []
    raw, counters, alone, owner = zip(*pieces)
    cv = np.concatenate([_chunks(list(raw[i : i + AT_ONCE]), list(counters[i : i + AT_ONCE]), list(alone[i : i + AT_ONCE])) for i in range(0, len(raw), AT_ONCE)])
    owner = np.array(owner)
    while True:
        n = np.bincount(owner, minlength=len(values))
        if n.max() == 1:
            return [row.astype("<u4").tobytes().hex() for row in cv]
        first = np.cumsum(n) - n
        place = np.arange(len(owner)) - first[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < n[owner]))
        single = np.flatnonzero((place % 2 == 0) & (place + 1 == n[owner]))
        up = _parents(cv[left], cv[left + 1], n[owner[left]] == 2)
        by = np.argsort(np.concatenate((left, single)), kind="stable")
        cv, owner = np.concatenate((up, cv[single]))[by], np.concatenate((owner[left], owner[single]))[by]


def blake3_hex(data: bytes) -> str:
    return blake3_all([data])[0]


def hex_digest(data: bytes, algorithm: str = "blake3") -> str:
    return hashlib.sha256(data).hexdigest() if algorithm == "sha256" else blake3_hex(data)


def blake3(data: Column) -> Column:
    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            held = iter(blake3_all([v for v in x if v is not None]))
            yield pd.Series([None if v is None else next(held) for v in x], dtype=object)

    return digest(data)


def digest(data: Column, algorithm: str = "blake3") -> Column:
    """64 lowercase hex digits."""
    if algorithm not in ("blake3", "sha256"):
        raise ValueError(f"unknown digest: {algorithm}")
    return F.sha2(data.cast("binary"), 256) if algorithm == "sha256" else blake3(data)


def plan_bytes(width: int, height: int, tile_size: int, overlap: int, layout: str, canvas: tuple[int, int], centre: bool, offset: tuple[int, int], levels: list[tuple[int, int, int, int, int]]) -> bytes:
    """What tells a plan from others."""
    tag = {"deep_zoom": 1, "xyz": 2, "google": 3}[layout]
    head = struct.pack("<4IB2IB2I", width, height, tile_size, overlap, tag, *canvas, centre, *offset)
    return b"tilewright plan 1" + head + struct.pack("<Q", len(levels)) + b"".join(struct.pack("<5I", *x) for x in levels)


def plan_hash(*plan) -> str:
    """Identity of a plan, so that a run is only resumed under the plan that began it."""
    return blake3_hex(plan_bytes(*plan))


def plan_bytes_of(plans: DataFrame) -> DataFrame:
    """image_id, identity (plan_bytes) of plan rows with their levels as an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                levels = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in r.levels]
                rows.append((r.image_id, plan_bytes(r.width, r.height, r.tile_size, r.overlap, r.layout, (r.canvas_width, r.canvas_height), r.centre, (r.offset_x, r.offset_y), levels)))
            yield pd.DataFrame(rows, columns=["image_id", "identity"])

    return plans.mapInPandas(run, f"image_id {plans.schema['image_id'].dataType.simpleString()}, identity binary")
