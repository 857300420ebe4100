"""PDF page facts and embedded page images, from the object structure alone.

Classic object syntax with Flate object streams is read; encryption is refused. Rendering vector pages needs a
renderer that this environment lacks: `PageRenderer` is the place for one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

HOPS = 64
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%]*|(\d+)\s+(\d+)\s+R\b|[-+]?[0-9]*\.?[0-9]+|true|false|null|[A-Za-z]+)", re.S)
OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")


class PageError(ValueError):
    pass


class Ref(int):
    pass


def _value(raw: bytes, at: int):
    """The object at a place and where it ends; names as '/x', nesting by a stack."""
    stack: list[tuple[list, str]] = []
    while True:
        m = TOKEN.match(raw, at)
        if not m:
            raise PageError("malformed object")
        at, t = m.end(), m[1]
        if t in (b"<<", b"["):
            stack.append(([], t.decode()))
            continue
        if t in (b">>", b"]"):
            if not stack:
                raise PageError("malformed object")
            items, kind = stack.pop()
            v = dict(zip(items[::2], items[1::2])) if kind == "<<" else items
        elif m[2]:
            v = Ref(m[2])
        elif t[:1] == b"/":
            v = t.decode("latin-1")
        elif t[:1] in b"+-.0123456789":
            v = float(t) if b"." in t else int(t)
        else:
            v = {b"true": True, b"false": False, b"null": None}.get(t, t)
        if not stack:
            return v, at
        stack[-1][0].append(v)


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise PageError("not a PDF")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in OBJECT.finditer(data):
            try:
                v, end = _value(data, m.end())
            except PageError:
                continue
            number = int(m[1])
            self.objects[number] = v
            s = re.compile(rb"\s*stream\r?\n").match(data, end)
            if s and isinstance(v, dict):
                n = v.get("/Length")
                stop = s.end() + n if isinstance(n, int) and not isinstance(n, Ref) and data[s.end() + n : s.end() + n + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                self.streams[number] = data[s.end() : stop if stop >= 0 else len(data)]
        for number, v in list(self.objects.items()):
            if isinstance(v, dict) and v.get("/Type") == "/ObjStm" and number in self.streams:
                self._unpack(v, self.stream(number))
        if any(isinstance(v, dict) and "/Encrypt" in v for v in self.objects.values()) or re.search(rb"trailer\s*<<[^>]*/Encrypt", data):
            raise PageError("encrypted")

    def _unpack(self, head: dict, raw: bytes) -> None:
        n, first = int(self.get(head.get("/N", 0))), int(self.get(head.get("/First", 0)))
        numbers = [int(x) for x in raw[:first].split()[: 2 * n]]
        for number, at in zip(numbers[::2], numbers[1::2]):
            self.objects.setdefault(number, _value(raw, first + at)[0])

    def get(self, v):
        for _ in range(HOPS):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(int(v))
        return None

    def stream(self, number: int) -> bytes:
        raw, names = self.streams[number], self.filters(self.objects[number])
        return zlib.decompressobj().decompress(raw) if names[:1] == ["/FlateDecode"] else raw

    def filters(self, head: dict) -> list[str]:
        f = self.get(head.get("/Filter"))
        return [] if f is None else [f] if isinstance(f, str) else [self.get(x) for x in f]

    def pages(self) -> list[dict]:
        """Page dictionaries in order."""
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("/Type") == "/Catalog"]
        if not roots:
            raise PageError("no catalog")
        out, stack, seen = [], [roots[-1].get("/Pages")], set()
        while stack:
            ref = stack.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get("/Kids"))
                if node.get("/Type") == "/Page" or not isinstance(kids, list):
                    out.append(node)
                else:
                    stack += reversed(kids)
        return out

    def inherited(self, page: dict, key: str):
        """The nearest value up the /Parent chain, of at most HOPS nodes."""
        for _ in range(HOPS):
            if not isinstance(page, dict):
                return None
            if key in page:
                return self.get(page[key])
            page = self.get(page.get("/Parent"))
        return None

    def images(self, page: dict) -> list[tuple[int, dict]]:
        found = self.get((self.inherited(page, "/Resources") or {}).get("/XObject")) or {}
        refs = [r for r in found.values() if isinstance(r, Ref)]
        return [(int(r), v) for r in refs if isinstance(v := self.get(r), dict) and v.get("/Subtype") == "/Image"]


def rotation(degrees) -> int:
    r = int(degrees) % 360
    if r % 90:
        raise PageError(f"unsupported rotation {degrees}")
    return r


def page_facts(data: bytes) -> list[tuple]:
    """(page_number, width_pts, height_pts, rotate, has_images); sizes as displayed."""
    doc, out = Document(data), []
    for i, page in enumerate(doc.pages(), 1):
        box = [float(doc.get(x)) for x in doc.inherited(page, "/MediaBox") or [0, 0, 612, 792]]
        w, h, turn = abs(box[2] - box[0]), abs(box[3] - box[1]), rotation(doc.inherited(page, "/Rotate") or 0)
        out.append((i, *((h, w) if turn in (90, 270) else (w, h)), turn, bool(doc.images(page))))
    return out


def page_image(data: bytes, number: int) -> tuple[int, int, str, bytes]:
    """The largest image of a page, from 1: (w, h, pixel format, samples). Of equal ones the first."""
    doc = Document(data)
    pages = doc.pages()
    if not 1 <= number <= len(pages):
        raise PageError(f"no page {number}")
    images = doc.images(pages[number - 1])
    if not images:
        raise PageError("no image on page")
    size = lambda v: int(doc.get(v.get("/Width", 0))) * int(doc.get(v.get("/Height", 0)))
    key, head = max(images, key=lambda x: size(x[1]))
    w, h, names = int(doc.get(head["/Width"])), int(doc.get(head["/Height"])), doc.filters(head)
    if names and (names[0] != "/FlateDecode" or len(names) > 2):
        from .codec import decode  # DCT and JPX: by a registered decoder

        if names[0] in ("/DCTDecode", "/JPXDecode"):
            return decode(doc.streams[key])
        raise PageError(f"unsupported filter {names}")
    raw = doc.stream(key)
    if len(names) == 2:
        from .codec import decode

        return decode(raw)
    space, bits = doc.get(head.get("/ColorSpace", "/DeviceRGB")), int(doc.get(head.get("/BitsPerComponent", 8)))
    channels = {"/DeviceGray": 1, "/DeviceRGB": 3, "/DeviceCMYK": 4}.get(space if isinstance(space, str) else "")
    if channels is None or bits not in (8, 16) or (channels == 4 and bits == 16):
        raise PageError(f"unsupported colour space {space}, {bits} bits")
    need = w * h * channels * bits // 8
    if len(raw) < need:
        raise PageError("image data is short")
    x = np.frombuffer(raw[:need], ">u2" if bits == 16 else "u1").reshape(h, w, channels)
    if channels == 4:
        f = np.float32
        x = ((f(1) - x[..., :3].astype(f) / f(255)) * (f(1) - x[..., 3:].astype(f) / f(255)) * f(255)).astype(np.uint8)
        channels = 3
    return w, h, f"{'gray' if channels == 1 else 'rgb'}{bits}", x.astype("<u2" if bits == 16 else "u1").tobytes()


def pdf_info(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each page of each file (binaryFile columns), or one with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    rows += [(p, *x, None) for x in page_facts(bytes(raw if raw is not None else b""))]
                except (PageError, ValueError, TypeError, KeyError, zlib.error) as e:
                    rows.append((p, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_number", "width_pts", "height_pts", "rotate", "has_images", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, page_number long, width_pts double, height_pts double, rotate long, has_images boolean, error string")


class PageRenderer:
    """Renders page strips as RGBA arrays; to be supplied."""

    def render(self, data: bytes, page: int, dpi: int, y: int, h: int) -> np.ndarray:
        raise PageError("no renderer for vector pages")


class PageStrips:
    """Strips of one page. cached: the page is rendered once and sliced; else each strip by itself, so that no more than a
    strip is held. Beyond the page a strip is all zero, of the height asked for; the last one ends with the page."""

    def __init__(self, renderer: PageRenderer, data: bytes, page: int, dpi: int, width: int, height: int, cached: bool = False):
        self.renderer, self.data, self.page, self.dpi, self.width, self.height, self.cached, self.held = renderer, data, page, dpi, width, height, cached, None

    def strip(self, y: int, h: int) -> np.ndarray:
        if y >= self.height:
            return np.zeros((h, self.width, 4), np.uint8)
        h = min(h, self.height - y)
        if not self.cached:
            return self.renderer.render(self.data, self.page, self.dpi, y, h)
        if self.held is None:
            self.held = self.renderer.render(self.data, self.page, self.dpi, 0, self.height)
        return self.held[y : y + h]


def page_strips(files: DataFrame, renderer: PageRenderer, dpi: int, strip_height: int, cached: bool = False) -> DataFrame:
    """Blocks (BLOCK_SCHEMA, rgba8) of pages: rows path, page_number, content, width, height (in pixels at that DPI). Without
    the cache strips are spread over tasks, each with its file; with it a page's strips are made where the page is rendered."""
    from ..operators.resample import BLOCK_SCHEMA

    step = F.lit(strip_height).cast("long")
    rows = files.select("path", "page_number", "content", "width", "height")
    if not cached:
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, step))).repartition("path", "page_number", "y")
    else:
        rows = rows.withColumn("y", F.lit(None).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                strips = PageStrips(renderer, bytes(r.content), int(r.page_number), dpi, int(r.width), int(r.height), cached)
                for y in [int(r.y)] if not cached else range(0, int(r.height), strip_height):
                    x = np.ascontiguousarray(strips.strip(y, strip_height))
                    row = (f"{r.path}#{r.page_number}", 0, y, 0, x.shape[0], x.shape[1], "rgba8", x.tobytes())
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return rows.mapInPandas(run, BLOCK_SCHEMA)
