"""Tile sinks. Tiles are rows path, data, blank (data as encoded).

A job's tasks write where they make tiles (FactWriter) and report each one. Directories are also a Python data source
(one writer for each task, commit on the driver), and object stores take an injected put(); retries wait by the backoff
schedule, and a policy decides what a final failure means. Archives have one writer by nature: one task, which reads
the encoded tiles in path order.
"""

from __future__ import annotations

import io
import json
import os
import random
import shutil
import tarfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BLANK = b"\x00"
#: What a writer reports of a tile (or of a block that the next phase reads). content: a digest for dedupe.
FACT_SCHEMA = (
    "kind string, image_id string, level long, col long, row long, path string, y0 long, x0 long, w long, h long, pixel_format string, bytes long, digest string, content string, "
    "blank boolean, uniform boolean, retries long, skipped boolean, held long"
)
POLICIES = ("fail_fast", "retry_then_fail", "retry_then_skip")


@dataclass
class RetryPolicy:
    max_retries: int = 3
    initial_ms: float = 50.0
    multiplier: float = 2.0
    most_ms: float = 5000.0
    jitter: bool = True

    def wait_ms(self, attempt: int, rng: random.Random | None = None) -> float:
        base = min(self.initial_ms * self.multiplier**attempt, self.most_ms)
        return base + (rng.uniform(0, base / 2) if self.jitter and rng else 0)


def attempt(write: Callable[[], None], policy: RetryPolicy, failures: str, rng: random.Random, sleep=time.sleep) -> tuple[int, bool]:
    """(retries, written). The last error is raised unless failures are skipped; fail_fast doesn't retry."""
    tries = 0 if failures == "fail_fast" else policy.max_retries
    for k in range(tries + 1):
        try:
            write()
            return k, True
        except OSError:
            if k == tries:
                if failures == "retry_then_skip":
                    return k, False
                raise
            sleep(policy.wait_ms(k, rng) / 1000)
    raise AssertionError


@dataclass
class Written(WriterCommitMessage):
    tiles: int = 0
    blanks: int = 0
    retries: int = 0
    skipped: int = 0
    bytes: int = 0


def put_file(target: str, data: bytes) -> None:
    """A file appears under its name only when it is whole: a task that is run again leaves no half tile."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{os.getpid()}.{random.getrandbits(32):08x}.tmp"
    try:
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, target)
    except OSError:
        if os.path.exists(part):
            os.remove(part)
        raise


@dataclass
class FactWriter:
    """Writes a task's tiles below `out` and its blocks below `blocks`; tiles done are also lines of a file of its own
    below `progress`, made durable every `every` tiles and at the end. Tiles that failed for good and are skipped are not."""

    out: str
    blocks: str
    progress: str
    every: int = 0
    algorithm: str | None = None
    options: dict = field(default_factory=dict)
    sink: Callable[[str, bytes], None] | None = None

    @contextmanager
    def opened(self) -> Iterator[FactWriter]:
        self.failures = self.options.get("failures", "fail_fast")
        self.policy = RetryPolicy(int(self.options.get("max_retries", 3)), float(self.options.get("initial_ms", 50)))
        self.rng, self.lines, self.file = random.Random(), [], None
        try:
            yield self
        finally:  # also when the task fails: what is written is done
            self._flush()
            if self.file:
                self.file.close()

    def _flush(self) -> None:
        if not self.lines:
            return
        if not self.file:
            self.file = open(os.path.join(self.progress, f"part-{uuid.uuid4().hex}.jsonl"), "a")  # noqa: SIM115
        self.file.write("".join(self.lines))
        self.file.flush()
        os.fsync(self.file.fileno())
        self.lines = []

    def tile(self, r, path: str, data: bytes) -> tuple:
        from ..functions.hashing import hex_digest

        write = (lambda: self.sink(path, data)) if self.sink else (lambda: put_file(os.path.join(self.out, path), data))
        retries, ok = attempt(write, self.policy, self.failures, self.rng)
        digest = hex_digest(data, self.algorithm) if self.algorithm else None
        fact = {
            "kind": "tile", "image_id": r.image_id, "level": int(r.level), "col": int(r.col), "row": int(r.row), "path": path, "y0": None, "x0": None, "w": int(r.w), "h": int(r.h), "pixel_format": r.pixel_format, "bytes": len(data),
            "digest": digest, "content": hex_digest(data, "sha256"), "blank": bool(r.blank), "uniform": bool(r.uniform), "retries": retries, "skipped": not ok, "held": len(r.data),
        }
        if ok:
            self.lines.append(json.dumps(fact) + "\n")
            if self.every and len(self.lines) >= self.every:
                self._flush()
        return tuple(fact.values())

    def block(self, r) -> tuple:
        path = os.path.join(self.blocks, f"{r.level}_{r.y0}_{r.x0}.raw")
        put_file(path, r.data)
        return ("block", r.image_id, int(r.level), None, None, path, int(r.y0), int(r.x0), int(r.w), int(r.h), r.pixel_format, len(r.data), None, None, False, False, 0, False, len(r.data))


def shared_file(path: str, shared: str) -> None:
    """The shared file is the first tile of its content, under another name."""
    os.makedirs(os.path.dirname(shared), exist_ok=True)
    if not os.path.exists(shared):
        part = f"{shared}.{uuid.uuid4().hex}.tmp"
        try:
            os.link(path, part)
        except OSError:
            shutil.copyfile(path, part)
        os.replace(part, shared)


def placeholder(path: str, shared: str) -> None:
    put_file(path, BLANK)


def linked(path: str, shared: str) -> str:
    """A repeated tile as a link to its shared file: symbolic, else hard, else the placeholder. Which it became."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    for name, make in (("symlink", lambda: os.symlink(os.path.relpath(shared, os.path.dirname(path)), part)), ("hardlink", lambda: os.link(shared, part))):
        try:
            make()
            os.replace(part, path)
            return name
        except OSError:
            continue
    placeholder(path, shared)
    return "placeholder"


class TileDirectory(DataSource):
    """df.write.format("tile_directory").option("path", ...): a file for each tile, blank ones as one zero byte.
    Options: failures (POLICIES), max_retries, initial_ms, delay_ms (a wait before each tile, to try slow stores).
    The folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "tile_directory"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DirectoryWriter(dict(self.options))


class DirectoryWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.failures = options["path"], options.get("failures", "fail_fast")
        if self.failures not in POLICIES:
            raise ValueError(f"unknown failure policy: {self.failures}")
        self.policy = RetryPolicy(int(options.get("max_retries", 3)), float(options.get("initial_ms", 50)))
        self.delay = float(options.get("delay_ms", 0)) / 1000

    def put(self, path: str, data: bytes) -> None:
        time.sleep(self.delay)
        put_file(os.path.join(self.path, path), data)

    def write(self, iterator) -> Written:
        out, rng = Written(), random.Random()
        for row in iterator:
            data = BLANK if row["blank"] else bytes(row["data"])
            retries, ok = attempt(lambda row=row, data=data: self.put(row["path"], data), self.policy, self.failures, rng)
            out.tiles += ok
            out.blanks += bool(row["blank"])
            out.retries += retries
            out.skipped += not ok
            out.bytes += len(data) if ok else 0
        return out

    def commit(self, messages) -> None:
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("tiles", "blanks", "retries", "skipped", "bytes")}
        self.put("_committed.json", json.dumps(total).encode())

    def abort(self, messages) -> None:
        pass


@dataclass
class ObjectConfig:
    """Of an object store; keys don't show in its text form. multipart_threshold is a hint to put()."""

    endpoint: str = ""
    bucket: str = ""
    access_key: str = field(default="", repr=False)
    secret_key: str = field(default="", repr=False)
    prefix: str = ""
    image_name: str = "image"
    multipart_threshold: int = 8 << 20


def write_objects(tiles: DataFrame, put: Callable[[str, bytes], None] | None, policy: RetryPolicy | None = None, failures: str = "fail_fast") -> None:
    """Tiles (key, data) to an injected store, from the executors."""
    if put is None:
        raise ValueError("an object store needs a put()")
    policy = policy or RetryPolicy()

    def run(rows) -> None:
        rng = random.Random()
        for r in rows:
            attempt(lambda r=r: put(r["key"], bytes(r["data"])), policy, failures, rng)

    tiles.select("key", "data").foreachPartition(run)


def archive_entries(stem: str, path: str) -> tuple[str, str]:
    """A tile is found under both names."""
    return f"{stem}_files/{path}", f"{stem}/{path}"


def write_archive(tiles: DataFrame, out: str, stem: str, extra: Iterable[tuple[str, bytes]] = ()) -> int:
    """tar, tar.gz or zip by its name, in a folder that executors share; blank tiles are left out, `extra` files come last.
    One task sorts the tiles by path (on its disk where they are many) and writes them; none passes the driver."""
    extra = list(extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows = f"{out}.{uuid.uuid4().hex}.tmp", ((p, bytes(d)) for batch in batches for p, d in zip(batch["path"], batch["data"]))
        if out.endswith(".zip"):
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
                n = _fill(lambda name, data: z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED), rows, stem, extra)
        else:
            with tarfile.open(part, "w:gz" if out.endswith((".gz", ".tgz")) else "w") as t:

                def add(name: str, data: bytes) -> None:
                    info = tarfile.TarInfo(name)
                    info.size, info.mode, info.mtime = len(data), 0o644, 0
                    t.addfile(info, io.BytesIO(data))

                n = _fill(add, rows, stem, extra)
        os.replace(part, out)
        yield pd.DataFrame({"n": [n]})

    kept = tiles.where("not blank").select("path", "data").repartition(1).sortWithinPartitions("path")
    return kept.mapInPandas(run, "n long").first().n


def _fill(add, rows, stem: str, extra) -> int:
    n = 0
    for path, data in rows:
        for name in archive_entries(stem, path):
            add(name, data)
        n += 1
    for name, data in extra:
        add(name, data)
    return n
