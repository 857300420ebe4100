"""The manifest (version 1), the archive's and the checkpoint, as JSON documents. What is as long as the list of tiles is
streamed into them."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import FACT_SCHEMA

VERSION = "1"
MANIFEST_TYPE = (
    "struct<schema_version:string,generation:struct<tile_size:bigint,overlap:bigint,layout:string,format:struct<kind:string,quality:bigint>,concurrency:bigint,background_rgb:array<bigint>,"
    "blank_strategy:struct<kind:string,tolerance:bigint>>,source:struct<width:bigint,height:bigint,pixel_format:string,bytes_hash:string>,"
    "levels:array<struct<level_index:bigint,width:bigint,height:bigint,tiles_produced:bigint,tiles_skipped:bigint>>,sparse_policy:struct<tolerance:bigint,dedupe:boolean>,"
    "checksums:struct<algo:string,per_tile:map<string,string>>,created_at:string,blank_references:map<string,string>>"
)


class ManifestError(ValueError):
    pass


def timestamp(at: Column) -> Column:
    """RFC 3339, seconds, Z; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def build(generation: dict, source: dict, levels: list[dict], created_at: str, checksums: dict | None = None, references: dict | None = None, sparse: dict | None = None) -> dict:
    out = {"schema_version": VERSION, "generation": generation, "source": source, "levels": levels, "sparse_policy": sparse or {"tolerance": 0, "dedupe": False}}
    if checksums:
        out["checksums"] = checksums
    out["created_at"] = created_at
    if references:
        out["blank_references"] = references
    return out


def read(text: str) -> dict:
    """Unknown fields pass, unknown versions don't."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ManifestError(str(e)) from e
    if not isinstance(found, dict) or found.get("schema_version") != VERSION:
        raise ManifestError("unknown manifest version")
    return found


def parsed(text: Column) -> Column:
    """A manifest column as a struct; null for other versions."""
    m = F.from_json(text, MANIFEST_TYPE)
    return F.when(m["schema_version"] == VERSION, m)


def per_tile(manifests: DataFrame, text: str) -> DataFrame:
    """(path, digest) rows of manifest JSON: the map lives only at the edge."""
    return manifests.select(F.explode(parsed(F.col(text))["checksums"]["per_tile"]).alias("path", "digest"))


def put(path: str, text: str | Iterable[str]) -> None:
    """A file appears under its name only when it is whole and durable. Text may come in parts."""
    part = f"{path}.tmp"
    with open(part, "w") as f:
        for piece in [text] if isinstance(text, str) else text:
            f.write(piece)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def _object(rows: DataFrame) -> Iterator[str]:
    """A JSON object of two-column rows, a row at a time."""
    yield "{"
    for i, (key, value) in enumerate(rows.toLocalIterator()):
        yield f"{', ' if i else ''}{json.dumps(key)}: {json.dumps(value)}"
    yield "}"


def write(document: dict, path: str, algorithm: str | None = None, digests: DataFrame | None = None, references: DataFrame | None = None) -> None:
    """The manifest, with digests (path, digest) and references (path, shared_path) streamed into it: the driver holds a row."""

    def parts() -> Iterator[str]:
        levels = [{k: v for k, v in x.items() if k != "done"} for x in document["levels"]]
        for i, (key, value) in enumerate((document | {"levels": levels}).items()):
            if key == "created_at" and digests is not None:
                yield f', "checksums": {{"algo": {json.dumps(algorithm)}, "per_tile": '
                yield from _object(digests)
                yield "}"
            yield f"{', ' if i else '{'}{json.dumps(key)}: {json.dumps(value)}"
        if references is not None:
            yield ', "blank_references": '
            yield from _object(references)
        yield "}"

    put(path, parts())


def archive(stem: str, extension: str, tile_size: int, overlap: int, width: int, height: int, layout: str, levels: list) -> str:
    """The shorter manifest inside archives (version 0)."""
    name = {"deep_zoom": "DeepZoom", "xyz": "Xyz", "google": "Google"}[layout]
    rows = [{"level": r.level, "width": r.level_width, "height": r.level_height, "cols": r.cols, "rows": r.rows} for r in levels]
    head = {"schema": "tilewright.packfile.v0", "stem": stem, "tile_format": extension, "tile_size": tile_size, "overlap": overlap, "image_width": width, "image_height": height, "layout": name}
    return json.dumps(head | {"tile_prefix": f"{stem}_files", "levels": rows}, indent=2) + "\n"


# -- checkpoints ----------------------------------------------------------------------------------


def _checkpoint(plan_hash: str, tiles: Iterable, levels: list[int], started: str, last: str) -> Iterator[str]:
    yield f'{{\n  "schema_version": {json.dumps(VERSION)},\n  "plan_hash": {json.dumps(plan_hash)},\n  "completed_tiles": ['
    for i, (level, col, row) in enumerate(tiles):
        yield f"{',' if i else ''}\n    " + json.dumps({"level": level, "col": col, "row": row})
    yield f'],\n  "levels_completed": {json.dumps(levels)},\n  "started_at": {json.dumps(started)},\n  "last_checkpoint_at": {json.dumps(last)}\n}}\n'


def checkpoint(plan_hash: str, completed: Iterable[tuple[int, int, int]], levels: list[int], started: str, last: str) -> str:
    return "".join(_checkpoint(plan_hash, completed, levels, started, last))


def read_checkpoint(text: str | None, plan_hash: str) -> dict | None:
    """None if there is none; another plan's, another version's or a corrupt one raises."""
    if text is None:
        return None
    try:
        found = json.loads(text)
        tiles = [(t["level"], t["col"], t["row"]) for t in found["completed_tiles"]]
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ManifestError(f"corrupt checkpoint: {e}") from e
    if found.get("schema_version") != VERSION:
        raise ManifestError("unknown checkpoint version")
    if found.get("plan_hash") != plan_hash:
        raise ManifestError("checkpoint of another plan")
    return {"levels_completed": [], "started_at": "", "last_checkpoint_at": ""} | found | {"completed_tiles": tiles}


class Progress:
    """What of a plan is done, below a root: writers append the tiles that they have finished to files of their own
    (lines of JSON), so that a run that was killed goes on from there and no process holds them all; the checkpoint file
    itself is written when a run ends, for other readers."""

    def __init__(self, root: str, plan_hash: str):
        self.root, self.plan_hash, self.folder, self.file = root, plan_hash, os.path.join(root, ".checkpoint.d"), os.path.join(root, ".checkpoint.json")
        self.started = ""

    def check(self, spark: SparkSession) -> bool:
        """Whether there is a checkpoint of this plan; another plan's raises."""
        head = os.path.join(self.folder, "plan.json")
        if os.path.exists(head):
            with open(head) as f:
                found = json.load(f)
            if found["plan_hash"] != self.plan_hash:
                raise ManifestError("checkpoint of another plan")
            self.started = found["started_at"]
            return True
        if not os.path.exists(self.file):
            return False
        with open(self.file) as f:
            self.started = read_checkpoint(f.read(), self.plan_hash)["started_at"]
        return True

    def open(self, spark: SparkSession, now: str, fresh: bool) -> None:
        if fresh:
            shutil.rmtree(self.folder, ignore_errors=True)
            if os.path.exists(self.file):
                os.remove(self.file)
        known = not fresh and self.check(spark)
        os.makedirs(self.folder, exist_ok=True)
        self.started = self.started if known else now
        head = os.path.join(self.folder, "plan.json")
        if os.path.exists(head):
            return
        if known:  # a checkpoint without the writers' files
            with open(self.file) as f:
                tiles = read_checkpoint(f.read(), self.plan_hash)["completed_tiles"]
            put(os.path.join(self.folder, "part-imported.jsonl"), (json.dumps(dict(zip(("level", "col", "row"), t))) + "\n" for t in tiles))
        put(head, json.dumps({"plan_hash": self.plan_hash, "started_at": self.started}))

    def completed(self, spark: SparkSession) -> DataFrame | None:
        """Facts of the tiles done, one for each; None if there are none. Lines cut short by a kill don't count."""
        if not os.path.isdir(self.folder) or not any(n.startswith("part-") for n in os.listdir(self.folder)):
            return None
        rows = spark.read.schema(FACT_SCHEMA).json(os.path.join(self.folder, "part-*.jsonl")).where("level is not null and col is not null and row is not null")
        return rows.groupBy("level", "col", "row").agg(*(F.max(c).alias(c) for c in ("path", "bytes", "digest", "content", "blank", "uniform")))

    def close(self, spark: SparkSession, done: DataFrame, levels: list[int], now: str) -> None:
        rows = (tuple(r) for r in done.select("level", "col", "row").orderBy("level", "col", "row").toLocalIterator())
        put(self.file, _checkpoint(self.plan_hash, rows, levels, self.started, now))
