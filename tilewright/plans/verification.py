"""Checks of written output against its manifest: files are read and hashed by executors, a row at a time."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions import hashing
from ..operators import contents
from ..sources.sinks import BLANK
from . import manifest


class ManifestNotFound(manifest.ManifestError):
    pass


class ChecksumMismatch(ValueError):
    pass


@dataclass
class Found:
    algorithm: str | None
    digests: DataFrame  # path, digest
    references: DataFrame  # path, shared_path


def load(spark: SparkSession, out: str, missing_ok: bool = False) -> Found:
    """The manifest beside a folder, else the one in it."""
    out = out.rstrip("/")
    path = next((p for p in (out + ".manifest.json", os.path.join(out, "manifest.json")) if os.path.isfile(p)), None)
    none = spark.createDataFrame([], "path string, digest string"), spark.createDataFrame([], "path string, shared_path string")
    if path is None:
        if missing_ok:
            return Found(None, *none)
        raise ManifestNotFound(f"no manifest beside or in {out}")
    found = spark.read.text(path, wholetext=True).select(manifest.parsed(F.col("value")).alias("m"))
    head = found.select(F.col("m").isNull().alias("bad"), "m.checksums.algo").first()
    if head.bad:
        raise manifest.ManifestError(f"not a manifest of version {manifest.VERSION}: {path}")
    if head.algo not in (None, "blake3", "sha256"):
        raise manifest.ManifestError(f"unknown digest: {head.algo}")
    digests = found.select(F.explode("m.checksums.per_tile").alias("path", "digest")) if head.algo else none[0]
    return Found(head.algo, digests, found.select(F.explode("m.blank_references").alias("path", "shared_path")))


def content(path: str, shared: str | None, out: str) -> bytes | None:
    """Of a tile's file, or of the shared file where it is the placeholder of a repeated tile; None if it isn't there."""
    try:
        with open(path, "rb") as f:
            data = f.read()
        if data == BLANK and shared:
            with open(os.path.join(out, shared), "rb") as f:
                data = f.read()
    except FileNotFoundError:
        return None
    return data


def statuses(spark: SparkSession, out: str) -> DataFrame:
    """path, status (ok, mismatched, missing) of every tile in the manifest's checksums; hex case aside."""
    out, found = out.rstrip("/"), load(spark, out)
    algorithm = found.algorithm

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                data = content(os.path.join(out, r.path), r.shared_path, out)
                same = data is not None and hashing.hex_digest(data, algorithm) == r.digest.lower()
                rows.append((r.path, "missing" if data is None else "ok" if same else "mismatched"))
            yield pd.DataFrame(rows, columns=["path", "status"])

    rows = found.digests.join(found.references, "path", "left").select("path", "digest", "shared_path")
    return rows.repartition("path").mapInPandas(run, "path string, status string")


def verify_output(spark: SparkSession, out: str) -> Row:
    """tiles_checked, tiles_ok, tiles_mismatched, tiles_missing; all zero without checksums."""
    return contents.verify_report(statuses(spark, out)).first()
