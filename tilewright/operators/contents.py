"""Contents by digest: dedupe, verification, resume, and the event log's gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tilemath import shared_path

SALTS = 16


def deduped(items: DataFrame, digest: str, *order: str) -> DataFrame:
    """items with decision (write_new for the first of a digest in `order`, else reference). The first is found by a
    partial aggregate: no task holds all items of a digest."""
    first = items.groupBy(digest).agg(F.min(F.struct(*order)).alias("__first"))
    return items.join(first, digest).withColumn("decision", F.when(F.struct(*order) == F.col("__first"), "write_new").otherwise("reference")).drop("__first")


def seeded(items: DataFrame, index: DataFrame, digest: str, *order: str) -> DataFrame:
    """The same with an index (digest) of contents that an earlier run has written: what it knows is a reference."""
    known = index.select(digest).distinct().withColumn("__known", F.lit(True))
    out = deduped(items, digest, *order).join(known, digest, "left")
    return out.withColumn("decision", F.when(F.col("__known"), "reference").otherwise(F.col("decision"))).drop("__known")


def forgotten(index: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """An index (digest, path) without the entries of paths that are no more."""
    return index.join(paths.select(path), path, "left_anti")


def references(decided: DataFrame, digest: str, path: str) -> DataFrame:
    """path -> shared path of the items that are references."""
    return decided.where("decision = 'reference'").select(path, shared_path(F.col(digest), F.col(path)).alias("shared_path"))


def distinct_contents(items: DataFrame, digest: str) -> DataFrame:
    return items.agg(F.count_distinct(digest).alias("distinct_contents"), F.count("*").alias("items"))


def verified(manifest: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """manifest (path, digest) against files (path, digest): path, status ok, mismatched or missing; hex case aside.
    A manifest without entries gives no rows."""
    found = files.select(path, F.lower("digest").alias("__found"))
    status = F.when(F.col("__found").isNull(), "missing").when(F.lower("digest") == F.col("__found"), "ok").otherwise("mismatched")
    return manifest.join(found, path, "left").select(path, status.alias("status"))


def verify_report(statuses: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(F.count("*").alias("tiles_checked"), n("ok").alias("tiles_ok"), n("mismatched").alias("tiles_mismatched"), n("missing").alias("tiles_missing"))


KEY = ["image_id", "level", "col", "row"]


def _moved(tiles: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, never broadcast: Spark takes exploded tiles to be as small as the images
    that they come from, and would send all of them through the driver into each task."""
    return tiles.hint("merge")


def remaining(planned: DataFrame, completed: DataFrame) -> DataFrame:
    """Tiles of the plan still to be made: filtered before any pixel is touched."""
    return planned.join(_moved(completed.select(*KEY)), KEY, "left_anti")


def completed_of(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.join(_moved(completed.select(*KEY)), KEY, "left_semi")


def levels_completed(planned: DataFrame, completed: DataFrame) -> DataFrame:
    """Levels all of whose tiles are completed, counted by distinct coordinates."""
    done = completed.select(*KEY).distinct().groupBy("image_id", "level").agg(F.count("*").alias("done"))
    total = planned.groupBy("image_id", "level").agg(F.count("*").alias("total"))
    return total.join(_moved(done), ["image_id", "level"]).where("done >= total").select("image_id", "level")


def running_peak(log: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    """Per key: what is held in the end and the peak of the running sum of amounts (allocations +, releases -)."""
    running = F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("__held", running).groupBy(key).agg(F.max("__held").alias("peak"), F.sum(amount).alias("held"), F.count("*").alias("events"))
