r"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

A document's size is its number of words `[^\x20\x09-\x0D]+`. Sources in code-point order, null last, have the
weights WEIGHTS, repeating; together they get SHARE of all sizes. No target exceeds MOST times its source's
size; the excess goes to the others by weight until none is above (water-filling: one small aggregate a round).
A source's target is rounded to whole words and filled in the order of md5(doc_id): the whole source at most
MOST times over, the last document in part, so its taken words are its target to the word.

A source's weight changes over training: w(t) = w * (1 + c * (2t - 1)) for t from 0 to 1, c from TILTS,
repeating. Its integral is t + c * (t^2 - t); inverting it at a document's share of the source's demand gives
the document's training position, and the mix is range-sorted by that.

Everything is planned on thin rows (keys, sizes and hashes), range-partitioned by source and order down to the
hash of the whole row and a row number, so that no task holds a whole source, nor all rows of one doc_id or without
one; running sums are of partitions, then within them. Sources are ranked by range partitions. Only mixed_documents
moves texts: once to meet their plan, once to their place in training order.

Null text: size 0, nothing taken. Null doc_id: first in the order. Ties (equal doc_id): by size, larger first, then
by a hash of the row's columns, so reruns agree whatever order rows come in; only equal rows are interchangeable.
Long texts are counted in whole. Empty table: empty result. Extra columns: mixture reads none; mixed_documents keeps
them, but for those that are called mix_copy, mix_words or mix_position (in any case), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, share

WEIGHTS = (3, 1, 2)
TILTS = (0.5, 0.0, -0.5)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(docs: DataFrame) -> Column:
    """Of all columns, however typed, and of which of them are null."""
    mapped = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    own = [(F.col(f"`{f.name}`"), mapped(f)) for f in docs.schema.fields]
    return F.xxhash64(*(F.to_json(F.struct(c)) if m else c for c, m in own), *(c.isNull() for c, _ in own))


def _thin(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """A row for each document: id (of its type), size, source ("" for null), order, print; written, with the part that it is in."""
    order = F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit(""))
    own = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), n_words(F.col(text)).alias("size"), own.alias("source"), order.alias("order"), _hash(docs).alias("print"))
    rows = share(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    parts = share(rows.repartitionByRange("source", "order", F.desc("size"), "print", "row").withColumn("part", F.spark_partition_id()), "mix-parts")
    dropped(rows)
    return parts


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank from 0: null ("") last, code-point order."""
    last, own = F.col("source") == "", F.col("source")
    parts = share(sources.repartitionByRange(last, own).withColumn("part", F.spark_partition_id()), "mix-sources")
    # one row for each range partition
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(last, own))
    return parts.withColumn("rank", inside).join(F.broadcast(before.select("part", "before")), "part").select("source", "total", (F.col("rank") - 1 + F.col("before")).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, size): source, total, target, tilt."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("total")))
    sources = share(sources.withColumns({"weight": pick(WEIGHTS), "tilt": pick(TILTS)}), "mix-ranked")
    most = MOST * F.col("total")
    everything = sources.agg(F.sum("total").alias("t")).first().t or 0
    level, full = 0.0, -1
    while True:  # ends: a source above its limit at one level is so at any higher one
        above = (F.col("weight") * F.lit(level) > most) if full >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(above, 1).otherwise(0)).alias("n"), F.sum(F.when(above, most).otherwise(0)).alias("spent"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")).first()
        if r.n is None or r.n == full or not r.w:
            break
        full, level = r.n, (SHARE * everything - r.spent) / r.w
    target = F.when(F.col("weight") * F.lit(level) > most, most.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "total", target.alias("target"), "tilt")


def _planned(rows: DataFrame) -> DataFrame:
    """rows with total, target, tilt, before (words of the source before the document), words (the target in words)."""
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    # as many rows as partitions and sources
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("start"))
    per = starts.join(targets(rows.select("source", "size")), "source")
    inside = Window.partitionBy("source", "part").orderBy("order", F.desc("size"), "print", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per, ["source", "part"])
    return out.withColumn("before", F.col("start") + F.col("inside")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))


def _taken(copy: int) -> Column:
    """Words of this copy that the mix takes."""
    left = F.col("words") - copy * F.col("total") - F.col("before")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))


def _position(copy: int) -> Column:
    """The time at which the integral of the source's schedule reaches the copy's middle."""
    u = (copy * F.col("total") + F.col("before") + _taken(copy) / 2) / F.col("words")
    c = F.col("tilt")
    return F.when(_taken(copy) > 0, 2 * u / ((1 - c) + F.sqrt((1 - c) * (1 - c) + 4 * c * u)))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, position and position_again (of the copies), sorted by position."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return (
        _planned(_thin(own, "doc_id", "text", "source"))
        .select(
            F.col("id").alias("doc_id"),
            "size",
            F.col("total").alias("source_size"),
            "target",
            sum((_taken(k) for k in range(1, MOST)), _taken(0)).alias("taken"),
            _position(0).alias("position"),
            _position(1).alias("position_again"),
        )
        .orderBy(F.asc_nulls_last("position"), "doc_id", "size", "taken")
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: a row for each copy taken, sorted by position, with mix_copy, mix_words and mix_position.

    A document taken in part keeps its first mix_words words. Other columns of the input keep their names.
    """
    copies = F.array(*(F.struct(F.lit(k).alias("copy"), _taken(k).alias("words"), _position(k).alias("at")) for k in range(MOST)))
    thin = _thin(docs, doc_id, text, source)
    plan = _planned(thin).select("order", "print", "size", F.explode(F.filter(copies, lambda c: c["words"] > 0)).alias("c")).select("order", "print", "size", "c.*")
    # each text moves once to meet its copies; equal rows are one, with the copies of all
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit("")).alias("order"), _hash(docs).alias("print"))
    equal = share(thin.groupBy("order", "print").agg(F.count("*").alias("n")).where("n > 1").select("order", "print"), "mix-equal")
    if not equal.isEmpty():
        one = whole.join(equal, ["order", "print"], "left_semi").groupBy("order", "print").agg(F.any_value("doc").alias("doc"))
        whole = whole.join(equal, ["order", "print"], "left_anti").unionByName(one.select("doc", "order", "print"))
    own = lambda c: F.col("doc")[c]
    words = F.slice(F.regexp_extract_all(own(text), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("words").cast("int"))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(words, "")).otherwise(own(text))
    kept = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_words", "mix_position")]
    shown = [(cut if c.lower() == text.lower() else own(c)).alias(c) for c in kept]
    out = whole.join(plan, ["order", "print"]).select(*shown, F.col("copy").alias("mix_copy"), F.col("words").alias("mix_words"), F.col("at").alias("mix_position"))
    # positions are from 0 to 1 and nearly even (TILTS), so parts of equal length are ranges, without a sampling pass over the texts
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(n, F.least(F.floor(F.col("mix_position") * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("mix_position", "mix_copy")
