r"""Quality rules by cross-document line frequency, beside per-document rules.

Words are `[^\x20\x09-\x0D]+`. Lines are \n-split; a line with a word is normalised (A-Z lower-cased, its words
joined by one blank) and hashed (64 bits). For each host (the source column; null is a host of its own) and
line hash, the documents that hold it are counted; a line in more than MAX_DOCS documents of its host is
removed, and a document is rejected if fewer than MIN_LEFT of its words, or fewer than MIN_WORDS, are left.
Copies of a document count as documents: the rule is about what a host repeats.

Null or empty text: no words, base_failed. Long texts: whole. Repeated rows: each is judged; rows with the same doc_id
are one document in the counts. Null doc_id: such rows of a host are one document. Ties: lines that are equal when
normalised are one line. Empty table: empty result. Extra columns are kept by `cleaned`, whatever their names, and not
read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, encode, share, unused, window_hashes, word_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DOCS = 50
MIN_LEFT = 0.3
SALTS = 16
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more."""
    if len(words) <= window:
        return 0
    h = window_hashes(word_hashes(words), window)
    by = np.argsort(h)
    same = h[by[1:]] == h[by[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def features(text) -> tuple:
    raw = encode(text)
    words = raw.split()
    filled = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    lines = [x.lower().split() for x in filled]
    return (
        len(words),
        (len(text) if isinstance(text, str) else 0) - (len(raw) - len(raw.translate(None, WHITE))),
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(filled) - len(set(filled)),
        repeated_words(words),
        [line_hash(x) for x in lines],
        [len(x) for x in lines],
    )


def _features(text: Column) -> Column:
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([features(t) for t in texts], columns=names)

    return measured(text)


def _measured(docs: DataFrame, doc_id: str, text: str, host: str, row: Column) -> DataFrame:
    """One pass over the texts; only measures and line hashes go on."""
    return docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), _features(F.col(text)).alias("f")).select("row", "doc_id", "host", "f.*")


def _frequent(f: DataFrame, max_docs: int) -> DataFrame:
    """(host, h) of lines in more than max_docs documents of a host."""
    # a document's lines become distinct beside it, counts are partial before the shuffle
    each = f.select("doc_id", "host", F.explode(F.array_distinct("line_hash")).alias("h"))
    ids = f.groupBy("host", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("host", "doc_id")
    # rows of one document: their lines count once
    once = each.join(ids, [each.host.eqNullSafe(ids.host), each.doc_id.eqNullSafe(ids.doc_id)], "left_anti")
    more = each.join(ids, [each.host.eqNullSafe(ids.host), each.doc_id.eqNullSafe(ids.doc_id)], "left_semi").distinct()
    return once.unionByName(more).groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "h")


def _removed(f: DataFrame, often: DataFrame) -> DataFrame:
    """(row, h, w) of the frequent lines of every row."""
    lines = f.select("row", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("row", "host", F.col("l.line_hash").alias("h"), F.col("l.line_words").alias("w"))
    # a frequent line of a hot host has many rows: both sides are salted
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    a, b = lines.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).alias("a"), often.alias("b")
    return a.join(b, [F.col("a.h") == F.col("b.h"), F.col("a.host").eqNullSafe(F.col("b.host")), F.col("a.salt") == F.col("b.salt")], "left_semi")


def _judged(f: DataFrame, removed: DataFrame, min_left: float, min_words: int) -> DataFrame:
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    words = removed.groupBy("row").agg(F.sum("w").cast("long").alias("n_removed_words"))
    both = f.join(words, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    return both.withColumns({"base_failed": base_failed, "kept": ~base_failed & (left >= min_words) & (left >= min_left * F.col("n_words"))})


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, n_removed_words, kept."""
    f = share(_measured(docs, doc_id, text, host, F.monotonically_increasing_id()), "quality")
    return _judged(f, _removed(f, _frequent(f, max_docs)), min_left, min_words).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents kept, without their frequent lines; other columns as they were."""
    row = unused("row", docs)
    numbered = share(docs.withColumn(row, F.monotonically_increasing_id()), "quality-documents")
    f = share(_measured(numbered, doc_id, text, host, F.col(row)), "quality")
    removed = share(_removed(f, _frequent(f, max_docs)), "quality-removed")
    gone, own = removed.groupBy("row").agg(F.collect_set("h").alias("gone")), unused("gone", docs)
    verdict = _judged(f, removed, min_left, min_words).where("kept").select("row").join(gone, "row", "left").withColumnsRenamed({"row": row, "gone": own})

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, hashes in zip(texts, lists):
                if hashes is None or not len(hashes):
                    out.append(t)
                    continue
                drop = set(hashes.tolist())
                out.append("\n".join(x for x in t.split("\n") if not (w := encode(x).lower().split()) or line_hash(w) not in drop))
            yield pd.Series(out, dtype=object)

    cut = F.when(F.col(own).isNotNull(), without(F.col(text), F.col(own))).otherwise(F.col(text))
    return numbered.join(verdict, row).select(*((cut if c.lower() == text.lower() else F.col(f"`{c}`")).alias(c) for c in docs.columns))
