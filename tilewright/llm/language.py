"""Language identification: averaged hashed subword embeddings with a linear softmax (subword.py), trained by
minibatch stochastic gradient descent in numpy, with calibrated rejection.

The model learns every language that a document has, from a sample of at most MAX_ROWS documents (but one of each
language): the same number of each, PER_LANGUAGE at most, the first by a hash of doc_id and text, none with
crc32(doc_id as text) mod 4 of 2. Of a text longer than TRAIN_CHARS a span of that length, from a place that the hash
gives, is learned from. Every third row of a language's sample is held back: they set the softmax temperature and
the score under which a prediction counts as rejected, the lowest with an accuracy of ACCURACY above it.

Null text, or text without a letter: `und`, score 0.0, rejected. Every whole text is predicted, however long. Null
doc_id: never held out, never learned from. Null lang: predicted, not learned from. Repeated rows: each is
predicted, and learned from once. Ties: the first language by code point. One language: it alone, with score 1.0.
Without a labelled row: `und`. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import dropped, share
from .subword import SubwordModel, has_letter, softmax
from .toxicity import held_out

PER_LANGUAGE = 900
MAX_ROWS = 20_000
TRAIN_CHARS = 4_000
CALIBRATION = 3
ACCURACY = 0.99
FOLDS, FOLD = 4, 2
BUCKETS = 4096  # of the hash, to find how much of it holds the rows wanted
RESULT = "lang_pred string, score double, rejected boolean"


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int, max_rows: int) -> dict[str, list[str]]:
    """Texts to learn from, by language, collected: as many rows as the bounds allow and a bucket's more."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("y"), F.col(text).alias("t")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & F.col("t").isNotNull() & ~held_out("id", FOLDS, FOLD))
    known = known.select("y", "t", F.xxhash64("id", "t").alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1))
    # BUCKETS rows for each language, whatever the number of documents
    counts = known.groupBy("y", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("y").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = share(counts.withColumn("before", F.coalesce(upto, F.lit(0))), "language-counts")
    each = max(1, min(per_language, max_rows // max(1, counts.select("y").distinct().count())))
    last = counts.where(F.col("before") < each).groupBy("y").agg(F.max("bucket").alias("last"))
    at = 1 + F.pmod("h", F.greatest(F.length("t") - TRAIN_CHARS + 1, F.lit(1)))
    picked = known.join(F.broadcast(last), "y").where("bucket <= last").select("y", "h", F.substring("t", at.cast("int"), F.lit(TRAIN_CHARS)).alias("t")).distinct()
    by: dict[str, list[str]] = {}
    for r in picked.orderBy("y", F.shiftrightunsigned("h", 1), "h", "t").collect():
        if len(own := by.setdefault(r.y, [])) < each:
            own.append(r.t)
    dropped(counts)
    return by


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS):
    """(model, temperature, least accepted score), or None without labelled rows. Fits on the driver."""
    by = sample(docs, doc_id, text, lang, per_language, max_rows)
    if not by:
        return None
    classes = sorted(by)
    rows = [(i, t, k) for k, y in enumerate(classes) for i, t in enumerate(by[y])]
    held = [(t, k) for i, t, k in rows if i % CALIBRATION == CALIBRATION - 1]
    fit = [(t, k) for i, t, k in rows if i % CALIBRATION != CALIBRATION - 1]
    model = SubwordModel(classes).fit([t for t, _ in fit], [k for _, k in fit], epochs=8, span=32)
    z = model.logits([t for t, _ in held])
    y = np.array([k for _, k in held])
    y, z = y[~np.isnan(z[:, 0])].astype(int), z[~np.isnan(z[:, 0])]
    if not len(z):
        return model, 1.0, 0.0
    loss = lambda c: -np.log(softmax(z * c)[np.arange(len(y)), y] + 1e-12).mean()
    scale = min((0.5, 0.7, 1, 1.5, 2, 3, 4, 6), key=loss)
    p = softmax(z * scale)
    s, right = p.max(1), p.argmax(1) == y
    by_score = np.argsort(-s, kind="stable")
    good = np.flatnonzero(np.cumsum(right[by_score]) >= ACCURACY * np.arange(1, len(s) + 1))
    return model, float(scale), float(s[by_score[good[-1]]]) if len(good) else 1.0


def language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    trained = train(docs, doc_id, text, lang)

    @F.pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [("und", 0.0, True)] * len(texts)
            if trained:
                model, scale, least = trained
                p = softmax(model.logits(list(texts)) * scale)
                s, best = p.max(1), p.argmax(1)
                rows = [(model.classes[b], float(x), bool(x < least)) if not np.isnan(x) and has_letter(t) else r for t, x, b, r in zip(texts, s, best, rows)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, FOLD).alias("held_out"), predicted(F.col(text)).alias("p")).select("doc_id", "held_out", "p.*")
