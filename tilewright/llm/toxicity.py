"""Toxicity by subword-bag embeddings averaged into a linear softmax (subword.py), over windows of four words.

The model learns from a bounded sample of labelled rows: at most MAX_PER_CLASS documents of each label, those of at
most TRAIN_CHARS characters first, then by a hash of doc_id; of a longer text the first TRAIN_CHARS are learned from
(so long texts are used where there are not enough others). Rows whose crc32(doc_id as text) mod 5 is 0 are held
out of it. Every whole text is scored, however long, by its strongest window.

Null or empty text, or one without words: score 0.0, predicted 0. Null labels are ignored; conflicting labels
of a document count as toxic. Null doc_id: scored, not held out. Repeated rows: each is scored; rows that share a
doc_id are one labelled document, with the least of their texts. Ties: the first window. Without labelled rows of
both classes every score is 0.0. Empty table: empty result. Extra columns are kept by without_toxic, whatever their
names, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import unused
from .subword import SubwordModel

MAX_PER_CLASS = 1500
TRAIN_CHARS = 20_000
FOLDS, FOLD = 5, 0
WINDOW = 4


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> SubwordModel | None:
    """Fits on the driver; what it collects is bounded by the two constants above."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    known = known.where(~held_out("id", FOLDS, FOLD))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null")
    # thin rows: of texts their length alone
    sized = texts.select("id", F.length("t").alias("n")).join(known, "id").groupBy("id", "y").agg(F.min("n").alias("n"))
    order = [F.col("n") > TRAIN_CHARS, F.xxhash64("id"), F.col("id")]
    picked = sized.where("y = 0").orderBy(*order).limit(max_per_class).unionByName(sized.where("y = 1").orderBy(*order).limit(max_per_class)).select("id", "y")
    # at most 2 * max_per_class rows of two numbers; texts are cut before they move
    rows = texts.join(F.broadcast(picked), "id").select("id", "y", F.substring("t", 1, TRAIN_CHARS).alias("t")).groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id").collect()
    if len({r.y for r in rows}) < 2:
        return None
    return SubwordModel([0, 1], window=WINDOW).fit([r.t for r in rows], [r.y for r in rows], epochs=8, warm=1)


def score_column(model: SubwordModel | None, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = model.logits(list(texts))
            yield pd.Series(np.nan_to_num(1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50))), nan=0.0))

    return F.lit(0.0) if model is None else scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, doc_id, text)
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, FOLD).alias("held_out"), score_column(model, F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents scored 0.5 or more; columns and other rows as they were."""
    model = train(docs, labels, doc_id, text)
    score = unused("toxic_score", docs)
    return docs.withColumn(score, score_column(model, F.col(text))).where(F.col(score) < 0.5).drop(score)
