r"""Suffix-array dedup: passages of LENGTH words or more that several documents hold, by sparse suffix arrays.

A-Z is lower-cased, words are `[^\x20\x09-\x0D]+`; a word is its 64-bit hash.

1. Documents with equal words are one class (what is long enough in it repeats as a whole).
2. Sparse suffixes: of each class those at minimiser positions, the least hashes of GRAM words in any
   LENGTH // 2 positions in a row. A shared passage has the same minimisers in all documents, one of them in
   its first half, so a suffix that begins there stays in the passage for SEED words.
3. A suffix whose first SEED words (as one 64-bit hash) no other class has can't match and drops out before any
   words are moved. The others are dealt by those words, so that suffixes which can match meet, with the words
   that follow and precede them, LENGTH - SEED on either side.
4. Suffix arrays: in each part the suffixes are sorted by their first SEED words, then word by word, and neighbours
   are compared: the words that two neighbours share bound those that all between them share. The same suffixes
   are sorted and compared by the words before them, backwards. For each number d of words to the left, the
   suffixes that share d words to the left and LENGTH - d to the right are one group of the two orders; if
   it has several documents, the window is in all of them. Windows that follow one another are one range: the match,
   extended left and right. Matches longer than that are found from each of their minimisers and merged by document.
5. A group of more than about HOT suffixes (a passage that very many documents hold) is dealt to several shards, each
   sorted and compared by itself. Of each group of equal windows in a shard one representative, with the least and the
   last of its documents, is compared with those of the other shards, by a hash of the window; what is then known to be
   in several documents goes back to the shards that have it.

No pairs of documents are formed, and none of the windows is lost. Null or short texts (fewer than LENGTH words):
nothing repeats. Long texts: in whole; a row's suffixes are what a task holds of it. Ties (equal suffixes) are one
group, their order is free. Rows that share a doc_id are one document: what only they share is not repeated. Null
doc_id: nothing is looked for. Extra columns are not read. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_words, mixed, semi_joined, share, window_hashes, word_hashes

LENGTH = 50
GRAM = 8
HOT = 1_000  # suffixes with the same first words in a shard
ROWS = 20_000  # suffixes compared at a time
PIECE = 2_000  # suffixes that leave a Python worker at a time, each with 2 * (LENGTH - SEED) words of 8 bytes
FRAGMENTS = "print long, doc long, last long, at int, shard int, seed long, right binary, left binary"
RANGES = "print long, doc long, a int, b int, first long"


def seed_length(length: int) -> int:
    return length - length // 2 + 1


def _sliding(x: np.ndarray, k: int, f) -> np.ndarray:
    """f over each k consecutive values."""
    out, size = x, 1
    while 2 * size <= k:
        out, size = f(out[:-size], out[size:]), 2 * size
    return out if size == k else f(out[: len(x) - k + 1], out[k - size : len(x) - size + 1])


def minimisers(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Positions of the least gram hashes of every length // 2 positions in a row; none in fewer than length words."""
    w = length // 2
    if len(h) < length:
        return np.empty(0, np.int64)
    g = window_hashes(h, gram)
    least = _sliding(g, w, np.minimum)
    # a position is one if the greatest of the minima over the windows around it is its own hash
    around = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64))), w, np.maximum)
    at = np.flatnonzero(around == g)
    return at[at + seed_length(length) <= len(h)]


def _print(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _suffixes(text: Column, length: int, gram: int) -> Column:
    @F.pandas_udf("n_words long, print long, at array<int>, seed array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = word_hashes(lower_words(t))
                at = minimisers(h, length, gram)
                seeds = window_hashes(h, seed_length(length))[at] if len(at) else np.empty(0, np.uint64)
                rows.append((len(h), _print(h), at.astype(np.int32), seeds.view(np.int64)))
            yield pd.DataFrame(rows, columns=["n_words", "print", "at", "seed"])

    return found(text)


def surroundings(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at `at` the words after their first seed_length(length), and those before them, nearest first; 0 beyond the text."""
    seed = seed_length(length)
    more = length - seed
    padded = np.concatenate((np.zeros(more, np.uint64), h, np.zeros(more, np.uint64)))
    step = np.arange(more)
    return padded[at[:, None] + more + seed + step], padded[at[:, None] + more - 1 - step]


def _fragments(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The suffixes of texts at `at`, with their surroundings, a few at a time; none of a text that isn't the one of that print."""
    names = [x.split()[0] for x in FRAGMENTS.split(", ")]

    def pieces(x: np.ndarray) -> list[bytes]:
        raw, n = x.astype(">u8").tobytes(), 8 * x.shape[1]
        return [raw[i : i + n] for i in range(0, len(raw), n)]

    def done(held: list[tuple]) -> pd.DataFrame:
        *numbers, right, left = zip(*held)
        return pd.DataFrame(dict(zip(names, [np.concatenate(x) for x in numbers] + [[p for side in x for p in side] for x in (right, left)])))

    for batch in batches:
        held, n = [], 0
        for t, own, doc, last, at, shard in zip(*(batch[c] for c in ("text", "print", "doc", "last", "at", "shard"))):
            h = word_hashes(lower_words(t))
            if _print(h) != own:
                continue
            at, shard = np.asarray(at, np.int32), np.asarray(shard, np.int32)
            seeds = window_hashes(h, seed_length(length))[at].view(np.int64)
            for a in range(0, len(at), PIECE):
                part = slice(a, a + PIECE)
                right, left = surroundings(h, at[part].astype(np.int64), length)
                held.append((*(np.full(len(right), x, np.int64) for x in (own, doc, last)), at[part], shard[part], seeds[part], pieces(right), pieces(left)))
                n += len(right)
                if n >= PIECE:
                    yield done(held)
                    held, n = [], 0
        if held:
            yield done(held)


def _shared(rows: np.ndarray) -> np.ndarray:
    """Of each row but the first, how many leading columns it shares with the one before."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _groups(seed: np.ndarray, right: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of suffixes sorted by (seed, right), for each number d of words to the left: (d, suffixes, where groups begin among
    them). A group's suffixes share their window, which begins d words before them."""
    m, more = right.shape
    share_right = np.concatenate(([0], _shared(np.concatenate((seed.view(np.uint64)[:, None], right), axis=1))))
    backwards = np.concatenate((seed.view(np.uint64)[:, None], left), axis=1)
    by_left = np.argsort(np.ascontiguousarray(backwards.astype(">u8")).view(f"S{8 * (more + 1)}").ravel(), kind="stable")
    share_left = np.concatenate(([0], _shared(backwards[by_left])))
    group_left = np.empty(m, np.int64)
    for d in range(more + 1):
        e = more - d
        able = np.ones(m, bool)
        if d:
            able &= left[:, d - 1] != 0
        if e:
            able &= right[:, e - 1] != 0
        group_left[by_left] = np.cumsum(share_left < d + 1)
        rows = np.flatnonzero(able)
        if len(rows):
            key = (np.cumsum(share_right < e + 1) * (m + 1) + group_left)[rows]
            by = np.argsort(key, kind="stable")
            key, rows = key[by], rows[by]
            yield d, rows, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def _ranges(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(suffix, least d, greatest d, least document) of the ranges of hit windows with the same least document."""
    same = hit[:, 1:] & hit[:, :-1] & (first[:, 1:] == first[:, :-1])
    no = np.zeros((len(hit), 1), bool)
    begins, ends = hit & ~np.concatenate((no, same), axis=1), hit & ~np.concatenate((same, no), axis=1)
    suffix, low = np.nonzero(begins)
    return suffix, low, np.nonzero(ends)[1], first[suffix, low]


def matches(seed: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges of windows that several documents hold, of suffixes sorted by (seed, right)."""
    first, hit = np.zeros((len(right), right.shape[1] + 1), np.int64), np.zeros((len(right), right.shape[1] + 1), bool)
    for d, rows, begin in _groups(seed, right, left):
        if len(begin) < len(rows):
            least, size = np.minimum.reduceat(doc[rows], begin), np.diff(begin, append=len(rows))
            first[rows, d], hit[rows, d] = np.repeat(least, size), np.repeat(least < np.maximum.reduceat(last[rows], begin), size)
    return _ranges(hit, first)


def window_keys(seed: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each suffix and d a hash of the window that begins d words before it."""
    m, more = right.shape
    sides = []
    for words in (right, left):
        h = np.zeros((m, more + 1), np.uint64)
        for k in range(more):
            h[:, k + 1] = mixed(h[:, k] * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(1))
        sides.append(h)
    d = np.arange(more + 1)
    return mixed(mixed(sides[0][:, more - d] + seed.view(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15) + sides[1] + d.astype(np.uint64)).view(np.int64)


def _words(column: pd.Series, more: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u8").astype(np.uint64).reshape(len(column), more)


def _neighbours(fragments: DataFrame, length: int) -> DataFrame:
    """fragments (seed, right, left, print, doc, last, at), sorted and compared -> RANGES of window starts."""
    more = length - seed_length(length)

    def compared(held: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        found = matches(f["seed"].to_numpy(np.int64), _words(f["right"], more), _words(f["left"], more), f["doc"].to_numpy(np.int64), f["last"].to_numpy(np.int64))
        return _as_ranges(f, *found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            seeds = batch["seed"].to_numpy()
            new = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
            if held and seeds[0] != held[-1]["seed"].iloc[-1]:
                new = np.concatenate(([0], new))
            if n + len(batch) > ROWS and len(new):  # whole groups of equal seeds go; the last one waits for its rest
                held.append(batch.iloc[: new[-1]])
                yield compared(held)
                held, n, batch = [], 0, batch.iloc[new[-1] :]
            held.append(batch)
            n += len(batch)
        if n:
            yield compared(held)

    return fragments.select("seed", "right", "left", "print", "doc", "last", "at").repartition("seed").sortWithinPartitions("seed", "right", "left").mapInPandas(run, RANGES)


def _as_ranges(f: pd.DataFrame, suffix: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    at = f["at"].to_numpy(np.int64)[suffix]
    return pd.DataFrame({"print": f["print"].to_numpy()[suffix], "doc": f["doc"].to_numpy()[suffix], "a": (at - high).astype(np.int32), "b": (at - low).astype(np.int32), "first": first})


def _hot_neighbours(fragments: DataFrame, length: int) -> DataFrame:
    """The same for groups of several shards; fragments also have `shard`."""
    more = length - seed_length(length)
    fragments = share(fragments.select("seed", "shard", "right", "left", "print", "doc", "last", "at"), "suffix-hot")

    def represent(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["right", "left"], kind="stable", ignore_index=True)
        seed, right, left = f["seed"].to_numpy(np.int64), _words(f["right"], more), _words(f["left"], more)
        keys, doc, last, out = window_keys(seed, right, left), f["doc"].to_numpy(np.int64), f["last"].to_numpy(np.int64), []
        for d, rows, begin in _groups(seed, right, left):
            out.append((keys[rows[begin], d], np.minimum.reduceat(doc[rows], begin), np.maximum.reduceat(last[rows], begin)))
        window, least, most = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pd.DataFrame({"seed": key[0], "shard": key[1], "window": window, "least": least, "most": most})

    def back(key, f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(known):
            return pd.DataFrame(columns=[c.split()[0] for c in RANGES.split(", ")])
        known = known.sort_values("window")
        keys, windows = window_keys(f["seed"].to_numpy(np.int64), _words(f["right"], more), _words(f["left"], more)), known["window"].to_numpy(np.int64)
        place = np.minimum(np.searchsorted(windows, keys), len(windows) - 1)
        return _as_ranges(f, *_ranges(windows[place] == keys, known["first"].to_numpy(np.int64)[place]))

    reps = share(fragments.groupBy("seed", "shard").applyInPandas(represent, "seed long, shard int, window long, least long, most long"), "suffix-windows")
    same = share(reps.groupBy("window").agg(F.min("least").alias("first"), F.max("most").alias("most")).where("first < most").select("window", "first"), "suffix-same")
    known = reps.join(same, "window").select("seed", "shard", "window", "first")
    return fragments.groupBy("seed", "shard").cogroup(known.groupBy("seed", "shard")).applyInPandas(back, RANGES)


def _merged(a: Column, b: Column, firsts: Column, doc: Column, length: int) -> Column:
    """Merged spans of ranges of windows, their words, and the words of windows that an earlier document holds."""

    def spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(a, kind="stable")
        a, reach = a[by], np.maximum.accumulate(b[by] + length)
        new = np.concatenate(([True], a[1:] > reach[:-1]))
        return a[new], reach[np.concatenate((new[1:], [True]))]

    @F.pandas_udf("starts array<int>, ends array<int>, n_repeat_words long, n_later_words long")
    def merged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, y, f, own in zip(*batch):
                x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
                s, e = spans(x, y)
                later = np.asarray(f) < own
                c, g = spans(x[later], y[later]) if later.any() else (np.zeros(1), np.zeros(1))
                rows.append((s.astype(np.int32), e.astype(np.int32), int((e - s).sum()), int((g - c).sum())))
            yield pd.DataFrame(rows, columns=["starts", "ends", "n_repeat_words", "n_later_words"])

    return merged(a, b, firsts, doc)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_repeat_words (in passages that another document holds too), n_later_words (in passages
    that a document with a lesser doc_id holds), first_doc_id (the least document that shares a passage, itself
    included; null if nothing repeats), spans (of the repeated passages, start:end in words, comma-joined).
    doc_id must be an integer."""
    hot = HOT if hot is None else hot
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = share(docs.select("doc_id", _suffixes(F.col("text"), length, gram).alias("s")).select("doc_id", "s.*"), "suffix-rows")
    long_ = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    classes = long_.groupBy("print", "n_words").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.any_value("at").alias("at"), F.any_value("seed").alias("seed"))
    classes = share(classes, "suffix-classes")
    suffixes = classes.select("print", "doc", "last", F.explode(F.arrays_zip("at", "seed")).alias("s")).select("print", "doc", "last", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    # suffixes that share their first words with another class; written first, so that Spark can split the join at hot ones
    equal = suffixes.groupBy("seed").agg(F.min("doc").alias("x"), F.max("last").alias("y"), F.min("print").alias("p"), F.max("print").alias("q"), F.count("*").alias("n")).where("x < y and p < q")
    equal = share(equal.select("seed", F.ceil(F.col("n") / hot).cast("int").alias("shards")), "suffix-equal")
    shard = F.when(F.col("shards") > 1, F.pmod(F.xxhash64("print", "at"), F.col("shards")).cast("int")).otherwise(0)
    place = lambda is_hot: F.collect_list(F.when((F.col("shards") > 1) == is_hot, F.struct("at", shard.alias("shard"))))
    seeds = share(suffixes.join(equal, "seed").groupBy("print", "doc", "last").agg(place(False).alias("cold"), place(True).alias("hot")), "suffix-seeds")
    # the texts of those documents alone
    texts = semi_joined(docs, seeds.select(F.col("doc").alias("doc_id")), "doc_id").join(seeds.withColumnRenamed("doc", "doc_id"), "doc_id").withColumnRenamed("doc_id", "doc")

    def fragments(of: str) -> DataFrame:
        own = texts.where(F.size(of) > 0).select("print", "doc", "last", "text", F.col(of)["at"].alias("at"), F.col(of)["shard"].alias("shard"))
        return own.mapInPandas(lambda batches: _fragments(batches, length), FRAGMENTS)

    ranges = _neighbours(fragments("cold"), length)
    if not equal.where("shards > 1").isEmpty():
        ranges = ranges.unionByName(_hot_neighbours(fragments("hot"), length))
    hits = ranges.groupBy("print", "doc").agg(*(F.collect_list(c).alias(c) for c in ("a", "b")), F.collect_list("first").alias("firsts"), F.min("first").alias("first"))
    passages = hits.select("print", "first", _merged(F.col("a"), F.col("b"), F.col("firsts"), F.col("doc"), length).alias("m")).select("print", "first", "m.*")
    # whole texts that several documents hold
    whole = F.col("last") > F.col("doc")
    text_spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), ",")
    per = classes.select("print", "doc", "last").join(passages.select("print", "first", "n_repeat_words", "n_later_words", text_spans.alias("spans")), "print", "left").where(whole | F.col("first").isNotNull())
    per = share(per, "suffix-classes-found")  # so that Spark can split the join at a hot class
    keyed = rows.select("doc_id", "n_words", F.when((F.col("n_words") >= length) & F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    later = F.coalesce("n_later_words", F.lit(0))
    return keyed.join(per, "print", "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_repeat_words", F.lit(0))).cast("long").alias("n_repeat_words"),
        F.when(whole & (F.col("doc_id") > F.col("doc")), F.col("n_words")).otherwise(later).cast("long").alias("n_later_words"),
        F.when(whole, F.least(F.col("doc"), F.col("first"))).otherwise(F.col("first")).alias("first_doc_id"),
        F.when(whole, F.concat_ws(":", F.lit("0"), F.col("n_words").cast("string"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
    )
