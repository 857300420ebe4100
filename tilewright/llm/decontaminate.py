r"""Benchmark decontamination by suffix arrays.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A window is `WINDOW` consecutive item
words (an item with fewer words, but not none, is one window). Every Arrow batch of documents is a shard: its
words become ids of the benchmark's vocabulary, the suffixes of all runs that can hold a window are sorted
(prefix doubling, so ties go on to the longest item), and every benchmark suffix is binary-searched in it.
A word outside the vocabulary ends a suffix: no match goes past it, so comparisons are exact, without hashes.

Null or empty text: no words, nothing hit. Long texts: whole; one that is longer than a shard is a shard. Repeated rows:
each row has its own result. Repeated items: an item_id counts once. Empty benchmark: no hits. Null item text: no
window. Null item_id: searched, listed as 'null'. Ties: of equally long longest matches the first in the document,
then the least item_id as a string. Extra columns are kept, whatever their names. Empty table: empty result.

The benchmark goes to the executors in blocks of at most BLOCK_CHARS characters (an item longer than that is a block
of its own), so what is broadcast is bounded however large the benchmark grows. With several blocks the documents are
written once, with row numbers; each block reads them and adds the states of the rows that it hits, which are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import dropped, encode, share, unused

WINDOW = 10
BLOCK_CHARS = 8_000_000
SHARD_WORDS = 1_000_000
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),  # merged spans of hit words, end exclusive
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),  # words of the longest verbatim match
        T.StructField("longest_at", T.LongType()),  # its first word in the document, -1 if none
        T.StructField("longest_item", T.StringType()),
    ]
)


def item_words(text) -> list[bytes]:
    return encode(text).translate(_WORD_BYTES).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ids != 0, ordered by the up to `depth` ids from there to the next 0. ids ends with 0."""
    at = np.flatnonzero(ids)
    rank, k = ids.astype(np.int64), 1
    order = at[np.argsort(rank[at], kind="stable")]
    while k < depth and len(order):
        ahead = np.minimum(order + k, len(ids) - 1)
        # a suffix that ended within the first k ids has no rank further on
        key = (rank[order] << 32) | np.where(_left(ids)[order] > k, rank[ahead], 0)
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        new = np.zeros(len(ids), np.int64)
        new[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        done = new[order[-1]] == len(order)
        rank, k = new, 2 * k
        if done:
            break
    return order


def _left(ids: np.ndarray) -> np.ndarray:
    """For each position, how many ids there are from it to the next 0."""
    zero = np.flatnonzero(ids == 0)
    return zero[np.searchsorted(zero, np.arange(len(ids)))] - np.arange(len(ids))


class Benchmark:
    """A block of items as queries: the suffixes of all items, each with its window's length."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.names, rows, self.vocabulary = [], [], {}
        for name, text in items:
            if words := item_words(text):
                self.names.append("null" if name is None else str(name))
                rows.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.longest = max(map(len, rows), default=0)
        self.shortest = min((min(window, len(r)) for r in rows), default=window)
        self.text = np.array([x for r in rows for x in [*r, 0]] + [0] * (window + 1), np.int32)
        item, start, size, at, first = [], [], [], 0, 0
        for i, r in enumerate(rows):
            m = min(window, len(r))
            for p in range(len(r) - m + 1):
                item.append(i), start.append(at + p), size.append(m)
            at += len(r) + 1
        self.item, self.start, self.size = np.array(item, np.int64), np.array(start, np.int64), np.array(size, np.int64)

    def search(self, ids: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the range of sa whose suffixes begin with its window."""
        out = []
        for after in (False, True):
            lo, hi = np.zeros(len(self.item), np.int64), np.full(len(self.item), len(sa), np.int64)
            while (open_ := lo < hi).any():
                q = np.flatnonzero(open_)
                mid = (lo[q] + hi[q]) // 2
                less = self._compare(ids, sa[mid], q)
                up = less <= 0 if after else less < 0
                lo[q[up]] = mid[up] + 1
                hi[q[~up]] = mid[~up]
            out.append(lo)
        return out[0], out[1]

    def _compare(self, ids: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sign of (suffix - window), on the window's length."""
        sign, open_ = np.zeros(len(q), np.int8), np.ones(len(q), bool)
        for j in range(int(self.size[q].max())):
            k = np.flatnonzero(open_ & (j < self.size[q]))
            if not len(k):
                break
            a, b = ids[at[k] + j], self.text[self.start[q[k]] + j]
            sign[k] = np.sign(a - b)
            open_[k] = (a == b) & (a != 0)
        return sign


def _further(state: dict) -> tuple:
    """Sorts the state with the longest match first; ties as in the module's docstring."""
    return -state["longest"], state["longest_at"], state["longest_item"] or ""


def scan(index: Benchmark, texts: list, window: int = WINDOW) -> list[dict]:
    """One shard: for each text, STATE as a dict."""
    parts, sizes = [], []
    for t in texts:
        words = item_words(t)
        parts += [np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
        sizes.append(len(words))
    base = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    out = [{"n_words": n, "starts": [], "ends": [], "items": [], "longest": 0, "longest_at": -1, "longest_item": None} for n in sizes]
    if not len(index.item) or not texts:
        return out
    ids = np.concatenate([*parts, np.zeros(1, np.int32)])
    # runs shorter than the shortest window can't hold one
    zero = np.flatnonzero(ids == 0)
    length = np.diff(np.concatenate(([-1], zero))) - 1
    ids[:] *= np.repeat(np.where(length >= index.shortest, 1, 0), length + 1).astype(np.int32)
    kept = ids
    # squeeze out the dropped runs: one 0 after each kept run
    use = (kept != 0) | (np.concatenate(([0], kept[:-1])) != 0)
    place = np.flatnonzero(use)
    small = np.concatenate((kept[place], np.zeros(window + 2, np.int32)))
    sa = suffix_array(small, index.longest)
    if not len(sa):
        return out
    lo, hi = index.search(small, sa)
    n = hi - lo
    q = np.repeat(np.arange(len(n)), n)
    at = sa[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    if not len(q):
        return out
    at, size, item = place[at], index.size[q], index.item[q]
    doc = np.searchsorted(base, at, side="right") - 1
    # hit words
    cover = np.zeros(len(kept) + 1, np.int64)
    np.add.at(cover, at, 1), np.add.at(cover, at + size, -1)
    hit = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    for d, a, b in zip((np.searchsorted(base, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist()):
        out[d]["starts"].append(a - int(base[d])), out[d]["ends"].append(b - int(base[d]))
    for d, i in np.unique(np.stack((doc, item)), axis=1).T.tolist():
        out[d]["items"].append(index.names[i])
    for o in out:
        o["items"] = sorted(set(o["items"]))
    # the longest verbatim match: consecutive windows on one diagonal of (item, document)
    diagonal = at - index.start[q]
    by = np.lexsort((at, diagonal, item))
    new = np.concatenate(([True], (np.diff(item[by]) != 0) | (np.diff(diagonal[by]) != 0) | (np.diff(at[by]) != 1)))
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate((first, [len(by)]))) - 1 + size[by[first]]
    for j, length_ in zip(by[first].tolist(), run.tolist()):
        o = out[int(doc[j])]
        new_ = {"longest": length_, "longest_at": int(at[j] - base[doc[j]]), "longest_item": index.names[int(item[j])]}
        if _further(new_) < _further(o):
            o.update(new_)
    return out


def _shards(texts: pd.Series) -> Iterator[list]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t) if isinstance(t, str) else 0
        if chars > 6 * SHARD_WORDS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _scanner(index: Benchmark, window: int):
    @F.pandas_udf(STATE)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([o for part in _shards(texts) for o in scan(index, part, window)], columns=STATE.names)

    return scanned


@F.pandas_udf(STATE)
def _merged(lists: pd.Series) -> pd.DataFrame:
    rows = []
    for states in lists:
        joined: list[list[int]] = []
        for a, b in sorted(x for s in states for x in zip(s["starts"], s["ends"])):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        far = min(states, key=_further)
        rows.append({c: far[c] for c in STATE.names} | {"starts": [a for a, _ in joined], "ends": [b for _, b in joined], "items": sorted({x for s in states for x in s["items"]})})
    return pd.DataFrame(rows, columns=STATE.names)


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list]:
    """Items with words, in blocks of about `most` characters."""
    block, chars = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        block.append((r.i, r.t))
        chars += len(r.t)
        if chars >= most:
            yield block
            block, chars = [], 0
    if block:
        yield block


def with_matches(docs: DataFrame, benchmark: DataFrame, out: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the column `out` of type STATE: words, hit spans, items found, longest match and its place."""
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    search = lambda block: _scanner(Benchmark(block, window), window)(F.col(text))
    if second is None:
        return docs.withColumn(out, search(first))
    row = unused("row", docs)
    docs = share(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-documents")
    states = share(docs.select(row, search(first).alias("s")), "decontaminate-states")  # of all rows: their words
    for block in chain([second], blocks):
        hits = share(docs.select(row, search(block).alias("s")).where(F.size("s.items") > 0), "decontaminate-hits")
        more = share(states.join(hits.withColumnRenamed("s", "t"), row, "left").select(row, F.when(F.col("t").isNull(), F.col("s")).otherwise(_merged(F.filter(F.array("s", "t"), lambda x: x.isNotNull()))).alias("s")), "decontaminate-states")
        dropped(states, hits)
        states = more
    return docs.join(states.withColumnRenamed("s", out), row).drop(row)


def n_hit(state: Column) -> Column:
    return F.aggregate(F.zip_with(state["ends"], state["starts"], lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def items_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match with its place."""
    s = F.col("match")
    items = F.array_sort(s["items"])
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(how.pop("text", "text")).alias("text"))
    return with_matches(own, benchmark, "match", **how).select(
        "doc_id",
        s["n_words"].alias("n_words"),
        n_hit(s).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit(s) > 0).alias("contaminated"),
        s["longest"].alias("longest_match"),
        s["longest_at"].alias("longest_match_at"),
        s["longest_item"].alias("longest_match_item"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns and other rows as they were."""
    match = unused("match", docs)
    found = with_matches(docs, benchmark, match, **how)
    return found.where(F.size(F.col(match)["starts"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
