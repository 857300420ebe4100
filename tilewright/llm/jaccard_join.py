r"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of PERCENT or more.

A-Z is lower-cased, words are `[^\x20\x09-\x0D]+`; a set holds the hashes (64 bits) of the distinct 3-word
shingles; with fewer words, the whole sequence is one; without words it is empty and linked with nothing.

1. One pass over the texts: per row the set's size, its fingerprint and its `low` shingles (hashes in the
   lowest LOW * (1 - t) of the hash space), or, where these are fewer than a prefix takes, all of them.
2. Equal fingerprints are one class; its least doc_id stands for it from here on.
3. Shingles are globally ordered: low ones first, then the rest, both by (document frequency, hash), so that what many
   texts say comes last. Two sets with the wanted similarity share a shingle within the first n - ceil(t * n) + 1 of
   each. Shingles move packed, by hash, and are counted there; only those of several documents become rows.
   A frequency is one number for all (of other than low shingles it counts the documents that sent them). A document whose prefix consists of shingles of its own alone drops out here.
4. For each shared prefix shingle the documents that have it are a bucket, by classes of their sets' sizes (each
   is with its own class and the one below); equal buckets count once. Documents
   that buckets connect are a cluster; most hold a few documents. A cluster of at most BLOCK shingles and CROWD
   documents is a block, so each set is sent once. In larger clusters, which lines that many texts say connect, each
   bucket falls into parts by parity sketches of the whole sets (a bit for each of their shingles, added modulo 2:
   sketches differ in no more bits than sets in shingles, so none of the wanted similarity are parted). The parts
   connect clusters anew; of those still larger than BLOCK either each part or the cluster, whichever sends less, is cut
   into blocks by a hash.
5. In a block sets whose prefix is theirs alone drop out again, now by all their shingles. A prefix tree stores
   the others (most frequent shingle first, so that near copies share paths);
   each set traverses it, carrying the overlap so far, and leaves a subtree when the shingles left on either
   side can't reach the overlap needed, when its sizes don't fit, or when all of it is linked with the set
   already. What comes out is a spanning forest of the links: components keep every link between different
   texts, though not every pair.
6. Components. Buckets of several blocks whose documents are still in different components get a second round:
   every block of the largest component against every block of the others, and the others among themselves.

Nulls: a null text is empty; rows with null doc_id get a null component. Long texts: whole. Equal rows are in one
class; rows that share a doc_id but not a text are linked by their own texts. Ties (equal frequencies): by hash. Empty
table: empty result. Extra columns: not read by jaccard_components, kept by one_of_each, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, few, lower_words, mixed, semi_joined, share, unused, window_hashes, word_hashes
from .components import components

WORDS = 3
PERCENT = 90
LOW = 1.6  # times 1 - t: low shingles are more than a prefix takes, so that it can leave out frequent ones
BLOCK = 2_000_000  # shingles in a block
CROWD = 2_000  # documents in a cluster that is joined without sketches
SKETCH = 1 << 14  # bits of a sketch at most; beyond as many shingles it tells less
PARTED = 200  # blocks of a bucket that sketches part, which are 2 bits a shingle at most; larger buckets stay whole
PACK = 1 << 20  # shingles that a task packs at a time, 16 bytes each
PART = 1 << 17  # shingles that are counted at a time, about; more where one shingle has more documents
SETS = "n_shingles long, print long, low array<long>, n_low int"


def shingles(text, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    found = lower_words(text)
    if len(found) >= words:
        s = np.sort(window_hashes(word_hashes(found), words))  # np.unique takes a hash table, five times as slow
        return s[np.concatenate(([True], s[1:] != s[:-1]))]
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64) if found else np.empty(0, np.uint64)


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def needed(n: int, m, percent: int = PERCENT):
    """Least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def low_limit(percent: int = PERCENT) -> int:
    """Shingles below this hash are low."""
    return int(min(0.49, LOW * (100 - percent) / 100) * 2**64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(text: Column, words: int, percent: int) -> Column:
    """Size, fingerprint, the shingles that may be in the prefix (the low ones or all), and how many are low."""
    limit = np.uint64(low_limit(percent))
    names = [x.split()[0] for x in SETS.split(", ")]

    @F.pandas_udf(SETS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t, words)
                n_low = int(np.searchsorted(s, limit))
                rows.append((len(s), fingerprint(s), _signed(s[:n_low] if len(s) and n_low >= prefix_length(len(s), percent) else s), n_low))
            yield pd.DataFrame(rows, columns=names)

    return found(text)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _full_sets(text: Column, words: int) -> Column:
    @F.pandas_udf("print long, set array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, words) for t in texts]
            yield pd.DataFrame({"print": [fingerprint(s) for s in sets], "set": [_signed(s) for s in sets]})

    return found(text)


def _packed(batches: Iterator[pa.RecordBatch], bits: int, pack: int) -> Iterator[pa.RecordBatch]:
    """(node, low) -> (part, pairs): all pairs of a shingle and a node whose shingle's hash begins with these bits, in
    native bytes, up to `pack` pairs at a time."""

    def out(token: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        part = (mixed(token.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, pairs = part[order], np.stack((token[order], node[order]), 1)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = (16 * np.append(first, len(part))).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), found], names=["part", "pairs"])

    held, n = [], 0
    for batch in batches:
        low = batch.column("low")
        held.append((low.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column("node").to_numpy(), low.value_lengths().to_numpy())))
        n += len(held[-1][0])
        if n >= pack:
            token, node = (np.concatenate(x) for x in zip(*held))
            for a in range(0, n - n % pack, pack):
                yield out(token[a : a + pack], node[a : a + pack])
            held, n = [(token[n - n % pack :], node[n - n % pack :])], n % pack
    if n:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, pairs) by part -> (token, df, node) of the shingles that several nodes have."""

    def out() -> pa.RecordBatch:
        token, node = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2).T
        order = np.argsort(token)
        token, node = token[order], node[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        n = np.diff(np.append(first, len(token)))
        df = np.repeat(n, n)
        several = df > 1
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (token, df, node)], names=["token", "df", "node"])

    key, held = None, []
    for batch in batches:
        for part, pairs in zip(batch.column("part").to_pylist(), batch.column("pairs")):
            if part != key:
                if held:
                    yield out()
                key, held = part, []
            held.append(pairs.as_py())
    if held:
        yield out()


def _shared(sets: DataFrame, n: int, pack: int = PACK, per: int = PART) -> DataFrame:
    """sets (node, low), of n shingles or so in all -> (token, df, node) of the shingles that df > 1 nodes have. Most shingles are of one
    document alone: they move once, packed, and never become rows."""
    bits = min(16, max(9, math.ceil(math.log2(max(1, n / per)))))
    packed = sets.select("node", "low").mapInArrow(lambda batches: _packed(batches, bits, pack), "part int, pairs binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_counted, "token long, df long, node long")


class _Node:
    __slots__ = ("children", "ends", "least", "most", "one", "run")

    def __init__(self, run, children, ends, least, most, one):
        self.run, self.children, self.ends, self.least, self.most, self.one = run, children, ends, least, most, one


class PrefixTree:
    """Sets of ranks in ascending order; what they share at the front is stored once, as runs of ranks.

    A node knows the least and the largest set below it, and the component of all sets below it if it is one (else MIXED).
    """

    MIXED = object()

    def __init__(self, percent: int):
        self.percent, self.parent = percent, {}
        self.root = _Node(np.empty(0, np.int64), {}, [], 1 << 60, 0, None)

    def find(self, x):
        up = self.parent.setdefault
        while up(x, x) != x:
            self.parent[x] = x = up(self.parent[x], self.parent[x])
        return x

    def link(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def insert(self, ranks: np.ndarray, name) -> None:
        node, at, n = self.root, 0, len(ranks)
        while True:
            before = node.least, node.most, node.one
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one is None:
                node.one = name
            elif node.one is not self.MIXED and self.find(node.one) != self.find(name):
                node.one = self.MIXED
            run = node.run
            k = min(len(run), n - at)
            differ = np.flatnonzero(run[:k] != ranks[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):
                node.run, node.children, node.ends = run[:same], {int(run[same]): _Node(run[same:], node.children, node.ends, *before)}, []
            at += same
            if at == n:
                node.ends.append(name)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                node.children[int(ranks[at])] = _Node(ranks[at:], {}, [name], n, n, name)
                return
            node = child

    def search(self, ranks: np.ndarray, name, own: np.ndarray) -> list:
        """Links name with every set in reach of another component; the partners by which it did so. own: which ranks it has."""
        n, p, out, find = len(ranks), self.percent, [], self.find
        least, most, mixed, me = -(-p * n // 100), 100 * n // p, self.MIXED, self.find(name)
        stack = [(self.root, n, 0, 0)]
        while stack:
            node, left, overlap, depth = stack.pop()
            low, high = max(least, node.least), min(most, node.most)
            if low > high or node.one is not mixed and node.one is not None and find(node.one) == me:
                continue
            run = node.run
            if len(run):
                overlap += int(np.count_nonzero(own[run]))
                left = n - int(ranks.searchsorted(run[-1], "right"))
                depth += len(run)
            if overlap + min(left, high - depth) < -(-p * (n + low) // (100 + p)):
                continue
            if node.ends and overlap >= needed(n, depth, p):
                for other in node.ends:
                    if find(other) != me:
                        self.link(other, name)
                        me = find(name)
                        out.append(other)
            for c in node.children.values():
                stack.append((c, left, overlap, depth))
        return out


def block_links(names: list[int], components_: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets of a block that, with the components known, keep all of its links' components."""
    tree, sizes = PrefixTree(percent), np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner, alive = np.repeat(np.arange(len(sets)), sizes), np.ones(len(sets), bool)
    while True:  # a set with a whole prefix of shingles of its own alone links with none
        held = alive[owner]
        counts = np.bincount(inverse[held], minlength=len(values))
        single = np.bincount(owner[held][counts[inverse[held]] == 1], minlength=len(sets))
        gone = alive & (single >= prefix_length(sizes, percent))
        if not gone.any():
            break
        alive &= ~gone
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranks, first, out = rank[inverse], np.concatenate(([0], np.cumsum(sizes))), []
    for name, component in zip(names, components_):
        tree.link(name, component)
    own = np.zeros(len(values), bool)
    for k in np.argsort(sizes, kind="stable").tolist():
        if alive[k]:
            s = np.sort(ranks[first[k] : first[k + 1]])
            own[s] = True
            out += [(names[k], other) for other in tree.search(s, names[k], own)]
            own[s] = False
            tree.insert(s, names[k])
    return out


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """rows (bucket, block, node, component, set) -> links (a, b). Python sees a block at a time."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, ([], [], [])
        done = lambda: pd.DataFrame(block_links(*held, percent) if len(held[0]) > 1 else [], columns=["a", "b"]).astype("int64")
        for batch in batches:
            for bucket, block, node, component, s in zip(*(batch[c] for c in ("bucket", "block", "node", "component", "set"))):
                if (bucket, block) != key:
                    if held[0]:
                        yield done()
                    key, held = (bucket, block), ([], [], [])
                held[0].append(node), held[1].append(component), held[2].append(np.asarray(s))
        if held[0]:
            yield done()

    rows = rows.select("bucket", "block", "node", "component", "set").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return rows.mapInPandas(joined, "a long, b long")


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the numbers of shingles at each of `bits` (a power of two, 64 at least) places, as 64-bit words."""
    at = np.bincount((mixed(s.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8)).view(np.uint64)


def sketched_parts(sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """For each of some sets the first of those that it is connected with by pairs whose sketches allow the wanted similarity."""
    part, left = np.arange(len(sizes)), np.arange(len(sizes))
    while len(left):
        root, queue = left[0], [(sizes[0], sketches[0])]
        left, sizes, sketches = left[1:], sizes[1:], sketches[1:]
        while queue and len(left):
            size, own = queue.pop()
            both = sizes + size
            near = np.bitwise_count(sketches ^ own).sum(axis=1, dtype=np.int64) <= both - 2 * needed(0, both, percent)
            if near.any():
                part[left[near]] = root
                queue += zip(sizes[near], sketches[near])
                left, sizes, sketches = left[~near], sizes[~near], sketches[~near]
    return part


def _window(n_shingles: Column, seat: Column, percent: int) -> Column:
    return _size_class(n_shingles, percent) - F.pmod(seat, F.lit(2))


def _size_class(n_shingles: Column, percent: int) -> Column:
    return F.floor(F.log(n_shingles.cast("double")) / (1.0001 * math.log(100 / percent))).cast("long")


def _sketches(window: Column, set_: Column, percent: int) -> Column:
    """Sketches with about as many bits as the largest sets of their window have shingles."""

    @F.pandas_udf("binary")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for windows, sets in batches:
            most = np.exp((windows.to_numpy(np.float64) + 2) * (1.0001 * math.log(100 / percent)))
            bits = 1 << np.ceil(np.log2(np.clip(most, 64, SKETCH))).astype(np.int64)
            yield pd.Series([sketch(np.asarray(s), int(b)).tobytes() for s, b in zip(sets, bits)])

    return found(window, set_)


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """members (bucket, seat, node, n_shingles, sketch) -> (bucket, seat, node, n_shingles) of the parts of several sets
    into which buckets fall by their sketches."""

    def parts(held: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        bucket, sizes, sketches = f["bucket"].to_numpy(np.int64), f["n_shingles"].to_numpy(np.int64), f.pop("sketch").to_numpy()
        ends = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(f)]
        part = np.concatenate([a + sketched_parts(sizes[a:b], np.frombuffer(b"".join(sketches[a:b]), np.uint64).reshape(b - a, -1), percent) for a, b in zip(ends, ends[1:])])
        f["part"] = f["seat"].to_numpy(np.int64)[part]
        return f[np.bincount(part, minlength=len(f))[part] > 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            buckets = batch["bucket"].to_numpy()
            new = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
            if held and buckets[0] != held[-1]["bucket"].iloc[-1]:
                new = np.concatenate(([0], new))
            if len(new):  # whole buckets go; the last one waits for its rest
                if held or new[-1]:
                    yield parts([*held, batch.iloc[: new[-1]]])
                held, batch = [], batch.iloc[new[-1] :]
            held.append(batch)
        if held:
            yield parts(held)

    rows = members.select("bucket", "seat", "node", "n_shingles", "sketch").repartition("bucket").sortWithinPartitions("bucket", "seat")
    found = rows.mapInPandas(run, "bucket long, seat long, node long, n_shingles long, part long")
    return found.select(F.xxhash64("bucket", "part").alias("bucket"), "seat", "node", "n_shingles")


def _blocks(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / BLOCK)).cast("int")


def _block(of: Column) -> Column:
    return F.pmod(F.xxhash64("node", "bucket"), of).cast("int")


def classes_and_links(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, print) per row; (print, node, doc_id, n) per class of n equal sets; (node, component) of linked classes."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = docs.select("doc_id", _sets(F.col("text"), words, percent).alias("s")).select(F.monotonically_increasing_id().alias("node"), "doc_id", "s.*")
    rows = share(rows, "jaccard-rows")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("print", "n_shingles", "n_low").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n")).select("print", "n_shingles", "n_low", "first.doc_id", "first.node", "n")
    classes = share(classes, "jaccard-classes")
    several = classes.where("n > 1").select("print", F.col("node").alias("first"))
    copies = share(filled.select("print", "node").join(several, "print").where("node <> first").select("node"), "jaccard-copies")
    sets = semi_joined(filled, copies, "node", "left_anti")
    tokens = _shared(sets, classes.agg(F.sum("n_low")).first()[0] or 0)
    # the shared shingles of each prefix, rarest first
    is_high = (F.col("token") < 0) | (F.col("token") >= low_limit(percent))
    entry = F.struct(is_high.alias("high"), F.col("df").alias("df"), F.col("token").alias("token"))
    shared = tokens.groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("all")).join(filled.select("node", "n_shingles", "n_low"), "node")
    low, high = F.filter("all", lambda x: ~x["high"]), F.filter("all", lambda x: x["high"])
    # a set's own shingles stand before its shared ones among the low ones, and again among the others
    prefix = F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1")
    room = F.greatest(F.lit(0), prefix - (F.col("n_low") - F.size(low))).cast("int")
    more = F.greatest(F.lit(0), prefix - (F.col("n_shingles") - F.size(high))).cast("int")
    first = F.concat(F.slice(low, F.lit(1), room), F.slice(high, F.lit(1), more))
    postings = share(shared.select("node", "n_shingles", F.explode(first["token"]).alias("bucket")), "jaccard-postings")
    dropped(copies)
    # sets of the wanted similarity have sizes in the same class or in neighbouring ones: a window holds the sets of
    # its own class and those of the next, and counts if it has one of its own
    windows = postings.withColumn("class", _size_class(F.col("n_shingles"), percent)).withColumn("window", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    windows = windows.select("node", "n_shingles", F.xxhash64("bucket", "window").alias("bucket"), (2 * F.col("node") + (F.col("window") != F.col("class")).cast("int")).alias("seat"))
    members = share(_distinct_buckets(windows), "jaccard-members")
    dropped(postings)
    # documents connected by buckets are a cluster; one of bounded size is joined at once, each set sent once
    sized = _clusters(members, "jaccard-large", (F.col("w") > BLOCK) | (F.col("m") > CROWD))
    seats = sized.groupBy("node").agg(F.collect_set(F.struct("cluster", "large")).alias("seats"))  # two at most
    # the whole sets of these documents alone
    wanted = share(classes.select("node", "doc_id", "print").join(seats, "node"), "jaccard-wanted")
    texts = semi_joined(docs, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id")
    sets = texts.select("node", "seats", "print", _full_sets(F.col("text"), words).alias("s")).where("print = s.print").select("node", "seats", "s.set")
    of_clusters = sets.withColumn("seat", F.explode(F.filter("seats", lambda x: ~x["large"]))).select(F.col("seat.cluster").alias("bucket"), F.lit(0).cast("long").alias("block"), "node", F.col("node").alias("component"), "set")
    links = share(_links(of_clusters, percent), "jaccard-links")
    in_large = members.join(sized.where("large").select("seat"), "seat", "left_semi")
    if in_large.isEmpty():
        return rows.select("doc_id", "n_shingles", "print"), classes.select("print", "node", "doc_id", "n"), share(components(links), "jaccard-components")
    sets = share(sets.where(F.exists("seats", lambda x: x["large"])).select("node", "set"), "jaccard-sets")
    sketches = sized.where("large").join(sets, "node")
    sketches = share(sketches.select("seat", _sketches(_window(F.col("n_shingles"), F.col("seat"), percent), F.col("set"), percent).alias("sketch")).dropDuplicates(["seat"]), "jaccard-sketches")
    parts = _parted(in_large.where(F.col("blocks") <= PARTED).join(sketches, "seat"), percent)
    parts = share(parts.unionByName(in_large.where(F.col("blocks") > PARTED).select("bucket", "seat", "node", "n_shingles")), "jaccard-parts")
    members = share(_distinct_buckets(parts), "jaccard-members")
    sized = _clusters(members, "jaccard-large", F.col("w") > BLOCK)
    # of a cluster that is still large either its buckets are joined or the whole of it, whichever sends less
    sent = members.join(sized.where("large").select("seat", "cluster"), "seat")
    by_bucket = sent.groupBy("cluster").agg(F.sum(F.col("n_shingles") * F.col("blocks")).alias("each"))
    whole = sent.select("cluster", "seat", "n_shingles").distinct().groupBy("cluster").agg(F.sum("n_shingles").alias("w")).select("cluster", _blocks(F.col("w")).alias("n_blocks"), "w")
    whole = share(whole.join(by_bucket, "cluster").where("w * n_blocks <= each").select("cluster", "n_blocks"), "jaccard-whole")
    at_once = sized.where("not large").select(F.col("cluster").alias("bucket"), "node", F.lit(1).alias("blocks"), "n_shingles")
    clusters = sized.where("large").join(whole, "cluster").select(F.col("cluster").alias("bucket"), "node", F.col("n_blocks").alias("blocks"), "n_shingles")
    others = sent.join(whole, "cluster", "left_anti").select("bucket", "node", "blocks", "n_shingles")
    joined = share(at_once.unionByName(clusters).unionByName(others), "jaccard-joined")
    first = joined.withColumns({"block": _block(F.col("blocks")), "component": F.col("node")}).join(sets, "node")
    links = links.unionByName(share(_links(first, percent), "jaccard-links"))
    found = share(components(links), "jaccard-components")
    several = joined.where("blocks > 1").select("bucket", "node", "n_shingles")
    if not several.isEmpty():
        links = links.unionByName(share(_links(_second(several, found, sets), percent), "jaccard-links"))
        found = share(components(links), "jaccard-components")
    return rows.select("doc_id", "n_shingles", "print"), classes.select("print", "node", "doc_id", "n"), found


def _distinct_buckets(seats: DataFrame) -> DataFrame:
    """(bucket, seat, node, n_shingles) -> the same of buckets with several documents and one of their own class, with their least
    seat and number of blocks; of buckets with the same documents one."""
    of = seats.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.pmod("seat", F.lit(2))).alias("own"), F.sum("n_shingles").alias("weight"), F.min("seat").alias("least"), F.bit_xor(F.xxhash64("seat")).alias("x"), F.bit_xor(F.xxhash64("seat", F.lit(1))).alias("y")).where("m > 1 and own = 0")
    of = of.groupBy("m", "weight", "least", "x", "y").agg(F.min("bucket").alias("bucket"))
    return seats.join(of.select("bucket", "least", _blocks(F.col("weight")).alias("blocks")), "bucket")


def _clusters(members: DataFrame, tag: str, is_large: Column) -> DataFrame:
    """(node, seat, n_shingles, cluster, large) of the seats that buckets connect; is_large: of a cluster's w shingles and m documents."""
    cluster = components(members.select(F.col("seat").alias("a"), F.col("least").alias("b")))
    sized = members.select("seat", "node", "n_shingles").distinct().join(cluster.withColumnsRenamed({"node": "seat", "component": "cluster"}), "seat")
    # written first, as before; of a cluster that is large there is one row
    large = share(sized.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("m")).where(is_large).select("cluster"), tag)
    marked = large.withColumn("large", F.lit(True))
    return share(sized.join(F.broadcast(marked) if few(large) else marked, "cluster", "left").select("node", "seat", "n_shingles", "cluster", F.coalesce("large", F.lit(False)).alias("large")), "jaccard-clusters")


def _second(large: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks for the buckets of several blocks that still hold several components."""
    rows = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = rows.groupBy("bucket", "component").agg(F.sum("n_shingles").alias("w"))
    per = per.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("component", F.struct("w", "component")).alias("main"), F.max(F.struct("w", "component"))["w"].alias("w_main"), F.sum("w").alias("w_all")).where("k > 1")
    per = per.select("bucket", "main", _blocks(F.col("w_main")).alias("n_main"), _blocks(F.col("w_all") - F.col("w_main")).alias("n_rest"))
    rows = rows.join(per, "bucket")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    main = rows.where("component = main").withColumn("own", _block(F.col("n_main"))).withColumn("other", F.explode(upto("n_rest"))).withColumn("block", F.col("own") * F.col("n_rest") + F.col("other"))
    rest = rows.where("component <> main").withColumn("own", _block(F.col("n_rest")))
    across = rest.withColumn("other", F.explode(upto("n_main"))).withColumn("block", F.col("other") * F.col("n_rest") + F.col("own"))
    # with one block of the rest, its own pairs are in the above
    among = rest.where("n_rest > 1").withColumn("other", F.explode(upto("n_rest"))).withColumn("block", -1 - F.least("own", "other") * F.col("n_rest") - F.greatest("own", "other"))
    cols = ["bucket", "block", "node", "component"]
    return main.select(cols).unionByName(across.select(cols)).unionByName(among.select(cols)).join(sets, "node")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows, classes, found = classes_and_links(docs, doc_id, text, words, percent)
    linked = classes.select("print", "node", "doc_id").join(found, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = linked.select("print", "component").join(least, "component").select("print", "component_id")
    # of classes that stand alone a row's own doc_id will do; written first, so that Spark can split the join at a hot class
    label = classes.join(linked, "print", "left").where("n > 1 or component_id is not null").select("print", F.coalesce("component_id", "doc_id").alias("component_id"))
    label = share(label, "jaccard-labels")
    rows = rows.withColumn("print", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("print")))
    return rows.join(label, "print", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, that with the least doc_id; of rows that share it and a set, one. Columns as they were."""
    found = jaccard_components(docs, doc_id, text, words, percent)
    key, own = (unused(c, docs) for c in ("key", "print"))
    gone = share(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "jaccard-gone")
    kept = semi_joined(docs.withColumn(key, F.col(doc_id)), gone, key, "left_anti")
    twice = share(found.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)), "jaccard-twice")
    if not twice.isEmpty():
        again = semi_joined(kept, twice, key).withColumn(own, _full_sets(F.col(text), words)["print"]).dropDuplicates([key, own])
        kept = semi_joined(kept, twice, key, "left_anti").unionByName(again.drop(own))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
