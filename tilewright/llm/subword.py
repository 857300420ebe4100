"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Text is lower-cased; words are runs of ASCII letters, digits and all non-ASCII characters. A word's bag holds
its byte n-grams (a blank on either side marks its ends), hashed into `buckets` rows of an embedding table. A
word is the mean of its bag, a span the mean of its words, and a linear softmax over that mean gives the
classes. With `window` None a text is one span; else its score is that of its strongest span of `window`
words, so that a few words in a long text count, and the gradient goes through that span alone.

Training runs minibatches with Adagrad step sizes from a fixed seed: the same rows give the same model.
Scoring needs no dictionary of words: n-grams of a whole batch are hashed at once, and since everything up to
the softmax is linear, each bucket holds its logits.
"""

from __future__ import annotations

import numpy as np

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BYTE = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def word_bytes(text) -> bytes:
    """The words between single blanks, with a blank at either end; empty without words."""
    if not isinstance(text, str):
        return b""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())
    return b" " + raw + b" " if raw else b""


def grams(raw: bytes, sizes: range, bits: int):
    """For the texts in raw, one after another: where words begin, and for each n the buckets and which are n-grams of a word."""
    x = np.frombuffer(raw, np.uint8)
    blank = np.flatnonzero(x == 32)
    gap = np.diff(blank, append=len(x))
    ahead = np.repeat(blank + gap, gap) - np.arange(len(x))  # to the next blank after each byte
    value, out, h, power = _BYTE[x], [], None, 1
    for n in range(1, sizes.stop):
        part = value[n - 1 :] * np.uint64(power)
        h = part if h is None else h[: len(part)] + part
        power = power * 0x5851F42D4C957F2D % (1 << 64)
        if n in sizes:
            out.append(((h * _STEP) >> np.uint64(64 - bits), ahead[: len(h)] >= n - 1))
    return blank, out


def per_word(blank: np.ndarray, sizes: range) -> np.ndarray:
    """n-grams of each stretch from one blank to the next."""
    span = np.diff(blank) + 1
    return sum(np.maximum(span - n + 1, 0) for n in sizes)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class SubwordModel:
    """`window` needs two classes."""

    def __init__(self, classes: list, bits: int = 15, dim: int = 16, sizes: range = range(3, 7), window: int | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.bits, self.sizes, self.window = list(classes), bits, sizes, window
        self.table = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
        self.out = ((rng.random((dim, len(self.classes))) - 0.5) / dim).astype(np.float32)
        self.bias = np.zeros(len(self.classes), np.float32)

    # -- training ---------------------------------------------------------------------------------

    def _parse(self, text: str):
        """Buckets and weights of each word of a text: bucket ids by word, first entry of each word."""
        raw = word_bytes(text)
        if not raw:
            return None
        blank, by_n = grams(raw, self.sizes, self.bits)
        word = np.concatenate([np.searchsorted(blank, np.flatnonzero(ok), side="right") - 1 for _, ok in by_n])
        ids = np.concatenate([h[ok] for h, ok in by_n])
        by = np.argsort(word, kind="stable")
        ids, count = ids[by].astype(np.uint16 if self.bits <= 16 else np.uint32), np.bincount(word, minlength=len(blank) - 1)
        return ids, np.concatenate(([0], np.cumsum(count)))

    def _row(self, doc, a: int, b: int) -> np.ndarray:
        ids, first = doc
        n = np.diff(first[a : b + 1])
        return np.bincount(ids[first[a] : first[b]], np.repeat(1 / (np.maximum(n, 1) * max(1, b - a)), n), 1 << self.bits).astype(np.float32)

    def _span(self, doc, margin: np.ndarray | None, rng, length: int | None) -> tuple[int, int]:
        n = len(doc[1]) - 1
        if length is None or n <= length:
            return 0, n
        if margin is None:
            at = int(rng.integers(n - length + 1))
        else:
            s = np.add.reduceat(margin[doc[0]], doc[1][:-1]) / np.diff(doc[1])
            c = np.concatenate(([0], np.cumsum(s)))
            at = int(np.argmax(c[length:] - c[:-length]))
        return at, at + length

    def fit(self, texts: list[str], labels: list[int], epochs: int = 6, warm: int = 1, rate: float = 0.3, batch: int = 64, seed: int = 7, span: int | None = None):
        """labels: indices into classes. With windows the first `warm` epochs take whole texts; without, `span` words at random."""
        docs = [(d, y) for t, y in zip(texts, labels) if (d := self._parse(t))]
        rng, sums = np.random.default_rng(seed), [np.full_like(x, 1e-6) for x in (self.table, self.out, self.bias)]
        for epoch in range(epochs if docs else 0):
            margin = self.table @ (self.out[:, 1] - self.out[:, 0]) if self.window and epoch >= warm else None
            length = span if not self.window else None if epoch < warm else self.window
            order = rng.permutation(len(docs))
            for chunk in np.array_split(order, max(1, len(docs) // batch)):
                x = np.stack([self._row(docs[i][0], *self._span(docs[i][0], margin, rng, length)) for i in chunk])
                y = np.array([docs[i][1] for i in chunk])
                mean = x @ self.table
                p = softmax(mean @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                steps = (x.T @ (p @ self.out.T), mean.T @ p, p.sum(0))
                for value, total, d in zip((self.table, self.out, self.bias), sums, steps):
                    total += d * d
                    value -= rate * d / np.sqrt(total)
        return self

    # -- scoring ----------------------------------------------------------------------------------

    def logits(self, texts: list) -> np.ndarray:
        """A row for each text; nan where it has no word."""
        out = np.full((len(texts), len(self.classes)), np.nan)
        held, size = [], 0
        for i, t in enumerate(texts):
            if raw := word_bytes(t):
                held.append((i, raw))
                size += len(raw)
            if size > CHUNK:
                self._score(held, out)
                held, size = [], 0
        self._score(held, out)
        return out

    def _score(self, held: list, out: np.ndarray) -> None:
        if not held:
            return
        if "_logit" not in self.__dict__:
            logit = self.table @ self.out
            # of two classes the difference is enough
            self._logit = np.ascontiguousarray((logit[:, 1:] - logit[:, :1] if logit.shape[1] == 2 else logit).T)
            self._bias = self.bias[1:] - self.bias[:1] if logit.shape[1] == 2 else self.bias
        raw = b"".join(r for _, r in held)
        blank, by_n = grams(raw, self.sizes, self.bits)
        total = np.zeros((len(self._logit), len(raw)), np.float32)
        for h, ok in by_n:
            for k in range(len(total)):
                total[k, : len(h)] += self._logit[k][h] * ok
        # the blank that ends one text stands before the blank that begins the next: a stretch without letters
        words = np.add.reduceat(total, blank, axis=1)[:, :-1] / np.maximum(per_word(blank, self.sizes), 1)
        real = np.diff(blank) > 1
        words = words[:, real].astype(np.float64)
        n = np.array([r.count(b" ") - 1 for _, r in held])
        first = np.concatenate(([0], np.cumsum(n)))
        sums = np.concatenate((np.zeros((len(words), 1)), np.cumsum(words, axis=1)), axis=1)
        if self.window:
            w = self.window
            m = sums[0, w:] - sums[0, :-w] if sums.shape[1] > w else np.empty(0)
        for (i, _), a, b in zip(held, first[:-1].tolist(), first[1:].tolist()):
            if self.window and b - a > self.window:
                at = a + int(np.argmax(m[a : b - self.window + 1]))
                a, b = at, at + self.window
            z = (sums[:, b] - sums[:, a]) / (b - a) + self._bias
            out[i] = (0, z[0]) if len(self.classes) == 2 else z
