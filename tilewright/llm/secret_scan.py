r"""Secret scans with DataFrame functions only.

Base rules, leftmost and non-overlapping for each kind, matches that fail dropped: `assign`, `access`, `hex`
(patterns below; positions in code points, end exclusive). Beside them, candidate strings (20 or more of the
base64 alphabet with a digit and a letter) are scanned with a sliding window of WINDOW characters: the window's
symbol counts (packed into a few integers), and from them sum(c * log2(c)), are updated by the symbol that enters
and the one that leaves, and the highest Shannon entropy over all windows is held against the limit of the
candidate's character class; likewise for its value, what follows the last '=' (but padding). Candidates whose
whole value is on the allow list are suppressed (kind `entropy`); base matches never are, and a candidate that
overlaps a base match is left to it.

Every pattern runs over a text once. Places are running sums of the lengths between and in matches, overlaps
running maxima, each in log2(n) passes over an array of n matches, so that time is linear in the text but for that
factor, however many matches or however long a candidate.

Null or empty text: no spans. Repeated rows and ties: each row has its own result. Empty table: empty result. Long
texts are scanned whole. Extra columns: `secrets` reads none, `redacted` keeps them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the same as runs of [0-9a-f] with 24 or more
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Limits in bits for windows of 20, by the symbols that a value draws on: of random strings of 20, 1% or fewer are below.
LIMITS = {"hex": 2.87, "single": 3.34, "alnum": 3.64, "base64": 3.64}
_WORDS = r"(?:[A-Z][a-z]++|[a-z]++|[A-Z]++(?![a-z]))++"  # no case changes as random letters have them
_PART = rf"(?:{_WORDS}[0-9]{{0,4}}+|[0-9]{{1,8}}+(?:T[0-9]{{4,6}}+Z?)?)(?![A-Za-z0-9])"
_NAME = rf"_*+{_PART}(?:[-_+]++(?:{_PART}|[A-Za-z0-9]{{1,4}}+(?![A-Za-z0-9])))*+"  # after the first, short parts of any kind
_RUN = r"0123456789|1234567890|[0-9]{1,4}(?![0-9])|(?i:abcdef(?:gh(?:ijklmnopqrstuvwxyz)?)?|x{4,}+|example|sample|dummy|placeholder|your|test|api|access|secret|token|key)"
#: What a whole value may be without being a secret: a public example, placeholders and runs of the alphabet, UUIDs, names, paths, numbers.
ALLOW = rf"^(?:wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|(?:[-_/+]?(?:{_RUN}))++|(?i:[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})|{_NAME}|/?(?:{_NAME}/++)++(?:{_NAME})?|[0-9][0-9-]*+)$"
VALUE = "^.*=(?=[^=])"  # what stands before a candidate's value
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
MARK = "[SECRET]"
EDGE, OTHER = "\x01", "\x02"  # a character that no pattern has marks matches; where a text has it, another stands for it
PIECE = 256  # code points
COUNTERS, BITS = 12, 5  # window counts in an integer, bits of each (a count is at most WINDOW + 1)
FURTHEST = 2**31 - 1


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, combine, back: bool = False) -> Column:
    """Of an array, what combine makes of all values up to each one (from each one on): doubling distances, log2(n) passes."""

    def scanned(v: Column) -> Column:
        def step(acc, d):
            return F.transform(acc, lambda x, i: F.coalesce(combine(x, F.get(acc, i + d if back else i - d)), x))

        return F.aggregate(F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(v)), v, step)

    return _let(values, scanned)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _greatest(a: Column, b: Column) -> Column:
    return F.when(b > a, b).otherwise(a)


def _least(a: Column, b: Column) -> Column:
    return F.when(b < a, b).otherwise(a)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches with their places; text has no EDGE."""
    none = F.array().cast(SPAN)

    def placed(parts: Column) -> Column:
        ends = _running(F.transform(parts, F.length), _plus)
        both = F.zip_with(parts, ends, lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("value")))
        # every second part is a match
        return F.filter(both, lambda s, i: (i % 2 == 1) & (keep(s["value"]) if keep else F.lit(True))).cast(SPAN)

    # a search for any match first: most texts have none, and need no copy
    return F.when(text.rlike(pattern), _let(F.split(F.regexp_replace(text, pattern, f"{EDGE}$0{EDGE}"), EDGE, -1), placed)).otherwise(none)


def _apart(base: Column, found: Column) -> Column:
    """Spans found that overlap none of base."""

    def kept(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), _greatest)
        ahead = _running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(FURTHEST)), _least, back=True)
        near = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
        each = F.zip_with(spans, near, lambda s, n: F.struct(s.alias("s"), ((s["kind"] == 3) & (n["reach"] <= s["start"]) & (n["ahead"] >= s["end"])).alias("free")))
        return F.transform(F.filter(each, lambda x: x["free"]), lambda x: x["s"])

    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(_let(F.array_sort(F.concat(base, found)), kept))


def max_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any `window` consecutive characters of value (of ALPHABET).

    Symbol k's count is BITS bits of the integer k // COUNTERS: a step adds one for the symbol that enters and takes one off for
    the one that leaves, and nothing is copied."""
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    symbols = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    steps = F.zip_with(symbols, F.concat(F.array_repeat(F.lit(-1), window), symbols), lambda i, o: F.struct(i.alias("enters"), o.alias("leaves")))
    steps = F.filter(steps, lambda s: s["enters"] >= 0)
    names = [f"c{j}" for j in range(-(-len(ALPHABET) // COUNTERS))]
    zero = F.lit(0).cast("long")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), BITS * (k % COUNTERS))
    at = lambda acc, j: F.coalesce(*(F.when(j == i, acc[c]) for i, c in enumerate(names)))
    read = lambda packed, k: F.call_function("shiftright", packed, BITS * (k % COUNTERS)).bitwiseAND((1 << BITS) - 1).cast("int")
    word = lambda k: F.floor(k / COUNTERS).cast("int")

    def step(acc, s):
        i, o = s["enters"], s["leaves"]
        n = read(at(acc, word(i)), i)
        m = F.when(o == i, n + 1).when(o >= 0, read(at(acc, word(o)), o))  # o's count when i has entered
        total = acc["sum"] + F.get(weight, n + 1) - F.get(weight, n) + F.when(o >= 0, F.get(weight, m - 1) - F.get(weight, m)).otherwise(0.0)
        counts = [(acc[c] + F.when(word(i) == j, one(i)).otherwise(zero) - F.when((o >= 0) & (word(o) == j), one(o)).otherwise(zero)).alias(c) for j, c in enumerate(names)]
        seen = acc["seen"] + 1
        bits = F.when(seen >= window, math.log2(window) - total / window).otherwise(0.0)
        return F.struct(*counts, total.alias("sum"), seen.alias("seen"), F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(*(zero.alias(c) for c in names), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _random(found: Column) -> Column:
    """Of a candidate: its value is not on the allow list, and it or its value has the entropy of random strings of its class."""

    def high(x: Column) -> Column:
        limit = F.when(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"]).when(x.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), LIMITS["single"])
        return max_window_entropy(x) >= limit.when(x.rlike("^[A-Za-z0-9]+$"), LIMITS["alnum"]).otherwise(LIMITS["base64"])

    value = F.regexp_replace(found, VALUE, "")
    return ~value.rlike(ALLOW) & (high(found) | ((value != found) & high(value)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_and_more(text: Column) -> tuple[Column, Column]:
    """Spans (SPAN, by start, then kind) of the base rules, and a function of these for those of the entropy scan."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(EDGE), F.lit(OTHER))
    none = F.array().cast(SPAN)
    low = F.lower(t)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assigned = _spans(t, ASSIGN, 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    access = _spans(t, ACCESS, 1, lambda v: F.length(v) >= 20)
    base = F.array_sort(F.concat(F.when(named, assigned).otherwise(none), F.when(t.contains("AKIA"), access).otherwise(none), _spans(t, HEX, 2)))
    return base, lambda known: F.filter(_apart(known, _spans(t, CANDIDATE, 3)), lambda s: _random(s["value"]))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    base, more = base_and_more(F.col("text"))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("base", base).withColumn("more", more(F.col("base")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_entropy"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """text with MARK for each run of overlapping spans (by start). It is read in pieces, so that a cut costs a piece, not the text."""

    def whole(pieces: Column, s: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            i = F.floor(a / PIECE).cast("int")
            n = F.floor((b - 1) / PIECE).cast("int") - i + 1
            return F.when(b > a, F.substring(F.array_join(F.slice(pieces, i + 1, n), ""), a - i * PIECE + 1, b - a)).otherwise(F.lit(""))

        before = F.concat(F.array(F.lit(0)), _running(F.transform(s, lambda x: x["end"]), _greatest))
        # the entry after the last span is the text's rest
        parts = F.zip_with(before, F.transform(s, lambda x: x["start"]), lambda b, a: F.when(a.isNull(), cut(b, F.length(text))).when(a >= b, F.concat(cut(b, a), F.lit(MARK))).otherwise(F.lit("")))
        return F.array_join(parts, "")

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: _let(spans, lambda s: whole(p, s)))


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by MARK (overlapping ones by one); null stays null, other columns as they were."""
    base_spans, more_spans = base_and_more(F.col(text))
    base, more, cut = (unused(c, docs) for c in ("base", "more", "cut"))
    found = docs.withColumn(base, base_spans).withColumn(more, more_spans(F.col(base)))
    all_spans = F.array_sort(F.concat(base, more))
    out = found.withColumn(cut, F.when(F.size(base) + F.size(more) > 0, _masked(F.col(text), all_spans)).otherwise(F.col(text)))
    changed = {text: F.col(cut)}
    if n_chars and n_chars in docs.columns:
        changed[n_chars] = F.when(F.size(base) + F.size(more) > 0, F.length(cut)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType)
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
