r"""PII by candidate gradient boosting.

Base rules (email, ip, card, phone; see `base_spans`) stand as they are. Beside them high-recall generators
propose overlapping spans (spelled-out emails of any domain, IPv6 addresses whole or compressed, digit groups in
the shape of phones, cards, bank accounts and identity numbers); boosted trees (boosting.py) score each from
format and context features, and a span is selected at its kind's threshold, the lowest that reached PRECISION
on examples held out of training. Of overlapping selected spans the likelier stays (ties: the first); one that
overlaps a base span is left to it. The trees learn from examples that a seeded generator writes (valid data and
look-alikes: order numbers, versions, dates, prices, checksums, code, each in several contexts and languages), so
nothing of the corpus, and no number of documents, bounds or shapes the model; thresholds calibrated on the same
generator say little of other texts, so tests hold the whole against sentences written apart from it.

Positions are code points, end exclusive. Null or empty text: no spans. Long texts are searched in whole; patterns
run in time linear in the text. Repeated rows: each has its own result. Empty table: empty result. Extra columns are
kept by `redacted`, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone", "account", "identity")
PRECISION = 0.97
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand for the @ of an email, what stands before it, and what follows: labels and a last one of letters.
AT = re.compile(r"\x20?[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]\x20?|\x20(?:at|AT|At)\x20|\x20?@\x20?")
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|Dot)\x20?[\])}>]\x20?|\x20(?:dot|DOT|Dot)\x20|\.)"
SITE = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,3}}?{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-]|{_DOT}[A-Za-z0-9])")
USER = re.compile(r"[A-Za-z0-9._-]{1,64}\Z")
_HEX = "[0-9A-Fa-f]{1,4}"
#: (kind, pattern): what else may be personal data
GENERATORS = (
    ("ip", re.compile(rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{3,7}}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}}))(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ ./_-]{1,2}){3}[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-]{0,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("identity", re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])")),
)
DIGIT = re.compile(r"[0-9]")
CONTEXT = 28
WORD = re.compile(r"[^\W\d_]+")
TOP_LEVEL = frozenset("com org net edu gov info io dev app eu de fr es uk it ch at nl be pl se no dk fi pt ru us ca au jp cn br in mx".split())
#: Words that are seldom names: what stands around an `at` or a `dot` in plain prose.
PLAIN = frozenset("the a an this that it is was be are and or of in on to for with we they he she i you who look meet met sign start end stay work works arrive arrived home school office noon night once least last first all sea der die das und um le la les un une el los en y".split())
COUNTED = frozenset("euros euro eur dollars items units people years days points pages meters km in and of".split())
CUES = {
    "email": "mail email e-mail write contact reach address correo courriel escribe contactez schreiben kontakt anfragen send",
    "ip": "ip address host server login client adresse connected ping from zugriff von",
    "card": "card visa credit debit payment karte carte tarjeta mastercard",
    "phone": "phone tel call mobile fax cell telefon telefono appelez appeler whatsapp llamar anrufen handy number",
    "account": "iban account bank konto cuenta compte pay",
    "identity": "ssn social security identity passport id ausweis",
    "other": "order invoice version ticket part number no ref serial serie isbn build total price date page pages item sku lot code sample tracking artikel years zeitraum seiten room score chapter population sequence coordinates ratio commit",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start, then kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in AT.finditer(text):
        user, site = USER.search(text, max(0, m.start() - 64), m.start()), SITE.match(text, m.end())
        if user and site:
            out.append((user.start(), 0, site.end()))
    if ":" in text or DIGIT.search(text):
        for kind, pattern in GENERATORS:
            out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


def iban(s: str) -> bool:
    """Whether the checksum of an account number holds."""
    x = re.sub(r"\s", "", s)
    return len(x) > 4 and x[:2].isalpha() and x.isalnum() and x.isascii() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s, digits = text[start:end], _digits(text[start:end])
    before = WORD.findall(text[max(0, start - CONTEXT) : start].lower())[-4:]
    after = WORD.findall(text[end : end + CONTEXT].lower())[:2]
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", s) if g] or [""]
    sizes = [len(g) for g in groups]
    near = [float(any(w in cue.split() for w in before)) for cue in CUES.values()]
    own, parts = list(CUES.values())[kind].split(), WORD.findall(s.lower())
    last = groups[-1]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(digits), len(digits) / len(s), len(groups), max(sizes), min(sizes), len(set(sizes)), sizes[0], sizes[-1],
        float(12 <= len(digits) <= 19 and luhn(digits)), float(iban(s)), float(len(set(digits)) <= 2), float(s[:1] in "0("),
        float("(" in s), float("." in s), float("-" in s), float(" " in s), float("/" in s), float("@" in s), float(any(c in s for c in "[{<(") and kind == 0),
        # emails: how the dot is written, the last label, and words that aren't names
        float("dot" in parts), float(last in TOP_LEVEL), float(last.islower() or last.isupper()), len(last), float(bool(parts) and parts[0] in PLAIN), float(any(p in PLAIN for p in parts[1:] if p not in ("at", "dot"))),
        float(any(c.isdigit() or c in "._" for c in s.split()[0])),
        # addresses: groups, letters, and prefixes that networks have
        s.count(":"), float("::" in s), float(any(c in "abcdefABCDEF" for c in s)), float(bool(re.match(r"(?i)2[0-9a-f]{3}:|fe80:|f[cd][0-9a-f]{2}:", s))),
        float(text[max(0, start - 1) : start] in "[(" and start > 0),
        # dates, amounts and counts
        float(bool(re.match(r"(?:1[5-9]|20)[0-9][0-9](?![0-9])", s) or re.search(r"(?<![0-9])(?:1[5-9]|20)[0-9][0-9]$", s))),
        float(bool(re.fullmatch(r"[0-9]{1,3}(?: [0-9]{3})+", s))), float(any(w in COUNTED for w in after)),
        float(any(w in own for w in before)), *near,
        float(text[end : end + 1] in "$€%°" and end < len(text)), float(text[max(0, start - 1) : start] in "#$€vV-_/" and start > 0),
        float(text[end : end + 1] in ".," and text[end + 1 : end + 2].isdigit()), float(text[end : end + 1] == "-"),
    ]


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label): written by rule, half personal data, half look-alikes."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    name = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(int(r.integers(3, 9))))
    hex_ = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    plain = sorted(PLAIN)

    def card(valid: bool) -> str:
        body = pick("3456") + d(14)
        x, sep = body + next(c for c in "0123456789" if luhn(body + c) == valid), pick([".", "/", "_", "  ", "- "])
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def account() -> str:
        land, body = pick(["DE", "FR", "ES", "GB", "NL", "IT", "CH"]), "".join([pick(["WEST", "ABNA", d(4)]), d(int(r.integers(10, 20)))])
        rest = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        x = f"{land}{rest:02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4)) if r.random() < 0.5 else x

    def user() -> str:
        return pick([name(), f"{name()}.{name()}", f"{name()}_{name()}", f"{name()}{d(2)}", f"{name()[0]}.{name()}", "info", "support", "contact"])

    def email() -> str:
        top, own = pick(sorted(TOP_LEVEL)), pick([name(), f"{name()}-{name()}", f"{name()}{d(1)}"])
        at, dot = pick([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("{at}", "{dot}"), (" {at} ", " {dot} "), (" AT ", " DOT "), ("(at)", "."), (" [at] ", "."), (" @ ", "."), ("@ ", ".")])
        return user() + at + own + (dot + "co" if r.random() < 0.1 else "") + dot + (top.upper() if at == " AT " and r.random() < 0.3 else top)

    def ipv6() -> str:
        lead = pick(["2001", "2a02", "2003", "2a01", "2600", "fe80", "fd12", "fc00", f"2{hex_(3)}"])
        n = int(r.integers(1, 6))
        if r.random() < 0.5:
            return ":".join([lead, *(hex_(int(r.integers(1, 5))) for _ in range(7))])
        head = [lead, *(hex_(int(r.integers(1, 5))) for _ in range(int(r.integers(0, n))))]
        return ":".join(head) + "::" + ":".join(hex_(int(r.integers(1, 5))) for _ in range(max(1, 6 - len(head) - n)))

    phone = lambda: pick([
        f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}",
        f"(0{d(2)}) {d(3)} {d(2)} {d(2)}", f"0{d(3)} {d(4)} {d(4)}", f"0{d(3)}/{d(3)} {d(4)}", f"9{d(2)} {d(3)} {d(3)}",
    ])
    day = lambda: (f"{r.integers(10, 29)}", f"{r.integers(10, 13)}", f"{r.integers(1700, 2100)}")
    good = [("email", email), ("ip", ipv6), ("card", lambda: card(True)), ("phone", phone), ("account", account), ("identity", lambda: f"{d(3)}-{d(2)}-{d(4)}")]
    bad = [
        ("email", lambda: f"{pick(plain)} at {pick([name(), pick(plain)])}.{pick(['The', 'In', 'And', 'Von', 'El', 'Then', 'Next', 'That'])}"), ("email", lambda: f"{name()} at {name()} dot {name()}"),
        ("email", lambda: f"{pick(plain)} at {pick(plain)} dot {pick(plain)}"), ("email", lambda: f"{pick(plain)} at {name()}.{pick(['net', 'com', 'is', 'it', 'to', 'so', 'me'])}"), ("email", lambda: f"{name()} at {name()}.{pick(['Then', 'And', 'But'])}"),
        ("ip", lambda: f"{r.integers(10, 24)}:{r.integers(10, 60)}:{r.integers(10, 60)}:{d(2)}"), ("ip", lambda: ":".join(d(int(r.integers(1, 3))) for _ in range(int(r.integers(4, 7))))), ("ip", lambda: ":".join(hex_(2) for _ in range(6))),
        ("ip", lambda: pick([f"::{d(1)}", f"{d(1)}::{d(1)}", "::", f"{d(1)}::", f"{pick(['abc', 'face', 'ad', 'bad'])}::{pick(['add', 'dec', 'f', 'ace'])}"])),
        ("card", lambda: card(False)), ("phone", lambda: "-".join(day()[::-1])), ("phone", lambda: pick([".", "/", " "]).join(day())), ("phone", lambda: f"{d(2)}.{d(2)}.{d(2)}"), ("phone", lambda: f"{r.integers(1, 999)} {d(3)} {d(3)}" + pick(["", f" {d(3)}"])),
        ("phone", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}"), ("phone", lambda: " ".join(f"{r.integers(1500, 2100)}" for _ in range(4))), ("phone", lambda: " ".join(d(2) for _ in range(4))), ("phone", lambda: "-".join(f"{r.integers(100, 999)}" for _ in range(3))),
        ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"{d(4)} {d(4)} {d(4)}"), ("phone", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(4)}"), ("phone", lambda: f"{r.integers(1900, 2100)}.{d(2)}.{d(2)}"), ("phone", lambda: f"{d(3)}-{d(2)}-{d(3)}"),
        ("account", lambda: f"{pick(['AB', 'XK', 'PN'])}{d(2)} {d(4)} {d(4)}"), ("account", lambda: f"{pick(['SN', 'RT', 'PN'])}{d(2)} {d(4)} {d(4)} {d(4)}"), ("account", lambda: f"{pick(['SN', 'RT'])}{d(18)}"), ("identity", lambda: f"{d(3)} {d(2)} {d(4)}"), ("identity", lambda: f"{d(3)}-{d(2)}-{d(4)}"),
    ]
    cue = {k: v.split() for k, v in CUES.items()}
    out = []
    for i in range(n):
        label = i % 2
        kind, make = pick(good if label else bad)
        s, own, link = make(), r.random(), pick([": ", " ", " ", " at " if kind == "ip" else " is ", " to ", " on ", " le ", " an "])
        filler = f"{pick([name(), pick(plain)])} {pick([name(), pick(plain)])} "
        # an identity number or a phone needs its context (others may go without); look-alikes get other cues, or none
        if label:
            lead = f"{pick(cue[kind])}{link}" if own < (1.0 if kind in ("identity", "phone") else 0.6) else filler
        else:
            lead = f"{pick(cue['other'])}{pick([' ', ' ', ': ', ' #', ' v', ' no '])}" if own < 0.7 else filler
        tail = pick([f" {name()}.", ".", ",", f", {name()}", f" {pick(plain)} {name()}", ""]) if label or r.random() < 0.7 else f" {pick(sorted(COUNTED))}."
        text = f"{pick([name(), pick(plain), pick(plain).title()])} {lead}"
        out.append((f"{text}{s}{tail}", len(text), KINDS.index(kind), len(text) + len(s), label))
    return out


@functools.cache
def model() -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and a threshold for each kind."""
    rows = lambda e: (np.array([features(t, a, k, b) for t, a, k, b, _ in e]), np.array([x[4] for x in e], float), np.array([x[2] for x in e]))
    x, y, _ = rows(examples(4000, 11))
    trees = BoostedTrees().fit(x, y)
    x, y, kind = rows(examples(2000, 12))
    p, out = trees.predict(x), []
    for k in range(len(KINDS)):
        q, right = p[kind == k], y[kind == k]
        by = np.argsort(-q, kind="stable")
        good = np.flatnonzero(np.cumsum(right[by]) >= PRECISION * np.arange(1, len(by) + 1))
        out.append(max(0.5, float(q[by[good[-1]]])) if len(good) else 1.1)
    return trees, tuple(out)


class _Spans:
    """Whether a span overlaps one of those added, in order of start or not."""

    def __init__(self):
        self.starts, self.ends = [], []  # disjoint, ascending

    def add(self, start: int, end: int) -> bool:
        """Adds a span unless it overlaps one."""
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def batch_spans(texts: list, trained) -> list[tuple[list, list]]:
    """For each text its base spans and those that the model adds."""
    trees, least = trained
    base, found, rows = [], [], []
    for i, t in enumerate(texts):
        base.append(base_spans(t) if isinstance(t, str) else [])
        starts, reach = [a for a, _, _ in base[-1]], list(accumulate((b for _, _, b in base[-1]), max))
        for c in candidates(t) if isinstance(t, str) else []:
            k = bisect_left(starts, c[2])
            if not (k and reach[k - 1] > c[0]):
                found.append((i, c))
                rows.append(features(t, *c))
    more: list[list] = [[] for _ in texts]
    if rows:
        p = trees.predict(np.array(rows))
        taken = [_Spans() for _ in texts]
        for j in sorted((j for j in range(len(p)) if p[j] >= least[found[j][1][1]]), key=lambda j: (-p[j], j)):
            i, c = found[j]
            if taken[i].add(c[0], c[2]):
                more[i].append(c)
    return [(x, sorted(y)) for x, y in zip(base, more)]


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def spans_column(text: Column) -> Column:
    trained = model()

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, more in batch_spans(list(texts), trained):
                count = [sum(k == kind for _, kind, _ in base) for k in range(4)]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more), len(base) + len(more)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return found(text)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and RESULT."""
    return docs.select(F.col(doc_id).alias("doc_id"), spans_column(F.col(text)).alias("s")).select("doc_id", "s.*")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; null stays null, other columns as they were."""
    trained = model()

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t, (base, more) in zip(texts, batch_spans(list(texts), trained)):
                parts, at = [], 0
                for a, k, b in sorted(base + more):
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if isinstance(t, str) else None)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, masked(F.col(text)))
