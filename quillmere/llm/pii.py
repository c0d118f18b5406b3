"""Personal data by candidate gradient boosting.

Base rules find emails, IPv4 addresses, cards and phones, and always stay. High-recall generators then propose
overlapping spans of further kinds: emails written out, phones without a plus sign, grouped cards, national ids,
account numbers, IPv6 addresses and secrets (long tokens of any length, signed web tokens, key blocks, and what stands after a password's name).
The lengths in their patterns are those of the formats: 64 characters before and 63 in each label after an email's "at". Boosted regression trees score each by its format and the words around it; they are trained here, on
labelled sentences made by a seeded generator (`examples` of them), a third of which are held out to calibrate the scores (Platt scaling)
and to choose each kind's threshold: the lowest with `precision` or more on the held-out spans. Of candidates over it, those inside another of their
kind are left out; the others are taken by falling score where they overlap neither a base span nor one taken before.

Defined results: null or empty text: no spans. Null doc_id: kept. Repeated rows: a row each. Empty table: no rows. Ties in score: the
span that starts first, then the longer. Very long texts: read whole, one at a time. Other columns are ignored. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents, id_text, map_docs

BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# --- base rules ---------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: each "@" with the whole run of local characters before it that no match has used."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        if at >= used:
            start = at
            while start > used and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := HOST.match(text, at)):
                out.append((start, m.end()))
                used = m.end()
        at = text.find("@", at + 1)
    return out


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


# --- candidates ---------------------------------------------------------------------------------------------------

#: What may be personal data, much of it not.
GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}(?:\)[ .-]?|[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[. _/][0-9]{4}){3}(?![0-9])"),
    "id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(
        r"(?<![A-Za-z0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
        r"|(?=:*[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![A-Za-z0-9:])"
    ),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"),
}
#: Further forms of secrets, each with a sign that any text with one shows (in lower case); group 1 is the span.
SECRETS = (
    (("-----begin",), re.compile(r"(-----BEGIN [A-Z0-9 ]+-----[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]+-----)")),
    (("eyj",), re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*)")),
    (("passw", "pwd", "passphrase", "secret", "token", "key"), re.compile(r"(?i:\b[a-z_-]*(?:password|passwd|pwd|passphrase|secret|token|key)\b[\"']?\s{0,3}(?:[:=]|\bis\b)\s{0,3}[\"']?)([^\s\"',;<>]{6,})")),
)
#: Cheap signs, one of which any candidate of the kind shows.
SIGNS = {"email": re.compile(r"\bat\b"), "card": re.compile(r"[0-9]{4}[. _/][0-9]{4}"), "id": re.compile(r"[0-9]-[0-9]{2}-"), "account": re.compile(r"[A-Z]{2}[0-9]{2}"), "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|::"), "phone": re.compile(r"[0-9]{2}(?:\)[ .-]?|[ .-])[0-9]{3}"), "secret": re.compile(r"[A-Za-z0-9+/_-]{20}")}
KINDS = tuple(GENERATORS)
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "card": ("card", "visa", "credit", "pay"),
    "id": ("ssn", "social", "security", "national"),
    "account": ("iban", "account", "bank", "transfer"),
    "ip": ("ip", "host", "address", "server"),
    "secret": ("token", "key", "secret", "password", "pwd", "auth", "bearer", "credential"),
}
AGAINST = ("order", "item", "version", "date", "page", "figure", "isbn", "commit", "sha", "checksum", "part", "section", "invoice", "path", "lines")


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, pattern in GENERATORS.items():
        if SIGNS[kind].search(text):
            for m in pattern.finditer(text):
                yield kind, *m.span()
    low = text.lower()
    for signs, pattern in SECRETS:
        if any(s in low for s in signs):
            for m in pattern.finditer(text):
                yield "secret", *m.span(1)


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    n = b - a
    before = text[max(0, a - 48) : a].lower()
    near = before[-24:]
    d = digits(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [
        float(KINDS.index(kind)),
        n,
        len(d),
        len(d) / n,
        sum(c.isalpha() for c in s) / n,
        sum(c.isupper() for c in s) / n,
        sum(not c.isalnum() for c in s),
        entropy,
        float(bool(d) and luhn(d)),
        float(any(c in near for c in CUES[kind])),
        float(any(c in before for c in CUES[kind])),
        float(any(c in near for c in AGAINST)),
        float(before.rstrip()[-1:] in ("=", ":", '"')),
        float("dot" in s or s.count(".") > 0),
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(bool(re.search(r"[a-z]", s)) and bool(re.search(r"[A-Z]", s)) and bool(d)),
        max((len(p) for p in re.split(r"[^A-Za-z]+", s)), default=0),
    ]


# --- training -----------------------------------------------------------------------------------------------------

WORDS = "the of and to in that is was for on with as by at from it an be this are or which have has its report table page note about value order item part".split()


def examples(n: int, seed: int = 7) -> list[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, personal?) of n made-up sentences, half of them with a look-alike."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    groups = lambda n: ":".join(pick(hexa, 4).lstrip("0") or "0" for _ in range(n))

    def card() -> str:
        x = num(15)
        return next(x + c for c in "0123456789" if luhn(x + c))

    def web() -> str:
        return ".".join(["eyJ" + pick(b64, r.randint(12, 40)), pick(b64 + "-_", r.randint(20, 120)), pick(b64 + "-_", 43)])

    def block() -> str:
        kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"])
        return f"-----BEGIN {kind}-----\n" + "\n".join(pick(b64 + "+/", 64) for _ in range(r.randint(2, 8))) + f"\n-----END {kind}-----"

    good = {
        "email": lambda: f"{name()}{r.choice([' at ', ' (at) ', '(at)', '[at]', ' [at] '])}{name()}{r.choice([' dot ', ' (dot) ', '[dot]', '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}",
        "phone": lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}){num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(4)} {num(3)} {num(4)}"]),
        "card": lambda: r.choice([".", "_", "/", " "]).join(re.findall("....", card())),
        "id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "account": lambda: f"{pick('DEFGBIT', 2)}{num(2)}" + r.choice(["", " "]).join(["", *re.findall("....", num(16))]) + num(2),
        "ip": lambda: r.choice([groups(8), f"{groups(r.randint(1, 5))}::{groups(r.randint(1, 2))}", f"fe80::{groups(4)}"]),
        "secret": lambda: r.choice([pick(hexa, r.choice([32, 40, 64])), pick(b64, r.randint(20, 48)), pick(b64 + "-_", r.randint(129, 600)), "sk_" + pick(b64, 24), "AK" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), pick(b64 + "!#$%&*@", r.randint(8, 19)), name() + r.choice("!#_-") + num(r.randint(2, 4)), web(), block()]),
    }
    bad = {
        "email": lambda: f"{r.choice(WORDS)} at {r.choice(WORDS)}.{r.choice(WORDS).capitalize()}",
        "phone": lambda: r.choice([f"{r.randint(1900, 2030)} {num(3)} {num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(4)}-{num(4)}"]),
        "card": lambda: "/".join(num(4) for _ in range(4)),
        "id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "account": lambda: f"{pick('ABXYZ', 2)}{num(2)} {pick('ABCDEFGH', 4)} {num(4)}",
        "ip": lambda: r.choice([":".join(num(2) for _ in range(4)), f"{num(1)}::{num(1)}", f"::{r.choice(['add', 'bad', 'dec', 'fade'])}"]),
        "secret": lambda: r.choice(["-".join(r.choice(WORDS) for _ in range(r.randint(5, 9))), "/".join([name() for _ in range(5)]), name() + name() + name() + name(), pick(hexa, 40), "-" * 30, "a" * 25, "-" * r.randint(129, 300), "/".join(name() for _ in range(40)), "_".join([name() for _ in range(4)]), name() + name(), r.choice(["required", "expired", "invalid", "missing", "optional", "changed"]), "file." + name() + "." + name()]),
    }
    out = []
    while len(out) < n:
        kind = r.choice(KINDS)
        real = r.random() < 0.5
        s = (good if real else bad)[kind]()
        lead = [r.choice(WORDS) for _ in range(r.randint(0, 6))]
        if real and r.random() < (0.97 if kind in ("secret", "id", "account", "card") else 0.6):
            lead.append(r.choice(CUES[kind]) + r.choice([":", " =", "", " is", ' = "', ' "']))
        elif not real and r.random() < 0.5:
            lead.append(r.choice(AGAINST) + r.choice(["", ":", " no."]))
        elif not real and (kind in ("email", "card", "account", "ip") or kind == "secret" and not any(c.isdigit() for c in s)) and r.random() < 0.6:
            lead.append(r.choice(CUES[kind]) + r.choice([":", "", " is"]))  # the cue of the kind before a look-alike
        head = " ".join(lead) + " " * bool(lead) * (not (lead and lead[-1].endswith('"')))
        text = head + s + r.choice([" ", ". ", '" ', ", "]) + " ".join(r.choice(WORDS) for _ in range(4))
        start, end = len(head), len(head) + len(s)
        if met := [(abs(a - start) + abs(b - end), a, b) for k, a, b in candidates(text) if k == kind and a < end and b > start]:
            _, a, b = min(met)
            out.append((text, kind, a, b, real))
    return out


class Trees:
    """Gradient boosting of depth-limited regression trees on the logistic loss, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, leaf: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list = []
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, y - p, p * (1 - p), np.arange(len(y)), depth, rate, leaf)
            self.trees.append(tree)
            f += np.array([self._leaf(tree, b) for b in bins])

    def _grow(self, bins, g, h, rows, depth, rate, leaf):
        value = rate * g[rows].sum() / (h[rows].sum() + leaf)
        if not depth or len(rows) < 20:
            return float(value)
        best, where = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, cuts in enumerate(self.cuts):
            gs = np.bincount(bins[rows, j], g[rows], len(cuts) + 1).cumsum()[:-1]
            hs = np.bincount(bins[rows, j], h[rows], len(cuts) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + leaf) + (total_g - gs) ** 2 / (total_h - hs + leaf) - total_g**2 / (total_h + leaf)
            if len(gain) and gain.max() > best:
                best, where = gain.max(), (j, int(gain.argmax()))
        if where is None:
            return float(value)
        j, cut = where
        left = bins[rows, j] <= cut
        return j, cut, self._grow(bins, g, h, rows[left], depth - 1, rate, leaf), self._grow(bins, g, h, rows[~left], depth - 1, rate, leaf)

    @staticmethod
    def _leaf(tree, b) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if b[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: list[float]) -> float:
        b = [int(np.searchsorted(c, v, "left")) for c, v in zip(self.cuts, x, strict=True)]
        return self.base + sum(self._leaf(t, b) for t in self.trees)


class Model:
    """Trees, Platt's scaling of their scores, and a threshold for each kind."""

    def __init__(self, n: int = 6000, precision: float = 0.97, seed: int = 7):
        data = examples(n, seed)
        x = np.array([span_features(t, k, a, b) for t, k, a, b, _ in data])
        y = np.array([float(r) for *_, r in data])
        held = np.arange(len(y)) % 3 == 0
        self.trees = Trees(x[~held], y[~held])
        s = np.array([self.trees.score(v) for v in x[held]])
        self.scale = self._platt(s, y[held])
        p = self.probability(s)
        self.thresholds = {}
        for j, kind in enumerate(KINDS):
            own = x[held][:, 0] == j
            order = np.argsort(-p[own])
            right = y[held][own][order].cumsum() / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= precision)
            self.thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1

    @staticmethod
    def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, [((y - p) * s).sum(), (y - p).sum()])
            a, b = a + step[0], b + step[1]
        return float(a), float(b)

    def probability(self, s):
        return 1 / (1 + np.exp(-(self.scale[0] * s + self.scale[1])))

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Accepted spans that overlap none of `taken` and each other."""
        scored = []
        taken = _merged(taken)
        for kind, a, b in dict.fromkeys(candidates(text)):
            if not _overlaps(taken, a, b):
                p = float(self.probability(self.trees.score(span_features(text, kind, a, b))))
                if p >= self.thresholds[kind]:
                    scored.append((kind, a, b, p))
        return chosen(scored, taken)


def chosen(scored: list[tuple[str, int, int, float]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of (kind, start, end, score), the spans that stay. taken: sorted disjoint spans that none may overlap."""
    outer, ends = [], dict.fromkeys(KINDS, -1)
    for kind, a, b, p in sorted(scored, key=lambda s: (s[1], -s[2])):
        if b > ends[kind]:  # not inside one that starts before it or with it
            outer.append((-p, a, -b, kind))
            ends[kind] = b
    taken, out = list(taken), []
    for _, a, b, kind in sorted(outer):
        if not _overlaps(taken, a, -b):
            insort(taken, (a, -b))
            out.append((kind, a, -b))
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the spans, which are sorted and disjoint: the last that starts before b has the largest end."""
    k = bisect_left(taken, (b, -1))
    return k > 0 and taken[k - 1][1] > a


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans with the same places; base spans of different kinds may overlap one another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, model.spans(text, [s for v in base.values() for s in v])


def spans_of(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and added spans (kind, start, end, in that order of kinds and by start), of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        m = held.value
        for i, text in rows:
            base, more = find(text, m)
            flat = [(k, a, b) for k in BASE for a, b in base[k]]
            rank = {k: n for n, k in enumerate((*BASE, *(k for k in KINDS if k not in BASE)))}
            every = sorted([*flat, *more], key=lambda s: (rank[s[0]], s[1], s[2]))
            tell = lambda v: [{"kind": k, "a": a, "b": b} for k, a, b in v]
            yield i, tell(flat), tell(every)

    return map_docs(docs, run, "doc_id bigint, base array<struct<kind: string, a: int, b: int>>, spans array<struct<kind: string, a: int, b: int>>", binary=False)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(id_text(documents(spark, sf_dir)), Model())
    tell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.a, s.b)), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(n, BASE), F.sha2(tell("base"), 256).alias("base_sha256"), tell("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
