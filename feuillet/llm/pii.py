"""Personal data: spans by fixed rules, and spans that boosted trees add from high-recall candidates.

Generators propose spans that may overlap: whatever looks like an address, an IP number, a card or a phone number,
checked or not. Candidates that a rule settles teach the trees. Positive are those that pass their check, wider ones
within such a span (a phone number without its +), and such spans written otherwise (a card in groups, an address
with [at]). Negative are those that fail their check, sit inside a longer word such as a key, meet a span of another
kind, or are a card with a wrong digit. The trees see format and context, and their thresholds, one for each kind, are
set on the candidates of held-out texts, a third of all, to a wished precision. A candidate that no rule settles and
that reaches its threshold is added where it meets no other span.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import map_batches, table, texts

KINDS = ("email", "ip", "card", "phone")
#: fixed values: the rules' patterns; an email's local part is read backwards from its @
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
ZONE = re.compile(r"[+0-9][0-9\x20().+-]{5,}")
#: an ip begins where a run of digits does: what starts within one has the same rest, so a long run is looked at once
RULES = {"ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
#: fixed values: what else may be personal data
WIDER = {
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"[0-9]{4}(?:[\x20.-][0-9]{4}){2}[\x20.-][0-9]{1,7}"),
    "phone": re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]+)+"),
}
CUES = ("mail", "contact", "call", "phone", "tel", "ip", "host", "card", "visa", "pay", "token", "password", "key", "secret", "version", "id")
BINS = 1000  # of the scores, where thresholds are set
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(n) <= 3 and int(n or "0") <= 255 for n in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def matches(text: str) -> list[tuple[int, int, str]]:
    """What the rules' patterns find, before their checks: leftmost and non-overlapping within each kind."""
    found, at = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        if m.start() >= at and (start := max(at, local(text, m.start()))) < m.start():
            found.append((start, m.end(), "email"))
            at = m.end()
    for zone in ZONE.finditer(text):
        for kind, rule in RULES.items():
            found += [(zone.start() + m.start(), zone.start() + m.end(), kind) for m in rule.finditer(zone[0])]
    return found


def local(text: str, at: int) -> int:
    """Where the run of an address's local part before ``at`` begins."""
    size = 64
    while True:
        low = max(0, at - size)
        start = LOCAL.search(text, low, at).start() if at else 0
        if start > low or not low:
            return start
        size *= 4


def order(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    return order(s for s in matches(text) if passes(s[2], text[s[0] : s[1]]))


def candidates(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, label); label 1 or 0 where a rule settles it, else -1."""
    out: dict[tuple[int, int, str], int] = {}
    for s in matches(text):
        out[s] = int(passes(s[2], text[s[0] : s[1]]))
        for start, end in parts(text, s[0], s[1]) if s[2] == "card" and not out[s] else ():
            out.setdefault((start, end, "card"), -1 if luhn(re.sub("[^0-9]", "", text[start:end])) else 0)
    sure = [s for s, label in out.items() if label == 1]
    for kind, wider in WIDER.items():
        if kind == "email" and not re.search(r"[\[({]at[\])}]", text) or kind == "ip" and text.count(":") < 7:
            continue
        for m in [m for zone in ZONE.finditer(text) for m in wider.finditer(text, max(0, zone.start() - 1), zone.end())] if kind in ("card", "phone") else wider.finditer(text):
            inside = text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()
            met = [k for a, b, k in sure if a < m.end() and m.start() < b]
            out.setdefault((m.start(), m.end(), kind), 0 if inside or met and kind not in met else 1 if met else -1)
    return [(*s, label) for s, label in out.items()]


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The rows of 13 to 19 digits that begin and end with a group of a failing run of digits: two numbers with one space between them are such a run."""
    groups = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, start, end)]
    out = []
    for k, (first, _) in enumerate(groups if len(groups) > 1 else ()):
        digits = 0
        for a, b in groups[k : k + 19]:
            digits += b - a
            if digits > 19:
                break
            if digits >= 13:
                out.append((first, b))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 1]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), sum(c.isalpha() for c in s), s.count(" "), s.count("-"), s.count("."), s.count("("), s.count(":"),
        float(s[0] == "+"), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(luhn(digits)) if digits else 0.0, float(all(len(g) < 4 and int(g) <= 255 for g in groups)),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ("=", ":", '"', "'")), *(float(c in before) for c in CUES),
    ]


@dataclass
class Detector:
    model: Boosted | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def added(self, many: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        """For each text, the spans to add: best first, where they meet no other span."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in many]
        if self.model is None:
            return out
        open_ = [(k, c) for k, text in enumerate(many) for c in candidates(text) if c[3] < 0 and c[2] in self.thresholds]
        if not open_:
            return out
        p = self.model.probability(np.array([features(many[k], *c[:3]) for k, c in open_]))
        for score, (k, (start, end, kind, _)) in sorted(zip(p, open_, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds[kind] and all(end <= a or b <= start for a, b, _ in base[k] + out[k]):
                out[k].append((start, end, kind))
        return out


def rewritten(s: str, kind: str) -> list[tuple[str, int]]:
    """A passing span as others write it, and as what is none, with labels."""
    if kind == "email":
        name, _, domain = s.partition("@")
        return [(f"{name} [at] {domain}", 1), (f"{name}(at){domain.replace('.', '(dot)')}", 1)]
    digits = re.sub("[^0-9]", "", s)
    if kind != "card" or len(digits) < 13:
        return []
    grouped = lambda d, mark: mark.join([d[:4], d[4:8], d[8:12], d[12:]])
    wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
    return [(grouped(d, mark), label) for d, label in ((digits, 1), (wrong, 0)) for mark in ".-"]


def settled(batch) -> list[tuple[int, bool, str, int, str, int, int]]:
    """The candidates that a rule settles: a hash, whether the text is held out, kind, label, text, start, end."""
    key = lambda *x: int.from_bytes(hashlib.blake2b(":".join(map(str, x)).encode(errors="replace"), digest_size=7).digest())
    out = []
    for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
        found = [c for c in candidates(text) if c[3] >= 0]
        held = bool(found) and xxhash.xxh3_64_intdigest(text.encode(errors="replace")) % 3 == 0
        for a, b, kind, label in found:
            s = text[a:b]
            out.append((key(i, a, b, kind, s), held, kind, label, text, a, b))
            for new, its in rewritten(s, kind) if label and passes(kind, s) else ():
                before = text[max(0, a - 24) : a]
                out.append((key(i, a, b, kind, new), held, kind, its, before + new + text[b : b + 1], len(before), len(before) + len(new)))
    return out


def fit(docs: DataFrame, max_candidates: int = 20_000, precision: float = 0.98) -> Detector:
    """Trees from at most ``max_candidates`` settled candidates, as many of each kind and label; thresholds from those of all documents.

    A third of the texts, by hash, is held out; of the candidates of the others, those with the smallest hashes of
    each kind and label teach the trees. The scores of all in held-out texts are counted in bins. A kind without a
    threshold that keeps ``precision`` on them adds nothing; neither does a sample without both labels.
    """
    most = max(1, max_candidates // (2 * len(KINDS)))
    seen: dict[tuple[str, int], tuple[list[int], set[int]]] = {}  # a task's smallest hashes; each task has its own copy

    def small(kind: str, label: int, h: int) -> bool:
        heap, own = seen.setdefault((kind, label), ([], set()))
        if h in own or len(heap) == most and h > -heap[0]:
            return False
        own.add(h)
        if len(heap) < most:
            heapq.heappush(heap, -h)
        else:
            own.discard(-heapq.heapreplace(heap, -h))
        return True

    def pick(batch):
        rows = [(h, kind, label, features(text, a, b, kind)) for h, held, kind, label, text, a, b in settled(batch) if not held and small(kind, label, h)]
        h, kind, label, x = zip(*rows, strict=True) if rows else ((), (), (), ())
        return {"h": h, "kind": kind, "label": label, "x": x}

    docs = docs.select("doc_id", "text")
    picked = map_batches(docs, pick, "h long, kind string, label int, x array<double>").groupBy("kind", "label", "h").agg(F.min("x").alias("x"))
    for salt in (F.pmod(F.xxhash64("h"), F.lit(64)), F.lit(0)):  # first by salt: no kind's candidates are one task's work
        picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("kind", "label", salt).orderBy("h"))).where(F.col("n") <= most)
    rows = sorted((r["label"], r["kind"], r["x"]) for r in picked.select("kind", "label", "x").collect())  # bounded by max_candidates
    y, x = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        return Detector()
    model = Boosted().fit(x, y)

    def count(batch):
        held = [c for c in settled(batch) if c[1]]
        p = model.probability(np.array([features(text, a, b, kind) for _, _, kind, _, text, a, b in held])) if held else ()
        counts = Counter((kind, label, int(score * BINS)) for (_, _, kind, label, *_), score in zip(held, p, strict=True))
        kind, label, bin_ = zip(*counts, strict=True) if counts else ((), (), ())
        return {"kind": kind, "label": label, "bin": bin_, "n": list(counts.values())}

    bins = {kind: np.zeros((2, BINS + 1), int) for kind in KINDS}
    for r in map_batches(docs, count, "kind string, label int, bin int, n long").groupBy("kind", "label", "bin").agg(F.sum("n").alias("n")).collect():  # bounded by the bins
        bins[r["kind"]][r["label"], r["bin"]] = r["n"]
    thresholds = {}
    for kind, counted in bins.items():
        wrong, right = np.cumsum(counted[:, ::-1], axis=1)[:, ::-1]  # at the bin and above
        good = np.flatnonzero((counted[1] > 0) & (right >= precision * (right + wrong)))
        if len(good):
            thresholds[kind] = max(good[0] / BINS, 0.5)
    return Detector(model, thresholds)


def said(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """Personal data in whole texts: doc_id, counts of the rules' spans by kind, their hash, and all spans as kind:start:end.

    Positions are code points, ends exclusive. A null text counts as empty and has no spans; a null doc_id stays null.
    Only doc_id and text are read; repeated rows give repeated rows, an empty table none.
    """

    def run(batch):
        many = texts(batch)
        base = [base_spans(t) for t in many]
        everything = [order(b + a) for b, a in zip(base, detector.added(many, base), strict=True)]
        counts = {f"n_{kind}": [sum(s[2] == kind for s in b) for b in base] for kind in KINDS}
        return {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(said(b).encode()).hexdigest() for b in base], "spans": [said(s) for s in everything]}

    return map_batches(docs.select("doc_id", "text"), run, SPANS)


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """The same rows and columns with each span of ``text`` replaced by its kind in brackets; ``n_chars``, if there, follows.

    Spans that overlap go together, under the kind of the first. A null text stays null.
    """

    def clean(text: str, spans) -> str:
        out, at = [], 0
        for start, end, kind in spans:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    names = docs.columns

    def run(batch):
        many = texts(batch)
        base = [base_spans(t) for t in many]
        new = [clean(t, order(b + a)) for t, b, a in zip(many, base, detector.added(many, base), strict=True)]
        valid = batch.column("text").is_valid().to_pylist()
        columns = {c: batch.column(c) for c in names}
        columns["text"] = [t if v else None for t, v in zip(new, valid, strict=True)]
        if "n_chars" in columns:
            columns["n_chars"] = [len(t) if v else n for t, v, n in zip(new, valid, batch.column("n_chars").to_pylist(), strict=True)]
        return columns

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))


