"""Personal data: exact base patterns, and boosted trees that add spans which look like them.

Base patterns of four kinds (email, ip, card, phone) always stand. High-recall generators propose further, overlapping
spans: mail addresses with a bracketed at or dot, telephone numbers without a leading plus, card numbers with unusual
separators, addresses with bracketed dots. Gradient-boosted trees score each from its format (digits, groups,
separators, checksum) and its context (words and characters beside it); Platt scaling turns scores into probabilities and
a threshold for each kind, set on examples held out of training to a stated precision, selects what is added. Of
overlapping ones the likeliest stays, and none overlaps a base span.

No table marks personal data, so the trees are trained on labelled examples that `examples` writes from format rules
with a fixed seed: numbers and addresses in use against dates, amounts, versions, codes and identifiers.

Defined results: a null text is an empty one and has no spans; offsets count code points; repeated rows give repeated
results; an empty table gives no rows; other columns of the input are ignored or carried, as asked.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.textvec import tidy

KINDS = ("email", "ip", "card", "phone")
#: Without one of these a text has neither a base span nor a candidate.
TRIGGER = r"[0-9@]|[\(\[\{] ?(?i:at|dot) ?[\)\]\}]"
PRECISION = 0.99

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the base mail pattern, found from their @ so that long runs cost no more than their length."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            pos = m.end()
            at = text.find("@", pos)
        else:
            pos = at + 1
            at = text.find("@", pos)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- candidates ----

_AT, _DOT = r"(?: ?[(\[{] ?(?i:at) ?[)\]}] ?|@| (?i:at) )", r"(?: ?[(\[{] ?(?i:dot) ?[)\]}] ?|\.| (?i:dot) )"
_GENERATORS = (
    (0, re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9.])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){13,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![\w.,+/-])(?:00|\+)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w/]|[.,-][0-9])")),
)
_OBFUSCATED = re.compile(r"[(\[{] ?(?i:at|dot) ?[)\]}]")
#: Words that stand before a number or address of each kind, and words that stand before other numbers.
CUES = (
    ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    ("ip", "host", "address", "server", "client", "from", "addr"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telephone", "teléfono", "handy", "whatsapp", "sms"),
)
OTHER_CUES = ("order", "invoice", "version", "no", "nr", "id", "isbn", "page", "pages", "date", "section", "serial", "ref", "part", "total", "on", "in", "since", "code", "sku")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that might be personal data beside the base spans; they may overlap."""
    out = []
    for kind, pattern in _GENERATORS:
        if kind == 0 and not _OBFUSCATED.search(text):  # no match can hold one
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if kind or _OBFUSCATED.search(m[0])]
    return out


_WORD = re.compile(r"[^\W\d_][\w-]*")


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-3:]]
    after = text[end : end + 1]
    lens = [len(g) for g in groups]
    return [
        kind, len(s), len(digits), len(groups), max(lens, default=0), min(lens, default=0), lens[-1] if lens else 0, lens[0] if lens else 0,
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), s.startswith(("0", "(0")), s.startswith(("00", "+")),
        len(digits) >= 12 and luhn(digits), len(set(digits)), any(w in CUES[kind] for w in before), any(w in OTHER_CUES for w in before),
        any(w in c for w in before for c in CUES), sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups), sum(len(g) == 2 and int(g) <= 31 for g in groups),
        bool(_OBFUSCATED.search(s)), all(int(g) <= 255 for g in groups) if groups and max(lens) <= 3 else False, text[start - 1 : start] in "$€£#%=:", after in "%€$:" and after != "", sum(c.isalpha() for c in s),
    ]


def examples(seed: int = 11, rows: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of `rows` written examples, half of them personal data."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + n(r.choice([13, 14, 14, 14]))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def positive() -> tuple[int, str, str]:
        k = r.randrange(4)
        if k == 0:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("{at}", "."), (" (at) ", ".")])
            return k, f"{word()}{r.choice(['.', '_', ''])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", r.choice(CUES[0])
        if k == 1:
            return k, r.choice(["[.]", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4)), r.choice(CUES[1])
        if k == 2:
            d, sep = card(), r.choice([".", "_", "  ", " - "[:2], "/"])
            return k, sep.join(d[i : i + 4] for i in range(0, len(d), 4)), r.choice(CUES[2])
        form = r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"])
        if r.random() < 0.5:
            return k, form.format(n(3), n(3), n(4)), r.choice(CUES[3])
        return k, r.choice(["0{} {} {}", "0{}/{}{}", "00{} {} {}", "0{}-{}-{}"]).format(n(r.randint(1, 3)), n(r.randint(3, 4)), n(r.randint(3, 4))), r.choice(CUES[3])

    def negative() -> tuple[int, str, str]:
        cue = r.choice(OTHER_CUES) if r.random() < 0.7 else word()
        pick = r.randrange(10)
        if pick == 0:
            return 3, f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}", cue
        if pick == 1:
            return 3, f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", cue
        if pick == 2:
            return 3, f"{n(r.randint(1, 4))} {n(r.randint(2, 5))}" + (f" {n(3)}" if r.random() < 0.5 else ""), cue
        if pick == 3:
            return 3, f"{r.choice(['978', '979'])}-{n(1)}-{n(4)}-{n(4)}-{n(1)}".replace("-" + n(1), "-12", 1), r.choice(["isbn", cue])
        if pick == 4:
            return 2, n(r.randint(14, 19)), cue
        if pick == 5:
            d = n(16)
            return 2, r.choice([".", "/", "_"]).join(d[i : i + 4] for i in range(0, 16, 4)), cue
        if pick == 9:
            d = card() if r.random() < 0.5 else n(16)
            return 3, r.choice([" ", "-"]).join(d[i : i + 4] for i in range(0, len(d), 4)), r.choice((cue, *CUES[2]))
        if pick == 6:
            return 1, " . ".join(str(r.randint(0, 40)) for _ in range(4)), cue
        if pick == 7:
            return 0, f"{word()} [at] {word()}.{word()}" if r.random() < 0.3 else f"{word()} at {word()} dot {word()}", cue
        return 3, f"{n(r.randint(1, 3))}/{n(r.randint(2, 4))}/{n(r.randint(2, 4))}", cue

    xs, ys = [], []
    for i in range(rows):
        kind, s, cue = positive() if i % 2 else negative()
        keep = r.random() < (0.75 if i % 2 else 1)
        before = f"{word()} {cue if keep else word()}{r.choice([' ', ': ', ' ', ' is '])}"
        text = f"{before}{s}{r.choice([' ', '.', ', '])}{word()}"
        xs.append(features(text, len(before), kind, len(before) + len(s)))
        ys.append(i % 2)
    return np.array(xs, float), np.array(ys, float)


# ---- boosted trees ----


class Boosted:
    """Logistic gradient boosting with small regression trees and Platt scaling."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 20):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.model: list[list] = []
        self.scale = (1.0, 0.0)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> list | float:
        if depth and len(g) >= 2 * self.least:
            whole = g.sum() ** 2 / (h.sum() + 1)
            best = (1e-6, -1, 0.0)
            for j in range(x.shape[1]):
                o = np.argsort(x[:, j], kind="stable")
                v, gs, hs = x[o, j], np.cumsum(g[o]), np.cumsum(h[o])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut >= self.least - 1) & (cut < len(g) - self.least)]
                if len(cut):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
            if best[1] >= 0:
                low = x[:, best[1]] <= best[2]
                return [best[1], best[2], self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)]
        return float(self.rate * g.sum() / (h.sum() + 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        f = np.zeros(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.model.append(tree)
            f += np.array([_leaf(tree, row) for row in x])
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        f, (a, b) = self.raw(x), self.scale
        for _ in range(50):  # Newton steps of a logistic fit of one input
            p = 1 / (1 + np.exp(-(a * f + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((y - p) * f).sum(), (y - p).sum()])
            hess = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale = (float(a), float(b))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.array([sum(_leaf(t, row) for t in self.model) for row in x])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))


def _leaf(tree, row) -> float:
    while isinstance(tree, list):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(4)
def detector(precision: float = PRECISION, seed: int = 11) -> tuple[Boosted, tuple[float, ...]]:
    """The trained trees and a threshold for each kind that gives at least this precision on held-out examples."""
    x, y = examples(seed)
    fold = np.arange(len(y)) // 2 % 3
    model = Boosted().fit(x[fold == 0], y[fold == 0]).calibrate(x[fold == 1], y[fold == 1])
    p, kinds, truth = model.probability(x[fold == 2]), x[fold == 2, 0], y[fold == 2]
    cut = []
    for k in range(len(KINDS)):
        q, t = p[kinds == k], truth[kinds == k]
        good = [c for c in np.linspace(0.5, 0.99, 50) if t[q >= c].sum() >= precision * max(1, (q >= c).sum())]
        cut.append(float(max(0.9, min(good, default=1.1))))
    return model, tuple(cut)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Boosted, cut: tuple[float, ...]) -> list[tuple[int, int, int]]:
    found = _free(candidates(text), base)
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found], float))
    out: list[tuple[int, int, int]] = []  # in order of their starts; none overlaps another
    for i in np.lexsort(([c[0] for c in found], -p)):
        c = found[i]
        at = bisect.bisect(out, c)
        if p[i] >= cut[c[1]] and not (at and out[at - 1][2] > c[0]) and not (at < len(out) and out[at][0] < c[2]):
            out.insert(at, c)
    return out


def _free(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span."""
    starts = np.array([a for a, _, _ in base])
    ends = np.maximum.accumulate(np.array([b for _, _, b in base]))
    at = np.searchsorted(starts, [c[2] for c in found])
    return [c for c, i in zip(found, at, strict=True) if not i or ends[i - 1] <= c[0]]


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping ones the first in order."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _find(model: Boosted, cut: tuple[float, ...], at: str, own: str | None = None):
    """Spans of the texts in column `at`, which goes; with `own`, redacted texts too, under names that begin with it."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            for cell in b.column(b.schema.get_field_index(at)):
                text = cell.as_py()
                base = base_spans(text) if text else []
                more = added_spans(text, base, model, cut) if text else []
                spans = sorted(base + more)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(spell(base).encode()).hexdigest() if base else empty, spell(spans), len(more)))
                if own:
                    texts.append(redacted(text, spans) if spans else None)
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            out = [pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)]
            kept = [i for i, n in enumerate(b.schema.names) if n != at]
            yield pa.record_batch([b.column(i) for i in kept] + out + ([pa.array(texts, pa.string())] if own else []), names=[b.schema.names[i] for i in kept] + ([f"{own}{n}" for n in [*_NAMES, "text"]] if own else _NAMES))

    return tidy(run)


_NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
_TYPES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, *, precision: float = PRECISION) -> DataFrame:
    """doc_id, numbers of base spans of each kind, base_sha256, spans (all) and n_added of every row (doc_id, text).

    A text without digit, @ or bracketed "at" or "dot" has no span; the check is native and such texts stay in the JVM.
    """
    model, cut = detector(precision)
    suspect = F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("_suspect")
    return docs.select("doc_id", suspect).mapInArrow(_find(model, cut, "_suspect"), f"doc_id long, {_TYPES}")


def redact_pii(docs: DataFrame, *, precision: float = PRECISION) -> DataFrame:
    """`docs` (any columns, with text) with every span of its texts replaced by its kind; n_chars, where it is, follows."""
    model, cut = detector(precision)
    names = docs.columns
    own = "_pii_"
    while any(n.startswith(own) for n in names):
        own += "_"
    suspect = F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias(f"{own}suspect")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.select("*", suspect).mapInArrow(_find(model, cut, f"{own}suspect", own), f"{ddl}, {', '.join(own + t for t in _TYPES.split(', '))}, {own}text string")
    out = out.withColumn("text", F.coalesce(f"{own}text", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(f"{own}text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
