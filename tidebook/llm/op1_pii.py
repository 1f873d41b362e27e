"""Operator 1, personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base spans come from four patterns, each matched in linear time. The field labels words with B-/I- tags of the four
kinds, of secrets (tokens, keys, passwords) and of street addresses. It is trained on a small labelled table (``words``
and ``tags``, a row a sentence): the caller's, or else one written by rule from the forms below, with plain numbers
(years, versions, prices) as counter-examples; about ``LABELLED`` rows of it at most. Words with a digit, ``@`` or ``+``
and ``CONTEXT`` words on either side of them are labelled; the rest of a text is O, so that it falls into independent
stretches, which are decoded whole by Viterbi in numpy batches. What the field finds beside the base spans is added;
base spans stay as they are. Personal names have no such word and are not searched for.

Defined results: null and empty texts have no spans; very long texts, words and runs of numbers are searched whole;
starts and ends count code points; of equally good labellings the one with the earlier labels counts; repeated rows are
each searched; an empty table gives no rows; with an empty labelled table nothing is added; columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import map_rows, sampled

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "address")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
LABELLED, SENTENCES, CONTEXT, FEATURES = 5000, 480, 3, 8192
EPOCHS, RATE, L2 = 90, 0.1, 1e-4
#: Words that are decoded at once: their scores bound the memory.
CELLS = 32_768
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TELLING = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    twice = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(twice)))) % 10 == 0


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in four):
                out.append(("ip", start, end))
            start = end + 1
    return out


def cards(text: str) -> list[Span]:
    found = ((m, m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text))
    return [("card", m.start(), m.end()) for m, d in found if 12 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str | None) -> list[Span]:
    if not text or not _TELLING.search(text):
        return []
    return in_order(emails(text) + ips(text) + cards(text) + (phones(text) if "+" in text else []))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# the labelled table

#: What stands before an entity, words of streets, and numbers that are no personal data.
CUES = {
    "email": ("write to", "mail", "contact:", "e-mail", ""),
    "ip": ("from host", "address", "server", "ip", ""),
    "card": ("card", "paid with", "card number:", "visa", ""),
    "phone": ("call", "phone:", "tel.", "fax", ""),
    "secret": ("token =", "token:", "api key", "password =", "secret:", "key =", "token ="),
    "address": ("lives at", "office:", "at", "visit us at", ""),
}
STREETS = ("Street", "Road", "Avenue", "Lane", "Square", "Drive", "St.", "Ave.")
PLAIN = (
    "version 2.0", "Version 3.", "BY 4.0.", "License 2.1", "in 2021", "since 1998,", "12 items", "3.5 percent", "at 10:30", "$19.99", "1,200 people",
    "page 42", "No. 7", "chapter 12.", "2021-05-14", "order 4711", "release v1.2.3", "10 000", "ISO 9001", "the 1990s", "5kg", "A4 paper", "H2O", "item 123456",
    "about 30", "3-4 days", "100%", "section 2.3.1", "7th", "room 12b", "1/2", "(1)", "[23]", "x2", "commit 9fceb02",
)


def labelled_table(n: int = SENTENCES, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Sentences as (words, tags), made by rule: invented words around an entity or two and plain numbers."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    pick = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))
    hexa, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick("etaoinshrdluäéñ", draw.randint(1, 9))
    some = lambda *makers: draw.choice(makers)()
    mixed = letters + letters.upper() + "0123456789"
    make = {
        "email": lambda: f"{word()}{draw.choice(['', '.', '_'])}{draw.choice(['', digits(2), word()])}@{pick(letters, 5)}{draw.choice(['', digits(1)])}.{draw.choice(['example.com', 'net', 'co.uk', 'org'])}",
        "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "card": lambda: some(lambda: digits(16), lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)), lambda: f"3{digits(3)} {digits(6)} {digits(5)}"),
        "phone": lambda: some(
            lambda: f"+{draw.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"+{draw.randint(1, 99)} {digits(2)} {digits(4)} {digits(4)}",
            lambda: f"+{draw.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}",
        ),
        "secret": lambda: some(
            lambda: f'"{pick(hexa, 40)}"',
            lambda: f'"{pick(hexa, draw.choice([32, 40, 64])).upper()}"',
            lambda: pick(hexa, draw.choice([32, 40, 64])),
            lambda: f"AKIA{pick(letters.upper() + '0123456789', 16)}",
            lambda: f"{draw.choice(['sk-', 'ghp_', 'pat-'])}{pick(mixed, 36)}",
            lambda: f'"{pick(mixed, draw.randint(18, 30))}{digits(2)}"',
        ),
        "address": lambda: some(
            lambda: f"{draw.randint(1, 250)} {word().capitalize()} {draw.choice(STREETS)}",
            lambda: f"{word().capitalize()}straße {draw.randint(1, 99)}",
            lambda: f"{draw.randint(1, 99)} rue {draw.choice(['de', 'du'])} {word().capitalize()}",
            lambda: f"Calle {word().capitalize()} {draw.randint(1, 99)}",
        ),
    }
    tails = ("", "", "", "", ",", ".", "!!", "###", "%%%", "***")
    out = []
    for i in range(n):
        own, tags = [], []

        def plain(text: str, own=own, tags=tags) -> None:
            for w in text.split():
                own.append(w + draw.choice(tails) if draw.random() < 0.2 else w)
                tags.append("O")

        for kind in draw.sample((*KINDS, None, None, None), 1 + i % 3):
            plain(" ".join(word() for _ in range(draw.randint(1, 4))))
            if kind is None:
                plain(draw.choice(PLAIN))
                continue
            plain(draw.choice(CUES[kind]))
            parts = make[kind]().split()
            parts[-1] += draw.choice(tails)
            own += parts
            tags += [f"{'I' if k else 'B'}-{kind}" for k in range(len(parts))]
        plain(" ".join(word() for _ in range(draw.randint(0, 3))))
        upper = draw.random() < 0.1
        out.append(([w.upper() for w in own] if upper else own, tags))
    return out


# the field


def kind_of_char(c: str) -> str:
    return "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c


def shape(word: str) -> str:
    """Letters as X or x, runs as one; digits as d with the length of their run; other characters as they are. Many changes: their number only."""
    out, n = [], 0
    for c in [*map(kind_of_char, word[:200]), ""]:
        if c == "d":
            n += 1
            continue
        if n:
            out.append(f"d{min(n, 20)}")
            n = 0
        if c and (not out or out[-1] != c):
            out.append(c)
    return "".join(out) if len(out) <= 9 else f"mixed{len(out) // 4}"


def coarse(word: str) -> str:
    if not word:
        return "edge"
    if "@" in word:
        return "at"
    return ("plus" if "+" in word else "") + ("digits" if _TELLING.search(word) else "Word" if word[0].isupper() else "word")


def features(word: str, before: str, after: str) -> list[int]:
    """Hashed names of a word's features; always as many."""
    core = word.strip(".,;:!?\"'#%*$&")
    s, digits, low = shape(core), sum(c.isdigit() for c in core[:200]), core.lower()
    size = min(len(core), 60) // 6
    hexa = bool(core) and not low[:80].strip("0123456789abcdef")
    cue = before.strip("\"'").lower()[:12]
    names = (
        f"s={s}", f"n={min(digits, 20)}", f"f={kind_of_char(word[0])}", f"dots={min(core.count('.'), 5)},{'@' in core},{'+' in core}",
        f"b={coarse(before)},{s[:2]}", f"a={coarse(after)},{s[:2]}", f"bs={shape(before)[:12]}", f"size={size},{hexa},{digits > 2}", f"cue={cue},{digits > 0}", f"end={low[-5:]}", "1",
    )
    return [crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


def stretches(text: str) -> list[list[re.Match]]:
    """Runs of words that may be part of an entity, with ``CONTEXT`` plain words on either side."""
    all_words = list(_WORD.finditer(text))
    out, end = [], 0
    for i, m in enumerate(all_words):
        if not _TELLING.search(m[0]):
            continue
        upto = min(i + CONTEXT + 1, len(all_words))
        if out and i - CONTEXT <= end:
            out[-1].extend(all_words[end:upto])
        else:
            out.append(all_words[max(0, i - CONTEXT) : upto])
        end = upto
    return out


def rows_of_words(own: list[str]) -> list[list[int]]:
    line = ["", *own, ""]
    return [features(line[i], line[i - 1], line[i + 1]) for i in range(1, len(line) - 1)]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


class Field:
    """Weights of features by label, and of steps between labels."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.w, self.step = np.zeros((FEATURES, n)), np.zeros((n, n))
        # an inside tag follows a tag of its own kind only
        self.allowed = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])
        self.first = np.array([x[0] != "I" for x in LABELS])
        self.trained = False

    def train(self, rows: list[tuple[list[list[int]], list[int]]]) -> None:
        """Full-batch AdaGrad on the conditional log-likelihood, by forward and backward sums over padded windows."""
        rows = [r for r in rows if r[0]]
        if not rows:
            return
        n, t, k, lab = len(rows), max(len(r[1]) for r in rows), len(rows[0][0][0]), len(LABELS)
        x, y, real = np.zeros((n, t, k), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (f, tags) in enumerate(rows):
            x[i, : len(tags)], y[i, : len(tags)], real[i, : len(tags)] = f, tags, True
        square_w, square_s, at = np.full_like(self.w, 1e-6), np.full_like(self.step, 1e-6), np.arange(n)
        true_w, true_s = np.zeros_like(self.w), np.zeros_like(self.step)
        np.add.at(true_w, (x[real], y[real][:, None]), 1)
        both = real[:, 1:]
        np.add.at(true_s, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(EPOCHS):
            e = self.w[x].sum(2)
            step = np.where(self.allowed, self.step, -30.0)
            alpha, beta = np.empty((n, t, lab)), np.zeros((n, t, lab))
            alpha[:, 0] = e[:, 0] + np.where(self.first, 0, -30.0)
            for j in range(1, t):
                a = log_sum(alpha[:, j - 1, :, None] + step, 1) + e[:, j]
                alpha[:, j] = np.where(real[:, j, None], a, alpha[:, j - 1])
            for j in range(t - 2, -1, -1):
                b = log_sum(step + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where(real[:, j + 1, None], b, 0)
            z = log_sum(alpha[at, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None])
            grad_w, grad_s = true_w - L2 * n * self.w, true_s - L2 * n * self.step
            np.add.at(grad_w, x[real], -p[real][:, None, :])
            for j in range(1, t):
                q = np.exp(alpha[:, j - 1, :, None] + step + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None])
                grad_s = grad_s - q[real[:, j]].sum(0)
            square_w += grad_w**2
            square_s += grad_s**2
            self.w += RATE * grad_w / np.sqrt(square_w)
            self.step += RATE * grad_s / np.sqrt(square_s)
        self.trained = True

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """A run's words' scores by label."""
        return np.concatenate([self.w[np.array(rows[i : i + 4096])].sum(1) for i in range(0, len(rows), 4096)])

    def decode(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each run of feature rows (Viterbi); runs of like length, ``CELLS`` words at most or one run, go through the steps together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        step, lo = np.where(self.allowed, self.step, -1e9), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(runs[order[hi]]) <= CELLS:
                hi += 1
            own = order[lo:hi]
            lo, t = hi, len(runs[own[-1]])
            e = np.zeros((len(own), t, len(LABELS)))
            for a, i in enumerate(own):
                e[a, : len(runs[i])] = self.scores(runs[i])
            size = np.array([len(runs[i]) for i in own])
            score, back = e[:, 0] + np.where(self.first, 0, -1e9), np.zeros((len(own), t, len(LABELS)), np.int8)
            for j in range(1, t):
                by = score[:, :, None] + step
                back[:, j] = by.argmax(1)
                score = np.where((j < size)[:, None], by.max(1) + e[:, j], score)
            best = score.argmax(1)
            for a, i in enumerate(own):
                path, tag = np.zeros(size[a], np.int64), best[a]
                for j in range(size[a] - 1, -1, -1):
                    path[j] = tag
                    tag = back[a, j, tag]
                out[i] = path
        return out


def entities(run: list[re.Match], tags: np.ndarray) -> list[Span]:
    """Spans of the tags, without punctuation at their ends; those without a digit, ``@`` or ``+`` are none."""
    out, spans = [], []
    for m, tag in zip(run, tags, strict=True):
        if not tag:
            continue
        lead = len(m[0]) - len(m[0].lstrip("\"'.,;:!?<[{|*#$%&"))
        tail = len(m[0].rstrip("\"'.,;:!?>]}|*#$%&"))
        if LABELS[tag][0] == "B":
            spans.append([LABELS[tag][2:], m.start() + lead, m.start() + tail, False])
        spans[-1][2] = m.start() + tail
        spans[-1][3] |= bool(_TELLING.search(m[0]))
    for kind, a, b, telling in spans:
        if telling and a < b:
            out.append((kind, a, b))
    return out


def beside(found: list[Span], base: list[Span]) -> list[Span]:
    """The found spans that overlap no base span."""
    covered: list[list[int]] = []  # the base spans' union, apart and in order
    for _, a, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    out = []
    for s in found:
        k = bisect_left(starts, s[2]) - 1  # the last that starts before the span's end
        if k < 0 or covered[k][1] <= s[1]:
            out.append(s)
    return out


def trained(labelled: DataFrame | None = None) -> Field:
    """A field trained on the labelled table (words array<string>, tags array<string>)."""
    field = Field()
    rows = labelled_table()
    if labelled is not None:
        rows = [(list(r.words), list(r.tags)) for r in sampled(labelled, LABELLED, F.array_join("words", " ")).collect()]
    field.train(sorted((rows_of_words(w), [LABELS.index(t) for t in tags]) for w, tags in rows))
    return field


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans, and how many there are, the field added, and are secrets or addresses."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def start():
        field = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            runs = [(i, r) for i, t in enumerate(texts) if field.trained and _TELLING.search(t) for r in stretches(t)]
            more: list[list[Span]] = [[] for _ in texts]
            for (i, run), tags in zip(runs, field.decode([rows_of_words([m[0] for m in r]) for _, r in runs]), strict=True):
                if tags.any():
                    more[i] += entities(run, tags)
            more = [beside(m, b) for m, b in zip(more, base, strict=True)]
            every = [b + m for b, m in zip(base, more, strict=True)]
            n = lambda kind, spans: [sum(s[0] == kind for s in x) for x in spans]
            return {
                "doc_id": batch.column(0),
                **{f"n_{k}": n(k, base) for k in BASE},
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(in_order(x)) for x in every],
                "n_spans": [len(x) for x in every],
                "n_added": [len(x) for x in more],
                "n_secret": n("secret", more),
                "n_address": n("address", more),
            }

        return step

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long, n_added long, n_secret long, n_address long", start)


def score(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    return find(docs, trained(labelled))
