"""Operator 2, quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

A text's figures (shares of character kinds, of repeated and distinct words, word and line lengths) are made in one map
pass and stored. Trusted positives are documents labelled 1, the unlabelled are any documents, both from the learning
part only (crc32 of the id modulo 3 not 1) and about ``SAMPLE`` of each, by the id's digest. The class prior
is estimated from the two by best bins: the least ratio, over thresholds of a first model, of the unlabelled to the
positive share above it. A small network then minimises prior * R+(1) + max(0, R_u(-1) - prior * R+(-1)).

Defined results: null and empty texts have all figures 0 and are scored like others; very long texts are measured whole;
repeated rows get equal scores and count once in a sample; a document with several labels counts once, with the largest;
a score of just 0.5 is predicted 1; without positives or unlabelled every score is 0.5; an empty table gives no rows;
columns other than doc_id and text (and the labels' quality) are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import in_fold, map_rows, sampled, stored, words

SAMPLE, HIDDEN, STEPS, RATE, BATCH = 20_000, 16, 1500, 0.01, 2048
#: Kinds of characters of which the shares are taken.
KINDS = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "symbol", "pipe", "other")


def _kinds() -> np.ndarray:
    out = np.full(65536, KINDS.index("other"), np.uint8)
    for i in range(65536):
        c = chr(i)
        if c.islower():
            out[i] = 0
        elif c.isupper():
            out[i] = 1
        elif c.isdigit():
            out[i] = 2
        elif c.isspace():
            out[i] = 3
    for chars, kind in (("\n", "newline"), (".,;:", "stop"), ("!?", "mark"), ("#*$%&<>@^~=+_\\{}[]", "symbol"), ("|", "pipe")):
        for c in chars:
            out[ord(c)] = KINDS.index(kind)
    return out


def figures(text: str, kinds: np.ndarray) -> list[float]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(kinds[np.minimum(codes, 65535)], minlength=len(KINDS)) / max(1, len(codes))
    w = words(text)
    n = max(1, len(w))
    count = Counter(w)
    lines = [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, w), float, len(w)) if w else np.zeros(1)
    freq = np.fromiter(count.values(), float, len(count)) / n if w else np.ones(1)
    return [
        *share,
        np.log1p(len(w)),
        sizes.mean(),
        sizes.std(),
        min(sizes.max(), 100.0),
        len(count) / n / (1 + 0.1 * np.log1p(n)),
        freq.max(),
        -(freq * np.log(freq)).sum(),
        sum(map(eq, w, w[1:])) / n,
        sum(x[-1] in "!#*$%&|" for x in w) / n,
        sum(x.isupper() for x in w) / n,
        sum(x == "|" for x in w) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the learning part and the figures of every document."""

    def start():
        kinds = _kinds()
        return lambda batch: {"doc_id": batch.column(0), "held_out": batch.column(1), "x": [figures(t.as_py() or "", kinds) for t in batch.column(2)]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id"), 3).alias("held_out"), "text"), "doc_id long, held_out boolean, x array<double>", start)


class Network:
    """One hidden layer of tanh over standardised figures; its output's sigmoid is the score."""

    def __init__(self, x: np.ndarray, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        self.p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.std, -8, 8) @ self.p[0] + self.p[1])

    def out(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.p[2] + self.p[3]

    def update(self, x: np.ndarray, slope: np.ndarray, rate: float = RATE) -> None:
        """An Adam step along the risk's slope in each row's output."""
        z, h = np.clip((x - self.mean) / self.std, -8, 8), self.hidden(x)
        d = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ d + 1e-4 * self.p[0], d.sum(0), h.T @ slope + 1e-4 * self.p[2], slope.sum(keepdims=True)]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] += 0.1 * (g - self.m[i])
            self.v[i] += 0.001 * (g * g - self.v[i])
            self.p[i] -= rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 1) -> float:
    """Best-bin estimate: a model that tells positives from unlabelled is fitted to one half; the other half gives the ratios."""
    draw = np.random.default_rng(seed)
    p, u = pos[draw.permutation(len(pos))], unl[draw.permutation(len(unl))]
    pa_, pb, ua, ub = p[::2], p[1::2], u[::2], u[1::2]
    if min(len(pb), len(ub)) < 10:
        return 0.5
    net = Network(np.concatenate([pa_, ua]), seed)
    for _ in range(STEPS // 3):
        i, j = draw.integers(len(pa_), size=min(BATCH, 4 * len(pa_))), draw.integers(len(ua), size=min(BATCH, 4 * len(ua)))
        x = np.concatenate([pa_[i], ua[j]])
        s = sigmoid(net.out(x))
        net.update(x, np.concatenate([(s[: len(i)] - 1) / len(i), s[len(i) :] / len(j)]))
    sp, su = np.sort(net.out(pb)), np.sort(net.out(ub))
    at = np.quantile(sp, np.linspace(0, 0.95, 96))
    above = lambda s: 1 - np.searchsorted(s, at) / len(s)
    slack = np.sqrt(np.log(40) / 2 / len(sp)) + np.sqrt(np.log(40) / 2 / len(su))
    bound = (above(su) + slack) / above(sp)
    best = int(bound.argmin())
    return float(np.clip(above(su)[best] / above(sp)[best], 0.05, 0.95))


def learn(pos: np.ndarray, unl: np.ndarray, seed: int = 2) -> tuple[Network | None, float]:
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = class_prior(pos, unl)
    net, draw = Network(unl, seed), np.random.default_rng(seed)
    mean = [np.zeros_like(a) for a in net.p]
    for k in range(STEPS):
        i, j = draw.integers(len(pos), size=BATCH), draw.integers(len(unl), size=BATCH)
        x = np.concatenate([pos[i], unl[j]])
        o = net.out(x)
        s, soft = sigmoid(o), np.logaddexp(0, o)  # loss as negative: softplus(o); as positive: softplus(-o)
        sp, su = s[:BATCH], s[BATCH:]
        if soft[BATCH:].mean() - prior * soft[:BATCH].mean() >= 0:
            slope = np.concatenate([prior * (sp - 1) - prior * sp, su]) / BATCH
        else:  # the negative risk is below zero: step back from it
            slope = np.concatenate([prior * sp, -su]) / BATCH
        net.update(x, slope, RATE * (1 - k / STEPS))
        if 2 * k >= STEPS:  # the mean of the second half's weights, as single steps go back and forth around the bound
            mean = [m + 2 * a / STEPS for m, a in zip(mean, net.p, strict=True)]
    net.p = mean
    return net, prior


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = stored(measured(docs), "op2")
    part = x.where(~F.col("held_out"))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    take = lambda d, tag: np.array([list(r.x) for r in sampled(d, SAMPLE, F.lit(tag), F.col("doc_id"), F.xxhash64("x")).select("x").collect()])
    net, prior = learn(take(part.join(good, "doc_id", "left_semi"), "p"), take(part, "u"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        net = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            v = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            s = sigmoid(net.out(v)) if net else np.full(batch.num_rows, 0.5)
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return step

    return map_rows(x, "doc_id long, held_out boolean, score double, predicted int", start)
