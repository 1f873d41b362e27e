"""Operator 3, language-model scoring: a gated recurrent network with a class-factored softmax, in numpy.

Tokens are the text's words, A-Z in lower case, and one end. Counts of all tokens of the learning part (crc32 of the
id modulo 5 not 1) are exact; they give the base score and carry the network's open vocabulary. The network predicts
one of the ``SHORTLIST`` most frequent tokens, or a kind of rare word (by its last two letters); a rare word then has
its kind's probability times its share of the kind's smoothed counts. Output is factored: first a class of symbols of
about equal count, then the symbol in its class. Training is truncated backpropagation over all tokens of the learning
part, in two steps. A start is made on the driver from about ``START_TOKENS`` tokens: windows of ``START_WINDOW`` tokens,
drawn by digest from all windows of all learning texts. From there tasks of about ``TASK_TOKENS`` tokens each train a copy
of their own over all learning texts, dealt and ordered by digest, and the weights' mean, weighted by tokens and taken in
Spark, is the network. So neither file layout nor order of rows matters, as long as the count of tasks stays. Scoring carries the
state through a whole document, window by window.

Scoring packs documents into lanes that step together. The most frequent ``KNOWN`` tokens travel with the model; the
others of a document are joined with the counts in Spark.

Defined results: null and empty texts are one end token; very long texts are scored whole, in memory of their own size;
repeated rows are scored each, and are drawn for training once; ties in the counts go by the token; without learning
documents every token has base probability 1 (N and V are 0), and the network stays untrained; an empty table gives no
rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import in_fold, md5_int, most_frequent, stored, words

END = ""  # no word is empty
SHORTLIST, KINDS, CLASSES, HIDDEN = 2000, 96, 48, 32
KNOWN, COUNT_WORDS = 200_000, 200_000
START_TOKENS, START_WINDOW = 600_000, 256
#: Of the training over all texts: tokens of a task and of a block in memory, lanes of a block, numbers of a row of weights.
TASK_TOKENS, BLOCK, WIDE, ROW = 2_000_000, 1 << 17, 1024, 4096
LANES, WINDOW, BPTT, RATE = 512, 32, 16, 0.01
#: Of the work in memory: bytes of text that are split at once, and states whose classes are scored at once.
PIECE, AT_ONCE = 1 << 23, 4096
#: Rows of a symbol that are added up one by one; more of them as a product.
OFTEN = 12
LN10 = np.log(10)


def tokens(text: str | None) -> list[str]:
    """Words with A-Z in lower case (bytes lower only those), then the end."""
    return [*words((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")), END]


def byte_tokens(text: bytes | None) -> list[bytes]:
    """The same tokens in UTF-8: bytes are lowered in A-Z only, and split at the six blanks only."""
    return [*(text or b"").lower().split(), b""]


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of some texts of about PIECE bytes each; a longer text is one of its own."""
    upto, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts in a row, where they stand among all tokens (a text's last is its end), and each text's number of tokens: those of byte_tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    word = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blanks at a text's ends split off empty ones
    upto = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
    size = np.diff(upto) + 1
    at = np.ones(size.sum(), bool)
    at[np.cumsum(size) - 1] = False
    return flat.filter(pa.array(word)), np.flatnonzero(at), size


def rare_kind(word: str) -> int:
    return crc32(word[-2:].encode("utf-8", "surrogatepass")) % KINDS


def token_counts(docs: DataFrame) -> DataFrame:
    """w, n: how often each token occurs in the learning part, over all of it."""

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                toks, _, size = split_tokens(piece)
                toks = toks.dictionary_encode()
                n = np.bincount(toks.indices.to_numpy(), minlength=len(toks.dictionary))
                parts.append(pa.table({"w": pa.concat_arrays([toks.dictionary, pa.array([END])]), "n": pa.array([*n, len(size)], pa.int64())}))
                held += len(n)
                if held > COUNT_WORDS:
                    yield from pa.concat_tables(parts).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"]).to_batches()
                    parts, held = [], 0
        if parts:
            yield from pa.concat_tables(parts).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"]).to_batches()

    part = docs.where(~in_fold(F.col("doc_id"), 5)).select("text")
    return part.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def gated(a: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step of the gated unit, a row a lane: the new state. a, the inputs' parts, turns into the gates; g holds the state's parts."""
    s, n = a[:2], a[2]
    s += g[:2]
    s *= np.float32(0.5)
    np.tanh(s, out=s)
    s *= np.float32(0.5)
    s += np.float32(0.5)
    n += s[0] * g[2]
    np.tanh(n, out=n)
    new = h - n
    new *= s[1]
    new += n
    return new


def exp_sums(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row of scores and its sum; scores are shifted by their row's largest, in place, only where exp could leave its range."""
    if len(e) and not (e.max() < 60 and e.min() > -60):
        e -= e.max(1, keepdims=True)
    q = np.exp(e)
    return q, q @ np.ones((q.shape[1], 1), q.dtype)


class Model:
    """Vocabulary, smoothed counts and the network's weights. Symbols: the shortlist by count, then the kinds of rare words."""

    def __init__(self, top: list[tuple[str, int]], total: int, distinct: int, kind_mass: np.ndarray) -> None:
        self.total, self.distinct = total, distinct
        self.slot = 0.5 / (total + 0.5 * (distinct + 1))
        self.index = {w.encode("utf-8", "surrogatepass"): i for i, (w, _) in enumerate(top)}
        self.log_base = np.log10([self.base(n) for _, n in top]) if top else np.zeros(0)
        short = min(SHORTLIST, len(top))
        self.symbol = np.array([*range(short), *(short + rare_kind(w) for w, _ in top[short:])], np.int32)
        self.short = short
        self.log_kind = np.log10(kind_mass + self.slot)
        mass = np.concatenate([[self.base(n) for _, n in top[:short]], kind_mass + self.slot])
        order = np.argsort(-mass, kind="stable")
        upto = np.cumsum(np.sqrt(mass[order]))
        of = np.minimum((upto / upto[-1] * CLASSES).astype(int), CLASSES - 1)
        _, of = np.unique(of, return_inverse=True)
        self.cls, self.members = np.zeros(len(mass), np.int32), [order[of == c] for c in range(of.max() + 1)]
        self.place = np.zeros(len(mass), np.int32)
        for c, m in enumerate(self.members):
            self.cls[m], self.place[m] = c, np.arange(len(m))
        draw, h, f = np.random.default_rng(11), HIDDEN, np.float32
        w = lambda *shape: draw.normal(0, 0.1, shape).astype(f)
        # by gate: input rows by symbol (the last: a document's start), recurrent weights and biases; output weights, whose biases start at the counts
        gates = lambda a: np.ascontiguousarray(a.reshape(-1, 3, h).transpose(1, 0, 2))
        self.p = {"x": gates(w(len(mass) + 1, 3 * h)), "u": gates(w(h, 3 * h)), "b": np.zeros((3, h), f), "c": w(h, len(self.members)), "cb": np.log([mass[m].sum() for m in self.members]).astype(f)}
        for c, m in enumerate(self.members):
            self.p[f"w{c}"], self.p[f"d{c}"] = w(h, len(m)), np.log(mass[m]).astype(f)

    def frequent(self) -> pa.Array:
        """The shortlist's words, in order of their symbols."""
        return pa.array(list(self.index)[: self.short], pa.binary()).cast(pa.string())

    @property
    def end(self) -> int:
        """The symbol of a text's end."""
        at = self.index.get(b"", -1)
        return int(self.symbol[at]) if at >= 0 else self.short + rare_kind(END)

    def base(self, n: int) -> float:
        return (n + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def inputs(self) -> np.ndarray:
        """What each symbol adds to the gates."""
        return self.p["x"] + self.p["b"][:, None]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray]:
        """One step of the gated unit: the new state."""
        return (gated(np.take(self.inputs(), x, axis=1), h @ self.p["u"], h),)

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each symbol y after state h; with grads, also the slope by h of the negative sum.

        Rows go in order of class, so that each class is a slice; scores have a column a row, so that numpy's loops are long.
        """
        p, c = self.p, self.cls[y]
        order = np.argsort(c.astype(np.int16), kind="stable")
        c, place = c[order], self.place[y[order]]
        hs, out = np.take(h, order, axis=0), np.zeros(len(y), np.float32)
        dh = None if grads is None else np.zeros_like(hs)
        ends = np.cumsum(np.bincount(c, minlength=len(self.members))).tolist()
        # classes by stretches that stay in the cache, then symbols by class
        parts = [("c", "cb", c, lo, min(lo + AT_ONCE, len(y))) for lo in range(0, len(y), AT_ONCE)]
        parts += [(f"w{k}", f"d{k}", place, lo, hi) for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if lo < hi]
        for weights, bias, goal, lo, hi in parts:
            own, at = hs[lo:hi], (goal[lo:hi], np.arange(hi - lo))
            e = p[weights].T @ own.T
            e += p[bias][:, None]
            q, total = exp_sums(e.T)
            out[lo:hi] += e[at] - np.log(total[:, 0])
            if grads is not None:
                q /= total
                q.T[at] -= 1
                grads[weights] += own.T @ q
                grads[bias] += q.sum(0)
                dh[lo:hi] += q @ p[weights].T
        back = np.empty_like(order)
        back[order] = np.arange(len(y))
        return out[back], None if grads is None else np.take(dh, back, axis=0)

    def train(self, docs: list[np.ndarray], starts: list[bool] | None = None) -> None:
        """Adam over windows of BPTT steps, with a rate that falls to a tenth; the state goes on from window to window, its slope doesn't.

        starts: whether each is a document from its start; the first symbol of another is read, not predicted.
        """
        Training(self).fit(docs, starts, 64, lambda done: RATE * (1 - 0.9 * done))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's symbols. Lanes hold documents in a row; a lane's state starts anew with each."""
        out, start = np.zeros(len(docs)), len(self.cls)
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        n = min(LANES, len(docs))
        lanes, size = [[] for _ in range(n)], np.zeros(n, np.int64)
        for i in order:
            k = int(size.argmin())
            lanes[k].append(i)
            size[k] += len(docs[i])
        by = np.argsort(-size, kind="stable")
        lanes, size = [lanes[k] for k in by], size[by]
        # each lane in its own length; a step sees one window of the lanes that are still live
        syms = [np.concatenate([docs[i] for i in own]) for own in lanes]
        docs_of = [np.repeat(np.array(own, np.int32), [len(docs[i]) for i in own]) for own in lanes]
        h, before, of_before = np.zeros((n, HIDDEN), np.float32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        table, u = self.inputs(), self.p["u"]
        for lo in range(0, int(size.max(initial=0)), WINDOW):
            live = int(np.searchsorted(-size, -lo))  # lanes that are longer than lo
            width = int(min(WINDOW, size[0] - lo))
            sym, doc = np.zeros((live, width), np.int32), np.full((live, width), -1, np.int32)
            for k in range(live):
                part = slice(lo, lo + width)
                m = len(syms[k][part])
                sym[k, :m], doc[k, :m] = syms[k][part], docs_of[k][part]
            # a row a step; what lies beyond a lane's end is read and left out
            sym, doc = np.ascontiguousarray(sym.T), np.ascontiguousarray(doc.T)
            first = doc != np.concatenate([of_before[None, :live], doc[:-1]])
            x = np.where(first, start, np.concatenate([before[None, :live], sym[:-1]]))
            h, states = h[:live], np.empty((width, live, HIDDEN), np.float32)
            for j in range(width):
                if first[j].any():
                    h = np.where(first[j][:, None], np.float32(0), h)
                states[j] = h = gated(np.take(table, x[j], axis=1), h @ u, h)
            before, of_before = sym[-1], doc[-1]
            states, goal, of = states.reshape(-1, HIDDEN), sym.ravel(), doc.ravel()
            real = of >= 0
            if not real.all():
                states, goal, of = states[real], goal[real], of[real]
            out += np.bincount(of, self.log_probs(states, goal)[0], len(docs))
        return out / LN10


def add_by(total: np.ndarray, x: np.ndarray, rows: np.ndarray) -> None:
    """Adds up the rows of each gate by their symbol x."""
    order = np.argsort(x.astype(np.int16), kind="stable")
    x = x[order]
    begin = np.flatnonzero(np.diff(x, prepend=-1))
    size = np.diff(begin, append=len(x))
    often, ones = size > OFTEN, np.ones(len(x), np.float32)
    for to, of in zip(total, rows, strict=True):
        of = np.take(of, order, axis=0)
        for lo, n in zip(begin[often].tolist(), size[often].tolist(), strict=True):
            to[x[lo]] += ones[:n] @ of[lo : lo + n]
        # the others' first rows, second rows and so on: no symbol is met twice
        for i in range(OFTEN):
            at = begin[~often & (size > i)]
            to[x[at]] += of[at + i]


class Training:
    """Adam's moments, which go on from one call of fit to the next. Weights, slopes and moments are stretches of one array each."""

    def __init__(self, model: Model) -> None:
        self.model, self.turn, self.tokens = model, 0, 0
        self.flat = np.concatenate([a.ravel() for a in model.p.values()])
        self.slope, self.m, self.v, self.work = (np.zeros_like(self.flat) for _ in range(4))
        ends = np.cumsum([a.size for a in model.p.values()])
        views = lambda flat: {n: x.reshape(a.shape) for (n, a), x in zip(model.p.items(), np.split(flat, ends[:-1]), strict=True)}
        self.grads = views(self.slope)
        model.p = views(self.flat)

    def fit(self, docs: list[np.ndarray], starts: list[bool] | None, lanes: int, rate: Callable[[float], float]) -> None:
        """Every symbol once; lanes (at most so many) are stretches of all documents in a row, each with a state of its own. rate: by the part that is done."""
        model, k, start = self.model, HIDDEN, len(self.model.cls)
        marks = [-1 if x else -2 for x in starts] if starts is not None else [-1] * len(docs)
        stream = np.concatenate([np.concatenate([[m], d]) for m, d in zip(marks, docs, strict=True)]) if docs else np.zeros(0, int)
        if not len(stream):
            return
        lanes = min(lanes, max(1, len(stream) // (4 * BPTT)))
        t = -(-len(stream) // lanes)
        # a lane reads the symbol that the next one begins with, so that each is predicted once; what fills the last is not
        stream = np.concatenate([stream, np.full(lanes * t + 1 - len(stream), -1)])
        s = np.concatenate([stream[:-1].reshape(lanes, t), stream[t::t, None]], 1)
        p, grads, h = model.p, self.grads, np.zeros((lanes, k), np.float32)
        most = min(BPTT, t)
        gates, turned = (np.empty((3, most, lanes, k), np.float32) for _ in range(2))
        before, states = (np.empty((most, lanes, k), np.float32) for _ in range(2))
        for lo in range(0, t, BPTT):
            part = np.ascontiguousarray(s[:, lo : lo + BPTT + 1].T)
            steps = len(part) - 1
            goal = part[1:].ravel()
            real = np.flatnonzero((goal >= 0) & (part[:-1].ravel() != -2))
            x, table = np.where(part[:-1] < 0, start, part[:-1]), model.inputs()
            new = [np.flatnonzero(row < 0) for row in part[:-1]]
            for j in range(steps):
                before[j] = h
                before[j, new[j]] = 0
                for g in range(3):
                    np.take(table[g], x[j], axis=0, out=gates[g, j], mode="clip")
                np.matmul(before[j], p["u"], out=turned[:, j])
                states[j] = h = gated(gates[:, j], turned[:, j], before[j])
            if not len(real):
                continue
            self.slope.fill(0)
            dh_out = np.zeros((steps * lanes, k), np.float32)
            dh_out[real] = model.log_probs(states[:steps].reshape(-1, k)[real], goal[real], grads)[1]
            dh_out, dh = dh_out.reshape(steps, lanes, k), np.zeros((lanes, k), np.float32)
            for j in range(steps - 1, -1, -1):
                (r, z, n), dg = gates[:, j], turned[:, j]
                dh += dh_out[j]
                rest = 1 - z
                dn = n * n
                np.subtract(1, dn, out=dn)
                dn *= rest
                dn *= dh
                rest *= z
                rest *= dh
                rest *= before[j] - n
                dh *= z
                z[:] = dg[1] = rest
                np.subtract(1, r, out=rest)
                rest *= r
                rest *= dg[2]
                rest *= dn
                np.multiply(dn, r, out=dg[2])
                r[:] = dg[0] = rest
                n[:] = dn
                grads["u"] += before[j].T @ dg
                for g in range(3):
                    dh += dg[g] @ p["u"][g].T
                dh[new[j]] = 0
            add_by(grads["x"], x.ravel(), gates[:, :steps].reshape(3, -1, k))
            grads["b"] += grads["x"].sum(1)
            self.turn += 1
            self.tokens += len(real)
            self.move(len(real), rate(lo / t))

    def move(self, size: int, pace: float) -> None:
        """One step of Adam with the slopes, summed over so many symbols, of a length of at most 1."""
        g, m, v, work = self.slope, self.m, self.v, self.work
        norm = math.sqrt(float(np.vdot(g, g))) / size
        g *= np.float32(min(1.0, 1 / max(norm, 1e-9)) / size)
        np.subtract(g, m, out=work)
        work *= np.float32(0.1)
        m += work
        np.multiply(g, g, out=work)
        work -= v
        work *= np.float32(0.01)
        v += work
        np.multiply(v, np.float32(1 / (1 - 0.99**self.turn)), out=work)
        np.sqrt(work, out=work)
        work += np.float32(1e-7)
        np.divide(m, work, out=work)
        work *= np.float32(pace / (1 - 0.9**self.turn))
        self.flat -= work


def learned(docs: DataFrame, counts: DataFrame) -> Model:
    """The model, from stored counts and all learning documents."""
    r = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = r[0] or 0, r[1]
    top = most_frequent(counts, KNOWN)
    short = {w for w, _ in top[:SHORTLIST]}

    def kinds(batches):
        mass = np.zeros(KINDS)
        for batch in batches:
            for w, n in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                if w not in short:
                    mass[rare_kind(w)] += n + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(range(KINDS), pa.int32()), pa.array(mass)], names=["k", "m"])

    mass = np.zeros(KINDS)
    for x in counts.mapInArrow(kinds, "k int, m double").groupBy("k").agg(F.sum("m").alias("m")).collect():
        mass[x.k] = x.m
    model = Model(top, total, distinct, mass / (total + 0.5 * (distinct + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a window is drawn if its text is, which needs no reading, and then itself
    share = min(1.0, START_TOKENS / max(1, total))
    texts, own = min(1.0, 8 * share), share / min(1.0, 8 * share)
    some = docs.where(~in_fold(F.col("doc_id"), 5)).select("text", md5_int(12, F.lit("lm"), F.md5("text")).alias("_drawn"))
    some = some.where(F.col("_drawn") < int(texts * 16**12)).dropDuplicates(["_drawn"])

    def read(batches):
        for batch in batches:
            drawn, at, syms = [], [], []
            for t, d in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                toks = byte_tokens(t.as_py())
                for lo in range(0, len(toks), START_WINDOW):
                    if (crc32(f"{d}|{lo}".encode()) + 0.5) / 2**32 < own:
                        drawn.append(d)
                        at.append(lo)
                        syms.append(symbols(shared.value, toks[max(0, lo - 1) : lo + START_WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int64()), pa.array(at, pa.int64()), pa.array(syms, pa.list_(pa.int32()))], names=["d", "at", "s"])

    got = sorted(some.mapInArrow(read, "d long, at long, s array<int>").collect(), key=lambda r: (crc32(f"{r.d}|{r['at']}".encode()), r.d, r["at"]))
    model.train([np.array(r.s) for r in got], [r["at"] == 0 for r in got])
    if total:
        model.p = trained_on_all(docs, model)
    return model


def trained_on_all(docs: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Weights after every learning text: the mean of those of tasks that each train a copy of the model on their share of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = sorted(model.p)

    def run(batches):
        own = copy(shared.value)
        own.p = {n: a.copy() for n, a in own.p.items()}
        training, block, size = Training(own), [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                words, at, size_of = split_tokens(piece)
                for doc in np.split(placed(word_symbols(own, words), at, size_of, own.end), np.cumsum(size_of)[:-1]):
                    block.append(doc)
                    size += len(doc)
                    if size > BLOCK:
                        training.fit(block, None, WIDE, lambda _: 0.4 * RATE)
                        block, size = [], 0
        training.fit(block, None, WIDE, lambda _: 0.4 * RATE)
        if training.tokens:
            flat = np.concatenate([own.p[n].ravel() for n in names]).astype(float)
            rows = [flat[lo : lo + ROW] for lo in range(0, len(flat), ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([float(training.tokens)] * len(rows)), pa.array(rows, pa.list_(pa.float64()))], names=["k", "n", "w"])

    part = docs.where(~in_fold(F.col("doc_id"), 5)).select("text", md5_int(12, F.lit("all"), F.col("doc_id"), F.md5("text")).alias("_dealt"))
    part = part.repartition(max(1, -(-model.total // TASK_TOKENS)), "_dealt").sortWithinPartitions("_dealt")
    rows = part.select("text").mapInArrow(run, "k int, n double, w array<double>")
    mean = rows.groupBy("k").agg(vector_to_array(Summarizer.mean(array_to_vector("w"), F.col("n"))).alias("w")).collect()  # as many numbers as the model has weights
    flat, out = np.concatenate([r.w for r in sorted(mean, key=lambda r: r.k)]).astype(np.float32), {}
    for n in names:
        out[n], flat = flat[: model.p[n].size].reshape(model.p[n].shape), flat[model.p[n].size :]
    return out


def symbols(model: Model, toks: list[bytes]) -> np.ndarray:
    """Tokens' symbols."""
    at = np.fromiter(map(model.index.get, toks, repeat(-1)), np.int64, len(toks))
    sym = np.empty(len(at), np.int32)
    known = at >= 0
    sym[known] = model.symbol[at[known]]
    sym[~known] = [model.short + rare_kind(toks[i].decode("utf-8", "surrogatepass")) for i in np.flatnonzero(~known)]
    return sym


def word_symbols(model: Model, words: pa.Array) -> np.ndarray:
    """Words' symbols, of an array."""
    sym = pc.fill_null(pc.index_in(words, model.frequent()), -1).to_numpy().astype(np.int32)
    rare = sym < 0
    if rare.any():
        ends = pc.utf8_slice_codeunits(words.filter(pa.array(rare)), -2).dictionary_encode()
        kinds = np.array([rare_kind(w) for w in ends.dictionary.to_pylist()], np.int32)
        sym[rare] = model.short + kinds[ends.indices.to_numpy()]
    return sym


def placed(values: np.ndarray, at: np.ndarray, size: np.ndarray, end) -> np.ndarray:
    """Values of words, with one of the ends, where they stand among the tokens."""
    out = np.full(size.sum(), end, values.dtype)
    out[at] = values
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: its sums over known tokens, and its other words with their counts. Rows are numbered by task, so store the result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, rest array<string>, times array<int>"

    def run(batches):
        from pyspark import TaskContext

        model, row = shared.value, TaskContext.get().partitionId() << 40
        fields = [f.split()[0] for f in schema.split(", ")]
        vocabulary = pa.array([*model.index], pa.binary()).cast(pa.string())
        end = model.index.get(b"", -1)
        for batch in batches:
            docs, parts = [], []
            for piece in pieces(batch.column(2)):
                words, at, sizes = split_tokens(piece)
                n = len(sizes)
                of = np.repeat(np.arange(n), sizes)
                sym = placed(word_symbols(model, words), at, sizes, model.end)
                found = placed(pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(), at, sizes, end)
                known, rare = found >= 0, sym >= model.short
                log_base = np.zeros(len(found))
                log_base[known] = model.log_base[found[known]]
                # of a rare word: its own smoothed count over its kind's; that of an unknown one comes with its count
                extra = np.bincount(of[rare], log_base[rare] - model.log_kind[sym[rare] - model.short], n)
                docs += np.split(sym, np.cumsum(sizes)[:-1])
                # a document's unknown words, each once; an end without learning texts is one of them
                left = words.filter(pa.array(~known[at])).dictionary_encode()
                other = np.full(len(found), len(left.dictionary))
                other[at[~known[at]]] = left.indices.to_numpy()
                names = pa.concat_arrays([left.dictionary, pa.array([END])])
                key, times = np.unique(of[~known] * len(names) + other[~known], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n + 1) * len(names)), pa.int32())
                rest = names.take(pa.array(key % len(names)))
                count = pa.array(np.bincount(of[known], minlength=n))
                parts.append(pa.table([pa.array(sizes), count, pa.array(np.bincount(of, log_base, n)), pa.array(extra), pa.ListArray.from_arrays(ends, rest), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))], names=fields[3:]))
            if not parts:
                continue
            # the network takes all of a batch at once, so that long texts have others beside them
            own, n = pa.concat_tables(parts), len(docs)
            own = own.set_column(3, "extra", pc.add(own["extra"], pa.array(model.score(docs))))
            head = pa.table([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1)], names=fields[:3])
            for c in fields[3:]:
                head = head.append_column(c, own[c])
            yield from head.combine_chunks().to_batches()
            row += n

    return docs.select(F.col("doc_id").cast("long"), in_fold(F.col("doc_id"), 5).alias("held_out"), "text").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    docs = docs.select("doc_id", "text")
    counts = stored(token_counts(docs), "op3-counts")
    model = learned(docs, counts)
    x = stored(scored(docs, model), "op3-scored")
    words_left = x.select("row", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("row", F.col("e.rest").alias("word"), F.col("e.times").alias("k"))
    y = words_left.join(counts, F.col("word") == F.col("w"), "left")
    log_base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    y = y.groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * log_base).alias("sum"))
    z = x.drop("rest", "times").join(y, F.col("row") == F.col("of"), "left")
    left = F.coalesce("sum", F.lit(0.0))
    return z.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + left).alias("base_score"), (F.col("extra") + left).alias("score"))
