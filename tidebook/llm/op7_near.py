"""Operator 7, near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words running (all of them where a text has fewer). Its weight is its count in the text times
1 + the mean inverse document frequency of its words, ln(documents / frequency) over ln(1 / ``RARE``), 1 at most. That
depends on a word's share of the documents only, so weights don't change with the corpus's size; words under the share
``RARE`` all weigh the same, and the others are so few (a text's mean number of different words / ``RARE`` at most)
that they travel with the samplers. The frequency of a whole shingle would not do: it is 1 for nearly all, and for the
others mostly the size of the group of copies that shares them, which would weigh down just what copies have in common.

Improved consistent weighted samples (one per hash: the shingle and its quantised weight) fill bands. Equal texts are
one node from the start. Nodes that share a band key meet in rounds, and classes found so far are one before the next:
each node and the smallest node of all its buckets; then, in buckets that still hold several classes, each node and one
drawn member, first by band and then by pairs of bands, whose buckets hold what is more alike. So large groups of copies
become one class by pairs as many as their members. For buckets that hold several classes even then, an exact join
follows: two nodes of different classes meet when the beginnings of their shingles, rarest first, have one in common and
enough weight from there on (prefix and positional filter: no similar pair is without one). In the rounds a pair of which
enough samples agree, and in the join every pair, is compared on its texts and links at a weighted Jaccard similarity of
0.8 or more. Classes are the connected components.

Defined results: null texts and texts without words are classes of their own, named by their doc_id; texts of fewer
than five words are one shingle; very long texts are sampled whole; rows without doc_id go by a digest of their text; a
class is named by its smallest id (a second class of that id, where rows share a doc_id and not their text, by its
text's digest); repeated rows are in one class; an empty table gives no rows; other columns pass through
``one_of_each`` whatever their names, and of rows alike in id and text it keeps one, the same on every run.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import WORD_RE, discard, map_rows, most_frequent, numbered, renamed, sampled, stored, words

SIZE, SIMILARITY = 5, 0.8
#: All bands miss a pair at the least similarity about four times in a hundred thousand.
BANDS, ROWS = 14, 3
#: Share of samples that must agree before texts are compared in a round; the exact join sees again what this passes over.
AGREE = 0.65
#: Steps between the two bands of a pair, a round each.
PAIRS = (1, 2)
#: Texts whose shingles set the order of the exact join, and shingles that are ranked in it; they change its speed only.
ORDER_TEXTS, ORDER_SHINGLES = 50_000, 200_000
#: A pair that has met at one of so many shingles before doesn't meet again.
BEFORE = 3
BEFORES = [f"before_{k}" for k in range(BEFORE)]
#: Share of documents under which words are all equally rare.
RARE = 1e-4
CACHE_WORDS, COUNT_WORDS, CHUNK_CHARS, SEEN_TEXTS = 300_000, 200_000, 120_000, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FMIX = np.uint64(0xFF51AFD7ED558CCD)


def word_frequencies(docs: DataFrame) -> dict[str, float]:
    """Scaled inverse document frequency, below 1, of the words in at least the share ``RARE`` of the documents; all documents count."""

    def count(batches):
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
        for batch in batches:
            for t in batch.column(0):
                seen.update(set(words(t.as_py())))
                if len(seen) > COUNT_WORDS:
                    yield flush()
                    seen.clear()
        yield flush()

    n = docs.count()
    counts = docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r.w: float(np.log(n / r.n) / -np.log(RARE)) for r in counts.where(F.col("n") > F.lit(RARE * n)).collect()}


class Shingles:
    """Shingle hashes and weights of texts; words' hashes are kept between texts, up to a fixed number."""

    def __init__(self, idf: dict[str, float]) -> None:
        self.idf, self.ids = idf, {}
        self.hash, self.weight = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct shingles, and their weights."""
        return self.many([text])[:2]

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of some texts, a text after the other, their weights, and which text each belongs to."""
        docs = [words(t) for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids = {}
        fresh = list({x for d in docs for x in d if x not in self.ids})
        if fresh:
            n = len(self.ids)
            self.ids.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            if n + len(fresh) > len(self.hash):
                self.hash, self.weight = np.resize(self.hash, 2 * (n + len(fresh))), np.resize(self.weight, 2 * (n + len(fresh)))
            self.hash[n : n + len(fresh)] = [xxhash.xxh64_intdigest(x) for x in fresh]
            self.weight[n : n + len(fresh)] = [self.idf.get(x, 1.0) for x in fresh]
        get, size = self.ids, np.array([len(d) for d in docs], np.int64)
        ids = np.array([get[x] for d in docs for x in d], np.int64)
        h, v, doc = self.hash[ids], self.weight[ids], np.repeat(np.arange(len(docs)), size)
        key, idf = self.joined(h, v, SIZE)
        inside = np.flatnonzero(doc[: len(key)] == doc[SIZE - 1 :]) if len(key) else np.zeros(0, np.int64)
        key, idf, doc = key[inside], idf[inside], doc[inside]
        for d in np.flatnonzero((size > 0) & (size < SIZE)):  # fewer words than a shingle: all of them
            own = slice(int(size[:d].sum()), int(size[: d + 1].sum()))
            k, i = self.joined(h[own], v[own], int(size[d]))
            at = int(np.searchsorted(doc, d))
            key, idf, doc = np.insert(key, at, k), np.insert(idf, at, i), np.insert(doc, at, d)
        # equal shingles of one text are one, of their number
        mixed = (key ^ (doc.astype(np.uint64) * _FMIX)) * _MIX
        order = mixed.argsort()
        mixed = mixed[order]
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
        at, count = order[first], np.diff(np.append(first, len(mixed)))
        by = at.argsort()
        at, count = at[by], count[by]
        return key[at], count * (1 + idf[at]), doc[at]

    @staticmethod
    def joined(h: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and mean frequencies of all runs of k words."""
        n = max(0, len(h) - k + 1)
        key, idf = np.zeros(n, np.uint64), np.zeros(n)
        for j in range(k):
            key = (key + h[j : n + j]) * _MIX
            key ^= key >> np.uint64(31)
            idf += v[j : n + j]
        return key, idf / k


class Sampler:
    """Improved consistent weighted sampling: gamma and uniform draws come from fixed tables, addressed by the shingle's and the hash's mixed bits."""

    def __init__(self, hashes: int = BANDS * ROWS) -> None:
        draw = np.random.default_rng(7)
        self.r = draw.gamma(2, 1, 65536).astype(np.float32)
        self.c = np.log(draw.gamma(2, 1, 65536)).astype(np.float32)
        self.b = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.seeds = draw.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, keys: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of samples for each document whose shingles start at ``first``; none of them is empty."""
        out = np.empty((len(first), len(self.seeds)), np.int64)
        log_w = np.log(weights).astype(np.float32)
        for j, seed in enumerate(self.seeds):
            h = (keys ^ seed) * _FMIX
            h ^= h >> np.uint64(32)
            h *= _MIX
            h = h.view(np.int64)
            r, b = self.r.take((h >> 48) & 0xFFFF), self.b.take((h >> 32) & 0xFFFF)
            t = np.floor(log_w / r + b)
            a = self.c.take((h >> 16) & 0xFFFF) - (r * (t - b) + r)
            # floats as whole numbers of the same order, then what names the sample: the shingle with its step t
            bits = a.view(np.int32)
            order = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64)
            name = (h ^ (t.astype(np.int64) * 0x51AFD7ED558CCD)) & 0xFFFFFFFF
            out[:, j] = np.minimum.reduceat((order << 32) | name, first)
        return (out & 0xFFFFFFFF).view(np.uint64)


def bands_of(samples: np.ndarray) -> np.ndarray:
    """Keys of the bands; a band's number is part of its keys."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for i in range(ROWS):
        key = (key + samples[:, i::ROWS]) * _FMIX
        key ^= key >> np.uint64(33)
    return key.view(np.int64)


def signed(docs: DataFrame, idf) -> DataFrame:
    """id, md5, and once a task and text its sum of weights, band keys and samples; rows without words are left out."""

    def start():
        shingles, sampler, seen = Shingles(idf.value), Sampler(), set()

        def step(batch: pa.RecordBatch) -> dict:
            own, texts, have = [], [], 0
            places, repeated, sums, samples = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, bool), [], []

            def flush() -> None:
                key, weight, doc = shingles.many(texts)
                some, first = np.unique(doc, return_index=True)
                have = sum(map(len, sums))
                places[[own[-len(texts) + i] for i in some]] = np.arange(have, have + len(some))
                if len(some):
                    sums.append(np.add.reduceat(weight, first))
                    samples.append(sampler.signatures(key, weight, first))

            for n, (d, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if d in seen:
                    repeated[n] = True
                    continue
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                seen.add(d)
                own.append(n)
                texts.append(t.as_py())
                have += len(texts[-1])
                if have >= CHUNK_CHARS:
                    flush()
                    texts, have = [], 0
            if texts:
                flush()
            # rows without words go; of rows whose text this task has signed before, only ids are told
            rows = np.flatnonzero((places >= 0) | repeated)
            at, rows = pa.array(places[rows], pa.int64(), mask=places[rows] < 0), pa.array(rows, pa.int64())
            drawn = np.concatenate(samples) if samples else np.zeros((0, BANDS * ROWS), np.uint64)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).take(at)
            return {
                "id": batch.column(0).take(rows),
                "md5": batch.column(1).take(rows),
                "weight": pa.array(np.concatenate(sums) if sums else np.zeros(0)).take(at),
                "bands": lists(bands_of(drawn)).cast(pa.list_(pa.int64())),
                "samples": lists(drawn.astype(np.uint32).view(np.int32)).cast(pa.list_(pa.int32())),
            }

        return step

    docs = docs.where(F.col("text").rlike(WORD_RE))
    return map_rows(docs.select(row_id().alias("id"), F.md5("text").alias("md5"), "text"), "id long, md5 string, weight double, bands array<long>, samples array<int>", start)


def digest_id(md5: Column) -> Column:
    return -1 - F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), digest_id(F.md5(F.coalesce("text", F.lit("")))))


def agree(a: str, b: str) -> Column:
    """Whether enough samples of two nodes agree for their texts to be fetched."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same >= int(AGREE * BANDS * ROWS)


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Of rows a, b, la, lb (two texts and their labels so far), those whose texts are similar enough."""
    x = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    x = x.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def start():
        shingles, kept = Shingles(idf.value), {}

        def known(i: int, text: pa.StringScalar):
            if i not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[i] = shingles.of(text.as_py())
            return kept[i]

        def step(batch: pa.RecordBatch) -> dict:
            keep = np.zeros(batch.num_rows, bool)
            for n, (i, s, t) in enumerate(zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True)):
                (ka, wa), (kb, wb) = known(i.as_py(), s), shingles.of(t.as_py())
                _, pa_, pb = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = np.minimum(wa[pa_], wb[pb]).sum()
                keep[n] = both >= similarity * (wa.sum() + wb.sum() - both) - 1e-9
            return {c: batch.filter(pa.array(keep)).column(c) for c in ("a", "b", "la", "lb")}

        return step

    return map_rows(x.select("a", "b", "la", "lb", "text_a", "text_b"), "a long, b long, la long, lb long", start)


def frequent_shingles(texts: DataFrame, idf) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of the shingles found more than once in a sample of texts, and how often."""

    def start():
        shingles = Shingles(idf.value)

        def step(batch: pa.RecordBatch) -> dict:
            h, n = np.unique(np.concatenate([shingles.of(t.as_py())[0] for t in batch.column(0)]), return_counts=True)
            return {"w": pa.array(h.view(np.int64)), "n": pa.array(n)}

        return step

    some = map_rows(sampled(texts, ORDER_TEXTS, F.col("node")).select("text"), "w long, n long", start)
    most = most_frequent(stored(some.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1"), "op7-order"), ORDER_SHINGLES)
    h, n = np.array([w for w, _ in most], np.int64).view(np.uint64), np.array([n for _, n in most], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def beginnings(texts: DataFrame, idf, ranks, similarity: float) -> DataFrame:
    """node, token, rest, before: the shingles at the beginning of each text, rarest first, the weight from each to the end, and the ones just before each.

    The overlap of a similar pair is at least ``similarity`` of the larger text's weight, and no more than weighs what
    follows the first shingle that they have in common: so that one is in the beginning.
    """

    def start():
        shingles, (known, often) = Shingles(idf.value), ranks.value

        def step(batch: pa.RecordBatch) -> dict:
            nodes, tokens, rests, before = [], [], [], [[] for _ in range(BEFORE)]
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                key, weight = shingles.of(t.as_py())
                rank = np.zeros(len(key), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    rank = np.where(known[at] == key, often[at], 0)
                order = np.lexsort((key, rank))
                rest = np.cumsum(weight[order][::-1])[::-1]
                n = int((rest >= similarity * rest[0] - 1e-6).sum())
                own = key[order[:n]].view(np.int64)
                nodes.append(np.full(n, i.as_py()))
                tokens.append(own)
                rests.append(rest[:n])
                for k in range(BEFORE):
                    before[k].append(np.concatenate([np.zeros(min(k + 1, n), np.int64), own[: max(0, n - k - 1)]]))
            return {
                "node": pa.array(np.concatenate(nodes)),
                "token": pa.array(np.concatenate(tokens)),
                "rest": pa.array(np.concatenate(rests)),
                **{f"before_{k}": pa.array(x, mask=x == 0) for k, x in enumerate(map(np.concatenate, before))},
            }

        return step

    return map_rows(texts.select("node", "text"), "node long, token long, rest double, " + ", ".join(f"{c} long" for c in BEFORES), start)


def size_alike(a: str, b: str, similarity: float) -> Column:
    """No similarity exceeds the ratio of the two sums of weights."""
    return F.least(f"{a}.weight", f"{b}.weight") >= (similarity - 1e-9) * F.greatest(f"{a}.weight", f"{b}.weight")


def meetings(left: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """a, b, la, lb: pairs of different classes that may be similar, by a token in common; left holds v (node and weight) and label."""
    x = tokens.join(left, F.col("node") == F.col("v.node")).select("token", "rest", "node", "v.weight", "label", *BEFORES)
    own = stored(x, "op7-tokens")
    # a pair's smaller text has its first common token among the shingles before the last 2 s / (1 + s) of its weight
    small = F.col("rest") >= 2 * similarity / (1 + similarity) * F.col("weight") - 1e-6
    shared = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(small).alias("any")).where("lo < hi and any").select("token")
    every, own = own, stored(own.join(shared, "token", "left_semi"), "op7-shared")
    discard(every)
    names = ("node", "rest", "weight", "label", *BEFORES)
    a = own.where(small).select("token", *[F.col(c).alias(f"a_{c}") for c in names])
    b = own.select("token", *[F.col(c).alias(f"b_{c}") for c in names])
    # where a shingle before is common too, the pair has met there: what must hold here holds there as well
    again = F.coalesce(reduce(or_, [F.coalesce(F.col(f"a_{x}") == F.col(f"b_{y}"), F.lit(False)) for x in BEFORES for y in BEFORES]), F.lit(False))
    order = (F.col("a_weight") < F.col("b_weight")) | ((F.col("a_weight") == F.col("b_weight")) & (F.col("a_node") < F.col("b_node")))
    enough = F.least("a_rest", "b_rest") >= similarity / (1 + similarity) * (F.col("a_weight") + F.col("b_weight")) - 1e-6
    size = F.col("a_weight") >= (similarity - 1e-9) * F.col("b_weight")
    met = a.join(b, (a["token"] == b["token"]) & (F.col("a_label") != F.col("b_label")) & order & size & enough & ~again)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_label").alias("la"), F.col("b_label").alias("lb")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its connected component, for every node of links (a, b).

    Each step takes the smallest label of a node, its neighbours and its label's own label, until nothing changes.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "op7-edges")
    labels = stored(edges.groupBy(F.col("b").alias("node")).agg(F.least(F.col("node"), F.min("a")).alias("label")), "op7-labels")
    while True:
        near = edges.join(labels, edges.a == labels.node).groupBy(F.col("b").alias("near")).agg(F.min("label").alias("low"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("over"))
        new = labels.join(near, F.col("node") == F.col("near")).join(up, F.col("label") == F.col("up"))
        new = stored(new.select("node", F.least("label", "low", "over").alias("label"), (F.least("low", "over") < F.col("label")).alias("moved")), "op7-labels")
        discard(labels)
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            discard(edges)
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """md5, label, id, of every different text with words: its class, and the smallest id of the text's own rows."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(word_frequencies(docs))
    found = signed(docs, idf).groupBy("md5").agg(F.min("id").alias("id"), F.first(F.when(F.col("bands").isNotNull(), F.struct("weight", "bands", "samples")), True).alias("r"))
    nodes = stored(found.select(F.monotonically_increasing_id().alias("node"), "md5", "id", "r.*"), "op7-nodes")
    v = F.struct("node", "weight").alias("v")
    x = nodes.select(v, "samples", F.explode("bands").alias("key"))
    crowded = x.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(x.join(crowded, "key", "left_semi"), "op7-members")
    own = stored(members.select(F.col("v.node").alias("node")).distinct(), "op7-own")
    texts = docs.select(F.md5("text").alias("md5"), row_id().alias("id"), "text").join(nodes.join(own, "node", "left_semi").select("md5", "id", "node"), ["md5", "id"])
    # grouped as it was joined, so no second shuffle
    texts = stored(texts.groupBy("md5", "id", "node").agg(F.first("text").alias("text")).select("node", "text"), "op7-texts")

    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        new = stored(verified(pairs, texts, idf, similarity), "op7-links")
        merged = components(new.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnsRenamed({"node": "old", "label": "to"})
        out = stored(labels.join(merged, F.col("label") == F.col("old"), "left").select("node", F.coalesce("to", "label").alias("label")), "op7-classes")
        discard(new, merged)
        return out

    def several(keyed: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several classes, with their labels."""
        y = keyed.join(labels, F.col("v.node") == F.col("node")).drop("node")
        mixed = y.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return stored(y.join(mixed, "key", "left_semi"), "op7-several")

    def met(left: DataFrame, turn: int) -> DataFrame:
        """Each member and the one drawn from its bucket, where their classes differ."""
        drawn = left.groupBy("key").agg(F.min_by(F.struct("v", "label", "samples"), F.xxhash64("v.node", F.lit(turn))).alias("p"))
        pairs = left.join(drawn, "key").where("label != p.label").where(size_alike("p.v", "v", similarity)).where(agree("p.samples", "samples"))
        return pairs.select(F.col("p.v.node").alias("a"), F.col("v.node").alias("b"), F.col("p.label").alias("la"), F.col("label").alias("lb")).distinct()

    # every text is its own class: each meets the smallest of all its buckets
    labels = own.select("node", F.col("node").alias("label"))
    pivots = members.groupBy("key").agg(F.min_by(F.struct("v", "samples"), "v.node").alias("p"))
    first = members.join(pivots, "key").where("p.v.node != v.node").where(size_alike("p.v", "v", similarity)).where(agree("p.samples", "samples"))
    first = first.groupBy(F.col("v.node").alias("b")).agg(F.min("p.v.node").alias("a"))
    labels = linked(first.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")), labels)
    # where classes are left apart, all meet one of their bucket, and then of their buckets by pairs of bands
    left = several(members, labels)
    labels = linked(met(left, 0), labels)
    apart = left.select(F.col("v.node").alias("node")).distinct()
    bands = stored(nodes.join(apart, "node", "left_semi").select(v, "samples", "bands"), "op7-bands")
    discard(left)
    for turn in PAIRS:
        two = F.array(*[F.xxhash64(F.get("bands", F.lit(i)), F.get("bands", F.lit((i + turn) % BANDS))) for i in range(BANDS)])
        left = several(bands.select("v", "samples", F.explode(two).alias("key")), labels)
        labels = linked(met(left, turn), labels)
        discard(left)
    # and where they still are, all whose beginnings meet
    last = several(members, labels)
    left = stored(last.select("v", "label").distinct(), "op7-left")
    discard(last, bands, members)
    own = stored(texts.join(left.select(F.col("v.node").alias("node")), "node", "left_semi"), "op7-left-texts")
    ranks = spark.sparkContext.broadcast(frequent_shingles(own, idf))
    labels = linked(meetings(left, beginnings(own, idf, ranks, similarity), similarity), labels)
    return nodes.select("node", "md5", "id").join(labels, "node", "left").select("md5", F.coalesce("label", "node").alias("label"), "id")


def score(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every document; the documents of one class are copies or near copies of each other."""
    docs = docs.select("doc_id", "text")
    found = stored(classes(docs, similarity), "op7-found")
    reps = found.groupBy("label").agg(F.min(F.struct("id", "md5")).alias("r"))
    names = reps.groupBy(F.col("r.id").alias("_id")).agg(F.min("r.md5").alias("_first"))
    named = reps.join(names, F.col("r.id") == F.col("_id")).select("label", F.when(F.col("r.md5") == F.col("_first"), F.col("_id")).otherwise(digest_id(F.col("r.md5"))).alias("class_id"))
    of = found.join(named, "label").select(F.col("md5").alias("_of"), "class_id")
    own = docs.select("doc_id", row_id().alias("_id"), F.md5("text").alias("_md5"))
    return own.join(of, F.col("_md5") == F.col("_of"), "left").select("doc_id", F.coalesce("class_id", "_id").alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each class, with its own columns."""
    found = classes(docs.select("doc_id", "text"), similarity)
    reps = found.groupBy("label").agg(F.min(F.struct("id", "md5")).alias("r")).select(F.col("r.id").alias("_id"), F.col("r.md5").alias("_md5"))
    blank = ~F.coalesce(F.col("text").rlike(WORD_RE), F.lit(False))
    own = numbered(docs)
    x = docs.where(~blank).select(*own, row_id().alias("_id"), F.md5("text").alias("_md5")).join(reps, ["_id", "_md5"], "left_semi")
    names = [f"_own_{i}" for i in range(len(own))]
    # grouped as it was joined, so no second shuffle; rows alike in id and text go by a digest of all their columns
    x = x.groupBy("_id", "_md5").agg(F.min_by(F.struct(*names), F.xxhash64(*[F.col(c).cast("string") for c in names])).alias("r")).select("r.*")
    return renamed(x.unionByName(docs.where(blank).select(*own)), docs)
