"""Operator 10, benchmark decontamination: rare n-gram seeds join documents to test items, then Smith-Waterman alignment.

A seed is a run of words of a test item (lower case; letters, digits and ``_``) that few other items hold: at each place
the shortest of 3, 4, 5, 6 or 8 words that at most ``RARE`` different items share, so that a stem which a whole benchmark
repeats brings no document to all its items. Items that get fewer than ``ENOUGH`` seeds (or at fewer than half their
places) are counted anew among themselves only, with twice the limit, until none is left: no item goes without seeds.
A document that holds nothing of an item but what many others hold too isn't a copy of it, however much of it that is.
How frequent a seed is among documents doesn't matter: a copy that stands in many of them makes its own runs frequent.

One pass over the corpus looks where its trigrams pass a fixed-size filter of the seeds' first three words, and there
whether a run passes a second filter of the seeds, so that all but a few never leave their task; the rest join the seeds
in Spark, which gives for each document and item the places where they may meet. Only documents with such a place are
read again, and the items are aligned to the words around it (match 2, mismatch -1, gap -1 a word). The score over twice
the item's words is the share found; ``THRESHOLD`` of it, and four words' worth (or all of a shorter item), are reported.
Places that hold too few of the item's words to reach that in any order are passed over, without loss.

To the driver come the filters (at most 16 MB each) and, if they hold at most ``BROADCAST_CHARS``, the items' texts, which
are then broadcast; longer benchmarks join the items that a document met, at most ``RARE`` for most places.

Defined results: null or empty texts match nothing; an item of one or two words matches a document of just these words,
as ordinary prose holds them; items of the same words are one item, each of whose rows is reported; very long texts are
searched whole; repeated rows are each reported; several items may match a document, and an item once a document, at its
best place; items that share an item_id are each reported; a score of just the threshold counts; empty tables give no
rows (or leave all documents); other columns pass through ``clean`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import map_rows, numbered, renamed, row_key, stored

GRAM, THRESHOLD, LEAST_WORDS = 3, 0.5, 4
#: Words of a seed, from the shortest; the different items that may share one at first; the seeds that an item needs (or half its places).
LENGTHS, RARE, ENOUGH = (3, 4, 5, 6, 8), 10, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the filter by seed, and its largest size (in powers of two); beyond it more trigrams pass, and the join drops them.
BITS_A_SEED, MOST_BITS = 32, 27
CACHE_WORDS = 300_000
#: Up to so many documents to drop, characters of items, and bytes of places are broadcast; more are joined.
BROADCAST_FOUND, BROADCAST_CHARS, BROADCAST_PLACES = 200_000, 1 << 25, 1 << 26
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Grams:
    """Hashes of a text's words, kept between texts up to a fixed number, and keys of runs of them."""

    def __init__(self) -> None:
        self.hash: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        w = tokens(text)
        if len(self.hash) > CACHE_WORDS:
            self.hash.clear()
        known = self.hash
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))

    @staticmethod
    def first(h: np.ndarray) -> np.ndarray:
        """Keys of all trigrams; one key of a text of one or two words."""
        size = min(GRAM, len(h))
        n = len(h) - size + 1 if size else 0
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = longer(key, h[k : n + k])
        return key

    @staticmethod
    def runs(h: np.ndarray, key: np.ndarray, at: np.ndarray, most: int = LENGTHS[-1]):
        """(length, keys, places) of the runs that start with the trigrams ``key`` at ``at``."""
        yield GRAM, key, at
        for size in range(GRAM + 1, most + 1):
            inside = at + size <= len(h)
            at, key = at[inside], key[inside]
            if not len(at):
                return
            key = longer(key, h[at + size - 1])
            if size in LENGTHS:
                yield size, key, at


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of runs with one more word."""
    key = (key + word) * _MIX
    return key ^ key >> np.uint64(29)


def align(item: np.ndarray, part: np.ndarray) -> int:
    """Best local alignment score (Smith-Waterman), a row of the table at a time."""
    step = -GAP * np.arange(1, len(part) + 1)
    above, best = np.zeros(len(part) + 1, np.int64), 0
    for w in item:
        row = np.maximum(above[:-1] + np.where(part == w, MATCH, MISMATCH), above[1:] + GAP)
        # a gap along the row: the best of what stands to the left, less a gap a word
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + step) - step, 0)
        best = max(best, int(row.max(initial=0)))
        above[1:] = row
    return best


def best_score(item: list[str], words: list[str], there: set[str], starts: list[int], threshold: float) -> float | None:
    """The best score of an item at its places in a document (where it would start, by seed), if it is enough."""
    n = len(item)
    need = max(threshold * MATCH * n, min(LEAST_WORDS, n) * MATCH)
    if MATCH * sum(w in there for w in item) < need:
        return None
    ids: dict[str, int] = {}
    own = np.array([ids.setdefault(w, len(ids) + 1) for w in item], np.int32)
    best, lo, starts = 0, 0, sorted(starts)
    for i in range(1, len(starts) + 1):
        # places further apart than half an item are aligned apart
        if i < len(starts) and starts[i] - starts[i - 1] <= n // 2:
            continue
        # beyond as many words as the item has, gaps cost more than it can bring
        part = np.array([ids.get(w, 0) for w in words[max(0, starts[lo] - n) : starts[i - 1] + 2 * n]], np.int32)
        # a word of either side matches once at most
        if MATCH * min(np.isin(own, part).sum(), np.isin(part, own).sum()) >= need:
            best = max(best, align(own, part))
        lo = i
    return best / (MATCH * n) if best >= need else None


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (item_id, words: a digest of the item's words) and items of different words (item, words, item_text), both stored."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            own = [hashlib.md5(" ".join(tokens(t.as_py())).encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column(1)]
            return {"item_id": batch.column(0), "item_text": batch.column(1), "words": own}

        return step

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").alias("item_text"))
    rows = stored(map_rows(rows, "item_id long, item_text string, words string", start), "op10-rows")
    items = rows.groupBy("words").agg(F.min("item_text").alias("item_text")).select(F.monotonically_increasing_id().alias("item"), "words", "item_text")
    return rows.select("item_id", "words"), stored(items, "op10-items")


def seeds_of(items: DataFrame) -> DataFrame:
    """gram, head (key of its first three words), size, item, place of the seeds, stored."""

    def start():
        grams = Grams()

        def step(batch: pa.RecordBatch) -> dict:
            cols = {c: [] for c in ("gram", "head", "size", "item", "place", "fresh", "need")}
            for item, text in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                h = grams.words(text)
                heads = grams.first(h)
                need = min(ENOUGH, (len(heads) + 1) // 2)
                for size, key, at in grams.runs(h, heads, np.arange(len(heads))):
                    fresh = np.zeros(len(key), np.int32)
                    fresh[np.unique(key, return_index=True)[1]] = 1
                    for c, v in zip(cols, (key.view(np.int64), heads[at].view(np.int64), size, item, at, fresh, need), strict=True):
                        cols[c].append(np.broadcast_to(v, len(key)))
            return {c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)).cast(pa.int64()) for c, v in cols.items()}

        return step

    left = stored(map_rows(items.select("item", "item_text"), "gram long, head long, size long, item long, place long, fresh long, need long", start), "op10-grams")
    parts, limit = [], RARE
    while not left.isEmpty():
        few = left.groupBy("gram").agg(F.sum("fresh").alias("k")).where(F.col("k") <= limit).select("gram")
        part = left.join(few, "gram").groupBy("item", "place").agg(F.min_by(F.struct("gram", "head", "size"), "size").alias("s"), F.first("need").alias("need"))
        parts.append(stored(part.select("s.gram", "s.head", "s.size", "item", "place", "need"), "op10-part"))
        served = parts[-1].groupBy("item").agg(F.count("*").alias("k"), F.first("need").alias("n")).where("k >= n").select("item")
        left, limit = stored(left.join(served, "item", "left_anti"), "op10-left"), 2 * limit
    return stored(reduce(DataFrame.unionAll, parts).drop("need").distinct(), "op10-seeds") if parts else left.select("gram", "head", "size", "item", "place")


def filter_of(keys: DataFrame) -> np.ndarray:
    """Bits, packed into 64-bit words, by the lowest bits of the keys: enough bits for ``BITS_A_SEED``, at most 2**``MOST_BITS``."""
    bits = min(MOST_BITS, max(16, (max(1, keys.count()) * BITS_A_SEED - 1).bit_length()))
    key = F.col(keys.columns[0])
    word = F.shiftright(key.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int").alias("w")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in keys.groupBy(word).agg(F.bit_or(bit).alias("m")).toLocalIterator():
        out[r.w] = np.int64(r.m).astype(np.uint64)
    return out


def passing(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold."""
    low = key & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero(bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))


def hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """_doc, gram, at: where documents' runs pass the filters; docs holds _doc and text."""
    most = seeds.agg(F.max("size")).first()[0] or GRAM
    shared = docs.sparkSession.sparkContext.broadcast((filter_of(seeds.select("head").distinct()), filter_of(seeds.select("gram").distinct()), most))

    def start():
        grams, (heads, whole, most) = Grams(), shared.value

        def step(batch: pa.RecordBatch) -> dict:
            doc, keys, places = [], [], []
            for n, t in enumerate(batch.column(1)):
                h = grams.words(t.as_py())
                key = grams.first(h)
                at = passing(heads, key)
                if not len(at):
                    continue
                for _, run, where in grams.runs(h, key[at], at, most):
                    ok = passing(whole, run)
                    doc.append(np.full(len(ok), n))
                    keys.append(run[ok].view(np.int64))
                    places.append(where[ok])
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            return {"_doc": batch.column(0).take(cat(doc)), "gram": cat(keys), "at": cat(places)}

        return step

    return map_rows(docs.select("_doc", "text"), "_doc string, gram long, at long", start)


def shared_texts(items: DataFrame) -> dict[int, str] | None:
    """The items' texts by number, if they hold at most ``BROADCAST_CHARS``."""
    n = items.agg(F.sum(F.length("item_text") + 100)).first()[0] or 0
    return {r.item: r.item_text for r in items.select("item", "item_text").toLocalIterator()} if n <= BROADCAST_CHARS else None


def met_by(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_doc, item, starts (places where the item would start) of each different document and item with a seed in common."""
    seeds = seeds_of(items)
    return hits(docs, seeds).join(seeds.select("gram", "item", "place"), "gram").groupBy("_doc", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """_doc, item_id, score of each different document and test item found in it; docs holds _doc (equal for equal rows) and text. Stored."""
    rows, items = items_of(benchmark)
    texts = docs.sparkSession.sparkContext.broadcast(shared_texts(items))
    met = met_by(docs, items)
    met = met.withColumn("item_text", F.lit(None).cast("string")) if texts.value is not None else met.join(items.select("item", "item_text"), "item")
    met = stored(met.groupBy("_doc").agg(F.collect_list(F.struct("item", "item_text", "starts")).alias("met")), "op10-met")
    size = met.agg(F.sum(200 + F.aggregate("met", F.lit(0), lambda n, x: n + 100 + 4 * F.coalesce(F.length(x["item_text"]), F.lit(0)) + 8 * F.size(x["starts"])))).first()[0] or 0
    read = docs.select("_doc", "text").join(F.broadcast(met) if size <= BROADCAST_PLACES else met, "_doc")

    def start():
        own_texts = texts.value

        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = tokens(text)
                there = set(own)
                for x in found:
                    item = tokens(x["item_text"] if own_texts is None else own_texts[x["item"]])
                    score = best_score(item, own, there, x["starts"], threshold)
                    if score is not None:
                        out.append((doc, x["item"], score))
            return {c: [r[i] for r in out] for i, c in enumerate(("_doc", "item", "score"))}

        return step

    found = map_rows(read.select("_doc", "text", "met"), "_doc string, item long, score double", start).distinct()
    # equal documents have equal rows; an item's rows are each reported
    return stored(found.join(items.select("item", "words"), "item").join(rows, "words").select("_doc", "item_id", "score"), "op10-found")


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score (0 to 1)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("_doc"), "text")
    found = matches(x, benchmark, threshold)
    return x.select("doc_id", F.col("_doc").alias("_row")).join(found, F.col("_row") == F.col("_doc")).select("doc_id", "item_id", "score")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    x = docs.select(*numbered(docs), row_key("doc_id", "text").alias("_doc"), "text")
    found = matches(x.select("_doc", "text"), benchmark, threshold).select("_doc").distinct()
    few = F.broadcast(found) if found.count() <= BROADCAST_FOUND else found
    return renamed(x.join(few, "_doc", "left_anti"), docs)
