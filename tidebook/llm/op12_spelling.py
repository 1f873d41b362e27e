"""Operator 12, spelling variants by Bloom-guided neighbourhoods.

Words one edit apart are found by generating edits: of each word its deletions and its replacements by a larger letter
(an insertion is the other word's deletion, a replacement by a smaller letter the other word's by a larger one, so each
pair is generated once). All edits of a batch are hashed in numpy from the word's prefix hashes, without forming them,
and probed against Bloom filters of the vocabulary: one filter per length, divided into slices by hash where a length has
many words, with all bits of a key in one 64-bit block. The filters are broadcast in rounds of at most ``ROUND_BYTES``;
24 bits a word keep false positives at about one in two hundred whatever the vocabulary's size. Only edits that a filter
holds become rows; an exact join with the vocabulary removes the false ones.

Words are counted in map tasks first, in dictionaries of bounded size, then summed by word. A word has at most some
two thousand neighbours, so no group is larger. Roots follow forms by pointer jumping: each form is at least ``RATIO``
times as frequent, so chains are short and the jumps are few.

Defined results: null and empty texts have no words; a null doc_id reads as empty text in the digest; repeated rows
count again; ties between forms go to the smallest in code-point order; a very long run is a word like any other; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import map_rows, stored

#: Letters of a run; only the ASCII capitals are lower-cased.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
LEAST_CHARS, LEAST_N, RATIO, SPOILT = 6, 5, 5, 199
#: Distinct words that a counting task holds before it sends them on; edits probed at a time.
HELD, EDITS = 200_000, 1 << 20
#: Bits a word, bits set by a word, bytes of filters broadcast at a time, blocks in a row of filter.
WORD_BITS, SET_BITS, ROUND_BYTES, SEGMENT = 24, 5, 32 << 20, 8192
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))

_LETTER_TABLE = bytes(ord(chr(c).lower()) if 0x41 <= c <= 0x5A else c if chr(c) in LETTERS else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The maximal runs of letters, ASCII lower-cased, in Latin-1; what Latin-1 lacks ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTER_TABLE).split() if text else []


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS, spoilt: int = SPOILT) -> DataFrame:
    """word, n: summed over all documents, after the letter that the digest of (doc_id, run) takes from one run in ``spoilt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch["_id"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for w, n in Counter(runs(text)).items():
                    if len(w) >= least_chars:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % spoilt == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least_chars:
                                continue
                        held[w] += n
                if len(held) >= HELD:
                    yield sent()
        if held:
            yield sent()

    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text").alias("_text"))
    return x.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list[str], size: int) -> np.ndarray:
    """Words of one length as rows of letter codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefixes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes (sums of code times a power of FACTOR, modulo 2^64), and the powers."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(c.shape[1] + 1, FACTOR, np.uint64)) * INVERSE
        terms = (c.astype(np.uint64) + np.uint64(1)) * powers[:-1]
        return np.concatenate([np.zeros((len(c), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1), powers


def deletions(c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each distinct deletion: of a run of equal letters the first only."""
    first = np.concatenate([np.ones((len(c), 1), bool), c[:, 1:] != c[:, :-1]], axis=1)
    with np.errstate(over="ignore"):
        cut = h[:, :-1] + (h[:, -1:] - h[:, 1:]) * INVERSE
    row, at = np.nonzero(first)
    return row, at, cut[row, at]


def replacements(c: np.ndarray, h: np.ndarray, powers: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place, new letter and hash of the replacements by larger letters, place by place."""
    for at in range(c.shape[1]):
        row, k = np.nonzero(letters[None, :] > c[:, at : at + 1])
        new = letters[k]
        with np.errstate(over="ignore"):
            yield row, np.full(len(row), at), new, h[row, -1] + (new.astype(np.uint64) - c[row, at].astype(np.uint64)) * powers[at]


def block_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's block and the bits it sets there."""
    m = mixed(h)
    at = (m >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    bits = np.zeros(len(m), np.uint64)
    for i in range(SET_BITS):
        bits |= np.uint64(1) << ((m >> np.uint64(6 * i)) & np.uint64(63))
    return at.astype(np.int64), bits


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """Which slice of its length's filter holds a hash; apart from the block, by other bits."""
    return ((mixed(h * np.uint64(3) + np.uint64(1)) >> np.uint64(40)) % np.uint64(slices)).astype(np.int64) if slices > 1 else np.zeros(len(h), np.int64)


def rounds_of(sizes: dict[int, int], most: int = ROUND_BYTES) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """By round, (length, slice) -> (slices of that length, blocks of the slice), so that no round has more than ``most`` bytes."""
    out: list[dict[tuple[int, int], tuple[int, int]]] = [{}]
    left = most
    for size, n in sorted(sizes.items()):
        slices = -(-n * WORD_BITS // 8 // (most // 2)) or 1
        blocks = -(-n * WORD_BITS // 64 // slices) + 1
        for i in range(slices):
            if blocks * 8 > left:
                out.append({})
                left = most
            out[-1][size, i] = (slices, blocks)
            left -= blocks * 8
    return out


def filters(vocabulary: DataFrame, plan: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """One round's filters, at most ROUND_BYTES: set bits in tasks, by segments of blocks; only the segments come to the driver."""
    slices = {size: n for (size, _), (n, _) in plan.items()}

    def start() -> Callable[[pa.RecordBatch], dict[str, object] | None]:
        def step(batch: pa.RecordBatch) -> dict[str, object] | None:
            out = []
            for size, words, _ in by_length(batch):
                if size in slices:
                    h = prefixes(codes(words, size))[0][:, -1]
                    s = slice_of(h, slices[size])
                    for i in np.unique(s):
                        if (size, int(i)) in plan:
                            at, bits = block_of(h[s == i], plan[size, int(i)][1])
                            out.append((np.full(len(at), size), np.full(len(at), i), at, bits.view(np.int64)))
            return dict(zip(("size", "slice", "at", "bits"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else None

        return step

    marked = map_rows(vocabulary.select("word"), "size long, slice long, at long, bits long", start).groupBy("size", "slice", "at").agg(F.bit_or("bits").alias("bits"))

    def segment(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.int64)
        out[rows["at"].to_numpy() % SEGMENT] = rows["bits"].to_numpy()
        return pa.table({"size": [key[0].as_py()], "slice": [key[1].as_py()], "segment": [key[2].as_py()], "bytes": pa.array([out.tobytes()], pa.binary())})

    rows = marked.withColumn("segment", F.expr(f"at div {SEGMENT}")).groupBy("size", "slice", "segment").applyInArrow(segment, "size long, slice long, segment long, bytes binary")
    out = {key: np.zeros(-(-blocks // SEGMENT) * SEGMENT, np.uint64) for key, (_, blocks) in plan.items()}
    for r in rows.toLocalIterator():
        out[r.size, r.slice][r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.bytes, np.uint64)
    return out


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Length, words and row numbers, in pieces whose edits are few enough."""
    words = batch["word"].to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        rows = np.nonzero(sizes == size)[0]
        step = max(1, EDITS // (int(size) * 64))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield int(size), [words[j] for j in part], part


def held(edits: tuple[np.ndarray, ...], size: int, slices: dict[int, int], plan: dict, bloom: dict) -> tuple[np.ndarray, ...]:
    """The edits whose hash (the last array) a filter of this round holds."""
    h = edits[-1]
    s, ok = slice_of(h, slices[size]), np.zeros(len(h), bool)
    for i in range(slices[size]):
        if (size, i) in plan:
            here = np.nonzero(s == i)[0]
            at, bits = block_of(h[here], plan[size, i][1])
            ok[here] = bloom[size, i][at] & bits == bits
    return tuple(x[ok] for x in edits)


def candidates(vocabulary: DataFrame, letters: np.ndarray, plan: dict[tuple[int, int], tuple[int, int]], bloom: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """word, n, near: the edits of all words that this round's filters hold."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(bloom)  # at most ROUND_BYTES
    slices = {size: n for (size, _), (n, _) in plan.items()}

    def start() -> Callable[[pa.RecordBatch], dict[str, object] | None]:
        def step(batch: pa.RecordBatch) -> dict[str, object] | None:
            own: list[int] = []
            near: list[str] = []
            for size, words, rows in by_length(batch):
                if size not in slices and size - 1 not in slices:
                    continue
                c = codes(words, size)
                h, powers = prefixes(c)
                if size - 1 in slices:
                    for r, i, _ in zip(*held(deletions(c, h), size - 1, slices, plan, shared.value), strict=True):
                        own.append(rows[r])
                        near.append(words[r][:i] + words[r][i + 1 :])
                if size in slices:
                    for edits in replacements(c, h, powers, letters):
                        for r, i, new, _ in zip(*held(edits, size, slices, plan, shared.value), strict=True):
                            own.append(rows[r])
                            near.append(words[r][:i] + chr(new) + words[r][i + 1 :])
            return {"word": batch["word"].take(pa.array(own, pa.int64())), "n": batch["n"].take(pa.array(own, pa.int64())), "near": pa.array(near, pa.string())} if own else None

        return step

    return map_rows(vocabulary, "word string, n long, near string", start)


def pairs(vocabulary: DataFrame, most: int = ROUND_BYTES) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of the vocabulary's words (word, n; stored) that one edit parts."""
    sizes = {r.size: r.n for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}  # a row per length
    used = [r.c for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()]  # LETTERS at most
    letters = np.array(sorted(ord(c) for c in used if c), np.uint8)
    one = None
    for plan in rounds_of(sizes, most):
        part = candidates(vocabulary, letters, plan, filters(vocabulary, plan))
        one = part if one is None else one.unionByName(part)
    exact = stored(one.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"), "op12-pairs")
    return exact.unionByName(exact.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def rooted(forms: DataFrame, most_n: int, ratio: int = RATIO) -> DataFrame:
    """word, root: follows forms (word, form) to the last. Each jump doubles the steps; a chain has at most log(most_n) to the base ``ratio``."""
    out, steps = forms.select("word", F.col("form").alias("root")), 1
    while ratio**steps < most_n:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = stored(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "op12-roots")
        steps *= 2
    return out


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, ratio: int = RATIO, spoilt: int = SPOILT, most: int = ROUND_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least ``least_chars`` letters that occurs ``least_n`` times."""
    vocabulary = stored(counted(docs, least_chars, spoilt).where(F.col("n") >= least_n), "op12-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = pairs(vocabulary, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    near = stored(near.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "op12-near")
    roots = rooted(near.where("form IS NOT NULL"), vocabulary.agg(F.max("n")).first()[0] or 0, ratio)
    x = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def score(docs: DataFrame) -> DataFrame:
    """The query's columns over whole ``documents``."""
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
