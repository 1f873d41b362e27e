"""Operator 9, quality rules: base counts of a text, then tokeniser fertility against bands per language or script.

Public vocabularies split each word: one of pieces with byte fallback, which gives characters per token, the share of
byte-fallback tokens and token entropy (bits), and one of bytes, which gives characters per token again. All must lie in
the bands of the document's language; a language with fewer than ``MIN_DOCS`` measured documents takes the bands of its
script (that of most of a text's letters), a script with fewer those of all documents. Bands come from exact quartiles,
to a thousandth, over all documents that pass the base rules (each distinct set of figures counts once, so copies don't
move them), and don't depend on how rows are dealt.

Defined results: a null or empty text has no words, fails the base and is not kept; a null language is a language of
its own; a text without letters has script ``none``; where nothing passes the base rules nothing is kept; figures on a
band's edge are inside; repeated rows are each judged; very long texts and words are measured whole; an empty table
gives no rows; other columns pass through ``keep_good`` whatever their names.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import BLANKS, map_rows, numbered, renamed, small_batches, stored, words

VOCABULARY, BYTE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MIN_DOCS = 50
#: Half-widths of the bands: in interquartile ranges, and at least this part of the median.
SPREAD, CPT_PART, ENTROPY_PART, FALLBACK_LEAST = 5.0, 0.12, 0.2, 0.05
CACHE_WORDS, CHUNK_DOCS, CHUNK_CHARS = 100_000, 64, 400_000
#: Up to so many rows of bands are broadcast; more are joined, where Spark splits large languages.
BROADCAST_BANDS = 20_000
METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, chars_per_byte_token double, fallback_share double, token_entropy double, script string"
)
NAMES = [x.split()[0] for x in METRICS.split(", ")]
FIGURES = ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")


class Fertility:
    """Word and token figures of chunks of texts; pieces of a word are kept between chunks, up to a fixed number of words."""

    def __init__(self, model: bytes, ranks: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        self.n_pieces = self.sp.vocab_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.n_pieces)])
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32), 0
        self.byte_size, self.letters = np.zeros(1, np.int64), np.zeros((1, len(SCRIPTS)), np.int32)

    def learn(self, fresh: list[str]) -> None:
        pieces = self.sp.encode(fresh, num_threads=1)
        n, sizes = len(self.ids), np.fromiter(map(len, pieces), np.int64, len(fresh))
        flat = np.fromiter((p for x in pieces for p in x), np.int32, int(sizes.sum()))
        self.ids.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        more = np.array([len(self.bytes.encode_ordinary(" " + w)) for w in fresh], np.int64)
        by_script = np.array([letters(w) for w in fresh], np.int32)
        for name, new, used in (("start", self.used + np.cumsum(sizes) - sizes, n), ("size", sizes, n), ("byte_size", more, n), ("letters", by_script, n), ("flat", flat, self.used)):
            old = getattr(self, name)
            if used + len(new) > len(old):
                old = np.concatenate([old[:used], np.empty((used + 2 * len(new), *old.shape[1:]), old.dtype)])
            old[used : used + len(new)] = new
            setattr(self, name, old)
        self.used += len(flat)

    def measure(self, texts: list[str]) -> list[np.ndarray]:
        docs = [words(t) for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.forget()
        fresh = {w for d in docs for w in d if w not in self.ids}
        if fresh:
            self.learn(list(fresh))
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter((self.ids[w] for d in docs for w in d), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(docs)), n)
        size = self.size[ids]
        n_tokens = np.bincount(doc, size, len(docs)).astype(np.int64)
        ends = np.cumsum(size)
        tokens = self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        of = np.repeat(doc, size)
        fallback = np.bincount(of, self.is_byte[tokens], len(docs))
        key, count = np.unique(of * self.n_pieces + tokens, return_counts=True)
        of = key // self.n_pieces
        total = np.maximum(n_tokens, 1)
        p = count / total[of]
        entropy = np.bincount(of, -p * np.log2(p), len(docs))
        chars = np.array([len(t) - sum(t.count(c) for c in BLANKS) for t in texts], np.int64)
        n_bytes = np.maximum(np.bincount(doc, self.byte_size[ids], len(docs)), 1)
        scripts = np.zeros((len(docs), len(SCRIPTS)), np.int64)
        for k in range(1, len(SCRIPTS)):
            scripts[:, k] = np.bincount(doc, self.letters[ids, k], len(docs))
        script = np.array(SCRIPTS, object)[scripts.argmax(1)]
        return [n, chars, *base_counts(texts), repeat_words(ids, n), n_tokens, chars / total, chars / n_bytes, fallback / total, entropy, script]


#: Scripts, by the first word of their letters' Unicode names; a text without letters has the first.
SCRIPTS = ("none", "other", "LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "BENGALI", "THAI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL")
_OF_CHAR: dict[str, int] = {}


def letters(word: str) -> list[int]:
    """A word's letters by script."""
    if word.isascii():
        n = sum(map(str.isalpha, word))
        return [0, 0, n, *[0] * (len(SCRIPTS) - 3)]
    out = [0] * len(SCRIPTS)
    for c in word:
        k = _OF_CHAR.get(c)
        if k is None:
            name = unicodedata.name(c, "").partition(" ")[0]
            k = _OF_CHAR[c] = 0 if not c.isalpha() else SCRIPTS.index(name) if name in SCRIPTS else 1
        out[k] += 1
    return [0, *out[1:]]


def base_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the symbols and the lines with a word that equal an earlier line."""
    symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup[i] = len(lines) - len(set(lines))
    return symbols, dup


def repeat_words(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per document, words in windows of three that occur twice or more in it. ids: all documents' words, n: words of each."""
    out = np.zeros(len(n), np.int64)
    if len(ids) < 3:
        return out
    doc = np.repeat(np.arange(len(n)), n)
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    _, which, count = np.unique(triple[inside] * len(n) + doc[inside], return_inverse=True, return_counts=True)
    hit = inside[count[which] > 1]
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[hit + k] = True
    return np.bincount(doc, marked, len(n)).astype(np.int64)


def measure(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY, text: str = "text") -> DataFrame:
    """The columns in ``keep`` with every text's figures; the text column goes to Python once, also if it is kept. Only the driver reads the vocabulary files (1.3 MB)."""
    files = []
    for path in (vocabulary, byte_vocabulary):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        fertility = Fertility(*shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            parts, chunk, chars = [], [], 0
            for x in batch.column(at):
                chunk.append(x.as_py() or "")
                chars += len(chunk[-1])
                if len(chunk) == CHUNK_DOCS or chars > CHUNK_CHARS:
                    parts.append(fertility.measure(chunk))
                    chunk, chars = [], 0
            if chunk:
                parts.append(fertility.measure(chunk))
            return {c: batch.column(i) for i, c in enumerate(keep)} | {c: pa.array(np.concatenate([p[i] for p in parts])) for i, c in enumerate(NAMES)}

        return step

    return map_rows(docs.select(*sent), f"{schema}, {METRICS}", start)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """_lang, _script, and lower and upper bounds of the figures for each pair of language and script that occurs."""
    passed = measured.where(~base_failed()).select("lang", "script", "n_words", *FIGURES).distinct()
    q = lambda c: F.percentile(F.round(c, 3), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c)
    # exact, as a figure to a thousandth has a few ten thousand values at most
    found = passed.groupingSets([["lang"], ["script"], []], "lang", "script").agg(F.grouping_id("lang", "script").alias("_level"), F.count("*").alias("_n"), *map(q, FIGURES))
    level = lambda k: found.where(F.col("_level") == k).select("lang", "script", F.struct("_n", *FIGURES).alias(f"_{k}"))
    pairs = measured.select(F.col("lang").alias("_lang"), F.col("script").alias("_script")).distinct()
    # a language has _level 1 (the script is summed over), a script 2, all documents 3
    x = pairs.join(level(1).drop("script"), F.col("_lang").eqNullSafe(F.col("lang")), "left").drop("lang")
    x = x.join(level(2).drop("lang"), F.col("_script") == F.col("script"), "left").drop("script").join(level(3).drop("lang", "script"), F.lit(True), "left")
    enough = lambda k: F.when(F.col(f"_{k}._n") >= MIN_DOCS, F.col(f"_{k}"))
    x = x.withColumn("_b", F.coalesce(enough(1), enough(2), F.col("_3")))
    at = lambda c, i: F.col(f"_b.{c}")[i]
    wide = lambda c: SPREAD * (at(c, 2) - at(c, 0))
    low = lambda c, part: F.least(at(c, 0) - wide(c), at(c, 1) * (1 - part))
    high = lambda c, part: F.greatest(at(c, 2) + wide(c), at(c, 1) * (1 + part))
    cpt, more, fall, ent = FIGURES
    return x.select(
        "_lang", "_script",
        low(cpt, CPT_PART).alias("_cpt_low"), high(cpt, CPT_PART).alias("_cpt_high"),
        low(more, CPT_PART).alias("_more_low"), high(more, CPT_PART).alias("_more_high"),
        F.greatest(at(fall, 2) + wide(fall), F.lit(FALLBACK_LEAST)).alias("_fallback_high"),
        low(ent, ENTROPY_PART).alias("_entropy_low"),
    )


def judged(measured: DataFrame) -> DataFrame:
    """Measured rows with base_failed and kept. Reads its input several times: pass a stored table."""
    cpt, more, fall, ent = map(F.col, FIGURES)
    inside = (
        cpt.between(F.col("_cpt_low"), F.col("_cpt_high"))
        & more.between(F.col("_more_low"), F.col("_more_high"))
        & (fall <= F.col("_fallback_high"))
        & (ent >= F.col("_entropy_low"))
    )
    own = stored(bands(measured), "op9-bands")
    few = F.broadcast(own) if own.count() <= BROADCAST_BANDS else own
    x = measured.join(few, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("script") == F.col("_script")), "left")
    x = x.withColumn("base_failed", base_failed())
    return x.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*measured.columns, "base_failed", "kept")


def score(docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and the fertility figures."""
    with small_batches(docs.sparkSession):
        measured = stored(measure(docs, ["doc_id", "lang"], vocabulary, byte_vocabulary), "op9")
    x = judged(measured)
    return x.select("doc_id", *NAMES[:5], "base_failed", "kept", *NAMES[5:])


def keep_good(docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = numbered(docs)
    x = docs.select(*own, "lang")
    text = next(f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() == "text")
    with small_batches(docs.sparkSession):
        measured = stored(measure(x, x.columns, vocabulary, byte_vocabulary, text), "op9")
    return renamed(judged(measured).where("kept"), docs)
