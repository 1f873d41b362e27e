"""Comparing samples: distances between distributions, code sequences, vectors and reconstructions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

EPS = 1e-10


def cdf_steps(df: DataFrame, by: list[str], sample: str = "sample", value: str = "value", buckets: int = 1024) -> DataFrame:
    """by, value, f, g, gap: empirical CDFs of samples 0 and 1 after each distinct value, and the distance to the next value.

    Values are dealt to buckets of equal width per key; running counts of buckets carry into the buckets, so that not
    even a single key's values are ordered in one task.
    """
    x = df.groupBy(*by, value).agg(F.count_if(F.col(sample) == 0).alias("_a"), F.count_if(F.col(sample) == 1).alias("_b"))
    ends = x.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    y = x.join(ends, by) if by else x.crossJoin(F.broadcast(ends))  # one row without keys
    cell = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets, F.lit(0.0))
    y = y.withColumn("_k", F.least(F.floor(cell), F.lit(buckets - 1)).cast("int"))
    sums = y.groupBy(*by, "_k").agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.min(value).alias("_first"))
    part = Window.partitionBy(*by)
    before = part.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_p{c}": F.coalesce(F.sum(f"_s{c}").over(before), F.lit(0)) for c in "ab"} | {f"n{c}": F.sum(f"_s{c}").over(part) for c in "ab"} | {"_next": F.lead("_first").over(part.orderBy("_k"))}
    inside = Window.partitionBy(*by, "_k").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = y.withColumns({"_ra": F.sum("_a").over(upto), "_rb": F.sum("_b").over(upto), "_after": F.lead(value).over(inside)})
    y = y.join(sums.withColumns(carried).drop("_sa", "_sb", "_first"), [*by, "_k"])
    f, g = (F.try_divide(F.col(f"_p{c}") + F.col(f"_r{c}"), F.col(f"n{c}")) for c in "ab")
    return y.select(*by, value, f.alias("f"), g.alias("g"), "na", "nb", (F.coalesce("_after", "_next") - F.col(value)).alias("gap"))


def kolmogorov_text(d: str = "d", na: str = "na", nb: str = "nb", terms: int = 20) -> str:
    """Limit distribution's tail at (e + 0.12 + 0.11/e) d, e = sqrt(na nb / (na + nb))."""
    e = f"sqrt({na} * CAST({nb} AS DOUBLE) / ({na} + {nb}))"
    t = f"(({e} + 0.12 + 0.11 / {e}) * {d})"
    series = " + ".join(f"{'' if k % 2 else '-'}2 * exp(-2.0 * {k * k} * {t} * {t})" for k in range(1, terms + 1))
    return f"(CASE WHEN {t} < 0.2 THEN 1.0 ELSE least(greatest({series}, 0.0), 1.0) END)"


def ks_two_sample(df: DataFrame, by: list[str]) -> DataFrame:
    x = cdf_steps(df, by).groupBy(*by).agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return x.withColumn("p_value", F.expr(kolmogorov_text()))


def wasserstein(df: DataFrame, by: list[str]) -> DataFrame:
    return cdf_steps(df, by).groupBy(*by).agg(F.sum(F.abs(F.col("f") - F.col("g")) * F.coalesce("gap", F.lit(0.0))).alias("w1"))


def frequencies(df: DataFrame, by: list[str], code: str, vocabulary: int) -> DataFrame:
    """by, code, n, freq of every code 0..vocabulary-1, zeros included."""
    got = df.groupBy(*by, code).agg(F.count("*").alias("n"))
    keys = got.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = keys.crossJoin(df.sparkSession.range(vocabulary).select(F.col("id").cast("int").alias(code)))
    x = full.join(got, [*by, code], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def js_divergence(p: str = "p", q: str = "q") -> Column:
    """Aggregate over rows of two histograms, each smoothed by 1e-10; pass normalised columns."""
    m = (F.col(p) + F.col(q)) / 2
    return F.sum(F.col(p) * F.ln(F.col(p) / m) + F.col(q) * F.ln(F.col(q) / m)) / 2


def smoothed(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = df.withColumns({c: F.col(c) + EPS for c in columns})
    return x.withColumns({c: F.col(c) / F.sum(c).over(part) for c in columns})


def transitions(df: DataFrame, by: list[str], seq: list[str], order: str, code: str = "code") -> DataFrame:
    """by, from, to, p: shares of the next code inside sequences."""
    nxt = F.lead(code).over(Window.partitionBy(*by, *seq).orderBy(order))
    x = df.withColumn("to", nxt).where("`to` IS NOT NULL").groupBy(*by, F.col(code).alias("from"), "to").agg(F.count("*").alias("n"))
    return x.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from")))


def ngrams(df: DataFrame, by: list[str], seq: list[str], order: str, n: int, code: str = "code") -> DataFrame:
    w = Window.partitionBy(*by, *seq).orderBy(order)
    x = df.withColumn("gram", F.concat_ws("-", code, *[F.lead(code, k).over(w) for k in range(1, n)])).withColumn("_last", F.lead(code, n - 1).over(w))
    return x.where("_last IS NOT NULL").groupBy(*by, "gram").agg(F.count("*").alias("n"))


def compare_top(counts: DataFrame, k: int = 20, sample: str = "sample") -> DataFrame:
    """common, overlap, corr: the k most frequent grams of samples 0 and 1 (ties by text); correlation of counts over those that both have, 0 where it isn't defined."""
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= k)
    a, b = (top.where(F.col(sample) == v).select("gram", F.col("n").cast("double").alias(n)) for v, n in ((0, "a"), (1, "b")))
    corr = F.corr("a", "b")
    return a.join(b, "gram").agg(F.count("*").alias("common"), (F.count("*") / k).alias("overlap"), F.coalesce(F.when(~F.isnan(corr), corr), F.lit(0.0)).alias("corr"))


def compare_all(counts: DataFrame, sample: str = "sample") -> DataFrame:
    """common, corr: the grams that samples 0 and 1 share, of all, and the correlation of their shares (that of their counts, as a sample's total is one factor)."""
    a, b = (counts.where(F.col(sample) == v).select("gram", F.col("n").cast("double").alias(n)) for v, n in ((0, "a"), (1, "b")))
    corr = F.corr("a", "b")
    return a.join(b, "gram").agg(F.count("*").alias("common"), F.when(~F.isnan(corr), corr).alias("corr"))


def mmd_linear(df: DataFrame, vector: str = "v", sample: str = "sample") -> DataFrame:
    """Unbiased squared MMD with the linear kernel, from sums of x and of |x|^2 only."""
    x = df.select(sample, F.posexplode(vector).alias("i", "x"))
    s = x.groupBy("i").agg(*[F.sum(F.when(F.col(sample) == k, F.col("x"))).alias(f"s{k}") for k in (0, 1)], *[F.sum(F.when(F.col(sample) == k, F.col("x") * F.col("x"))).alias(f"q{k}") for k in (0, 1)], *[F.count_if(F.col(sample) == k).alias(f"n{k}") for k in (0, 1)])
    within = lambda k: (F.sum(F.col(f"s{k}") * F.col(f"s{k}")) - F.sum(f"q{k}")) / (F.max(f"n{k}") * (F.max(f"n{k}") - 1))
    return s.agg((within(0) + within(1) - 2 * F.sum(F.col("s0") * F.col("s1")) / (F.max("n0") * F.max("n1"))).alias("mmd2"))


def mmd_rbf(df: DataFrame, key: str, gamma: float, blocks: int, vector: str = "v", sample: str = "sample") -> DataFrame:
    """Unbiased squared MMD with the Gaussian kernel: rows dealt to blocks, kernel sums per pair of blocks, one final sum.

    Work is quadratic in the sample by definition; pass a bounded sample.
    """
    x = df.select(F.col(sample).cast("int").alias("s"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    packed = x.groupBy("b").agg(F.collect_list("s").alias("s"), F.collect_list("v").alias("v"))
    pairs = packed.join(packed.select(F.col("b").alias("c"), F.col("s").alias("s2"), F.col("v").alias("v2")), F.col("b") <= F.col("c"))

    def sums(batches):
        for pdf in batches:
            out = []
            for b, c, s, s2, v, v2 in zip(pdf.b, pdf.c, pdf.s, pdf.s2, pdf.v, pdf.v2, strict=True):
                p, q = np.stack(v), np.stack(v2)
                k = np.exp(-gamma * np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T, 0))
                if b == c:
                    np.fill_diagonal(k, 0)
                i, j = np.asarray(s)[:, None], np.asarray(s2)[None]
                m = 1 if b == c else 2
                out.append((m * k[(i == 0) & (j == 0)].sum(), m * k[(i == 1) & (j == 1)].sum(), m * k[i != j].sum()))
            yield pd.DataFrame(out, columns=["k0", "k1", "kx"])

    n = x.agg(F.count_if(F.col("s") == 0).alias("n0"), F.count_if(F.col("s") == 1).alias("n1"))
    t = pairs.mapInPandas(sums, "k0 double, k1 double, kx double").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"), F.sum("kx").alias("kx"))
    return t.crossJoin(n).select((F.col("k0") / (F.col("n0") * (F.col("n0") - 1)) + F.col("k1") / (F.col("n1") * (F.col("n1") - 1)) - F.col("kx") / (F.col("n0") * F.col("n1"))).alias("mmd2"))


def _run_sums(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds up n and g (doubles as bytes) of rows with equal keys, which stand together; one block is held at a time."""
    held: tuple | None = None
    for batch in batches:
        cols = [batch[c].to_pylist() for c in (*keys, "n", "g")]
        for *key, n, g in zip(*cols, strict=True):
            if held is None or held[0] != key:
                if held is not None:
                    yield _block(held, schema)
                held = [key, 0, np.zeros(len(g) // 8)]
            held[1] += n
            held[2] += np.frombuffer(g)
    if held is not None:
        yield _block(held, schema)


def _block(held: list, schema: pa.Schema) -> pa.RecordBatch:
    key, n, g = held
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, n, g.tobytes()), schema, strict=True)], schema=schema)


def gram_blocks(df: DataFrame, by: list[str], dims: int, vector: str = "v", block: int = 128) -> DataFrame:
    """by, a, b, n, g: the Gram matrix of (1, vector) in blocks of dimensions (a <= b), g the block's doubles as bytes.

    A task adds the products of its rows block by block; blocks are shuffled by their place and added one after the
    other. So a task holds one matrix of its rows' sums for each key that it meets in a batch, and then single blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    width, cuts = dims + 1, list(range(0, dims + 1, block))
    schema = StructType.fromDDL(", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "a int, b int, n long, g binary")
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, own in pdf.groupby(by) if by else [((), pdf)]:
                m = np.ones((len(own), width))
                m[:, 1:] = np.stack(own[vector].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame([(*key, a, b, len(own), (m[:, a : a + block].T @ m[:, b : b + block]).tobytes()) for a in cuts for b in cuts if a <= b], columns=schema.names)

    keys = [*by, "a", "b"]
    parts = df.select(*by, vector).mapInPandas(partial, schema).repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(lambda batches: _run_sums(batches, keys, arrow), schema)


def correlations(df: DataFrame, by: list[str], dims: int, vector: str = "v", block: int = 128) -> DataFrame:
    """by, i, j, r (i <= j): correlations of all pairs of dimensions, 0 where one doesn't vary; by blocks, so that hundreds of thousands of pairs are no expressions."""
    g = gram_blocks(df, by, dims, vector, block)
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                m = np.frombuffer(r.g)
                rows = min(block, dims + 1 - r.a)
                i, j = np.divmod(np.arange(len(m)), len(m) // rows)
                i, j = i + r.a - 1, j + r.b - 1  # -1 is the column of ones
                ok = i <= j
                out = pd.DataFrame({"i": i[ok], "j": j[ok], "x": m[ok], "n": r.n})
                for c in by:
                    out.insert(0, c, getattr(r, c))
                yield out[[*by, "i", "j", "x", "n"]]

    x = g.mapInPandas(cells, f"{types}i int, j int, x double, n long")
    own = x.where("i = -1 AND j >= 0").select(*by, F.col("j").alias("i"), F.col("x").alias("s"))
    own = own.join(x.where("i = j").select(*by, "i", F.col("x").alias("q"), "n"), [*by, "i"])
    # below rounding a dimension doesn't vary
    var = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    own = own.select(*by, "i", "s", F.when(var > 1e-12 * F.col("q"), var).alias("v"))
    a = x.where("i >= 0").join(own.withColumnsRenamed({"v": "vi", "s": "si"}), [*by, "i"]).join(own.withColumnsRenamed({"i": "j", "v": "vj", "s": "sj"}), [*by, "j"])
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("vi").isNotNull(), 1.0)).otherwise((F.col("x") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(F.col("vi") * F.col("vj")))
    return a.select(*by, "i", "j", F.coalesce(r, F.lit(0.0)).alias("r"))


def correlation_distance(r: DataFrame, sample: str = "sample") -> DataFrame:
    """Whole matrices of samples 0 and 1 (i <= j given): Frobenius norm and correlation, mean and largest absolute difference."""
    x = r.groupBy("i", "j").agg(*[F.max(F.when(F.col(sample) == k, F.col("r"))).alias(n) for k, n in ((0, "p"), (1, "q"))])
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    d, total = F.col("p") - F.col("q"), lambda e: F.sum(twice * e)
    corr = F.try_divide(total(F.col("p") * F.col("q")), F.sqrt(total(F.col("p") * F.col("p"))) * F.sqrt(total(F.col("q") * F.col("q"))))
    return x.agg(F.sqrt(total(d * d)).alias("frobenius"), F.coalesce(corr, F.lit(0.0)).alias("frobenius_corr"), (total(F.abs(d)) / F.sum(twice)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"))


def _checked(book: DataFrame, most: int) -> DataFrame:
    """A codebook that is broadcast: its numbers are counted first."""
    numbers = book.agg(F.sum(F.size("e"))).first()[0] or 0
    if numbers > most:
        raise ValueError(f"codebooks have {numbers} numbers; {most} at most are broadcast")
    return F.broadcast(book)


def fit_codes_by(df: DataFrame, by: list[str], k: int, keep: Callable[[DataFrame, str], DataFrame], rounds: int = 10, key: str = "vec_id", vector: str = "v", most: int = 8_000_000) -> DataFrame:
    """by, code, e: a k-means codebook for every key, all keys in one pass a round.

    Each key starts from the k rows whose key column has the least digests. In a round a task finds the nearest of its
    rows' codewords (the lowest on ties) in numpy and adds up the rows of each, so that a task sends one row a codeword
    and component; the codebooks (``most`` numbers at most, 64 MB) go to all tasks. A codeword without rows stays. It
    ends when no codeword moves, or after ``rounds``.
    """
    digest = F.md5(F.col(key).cast("string"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(digest, key))
    # each round reads them again, in as many tasks as the session has partitions
    df = keep(df.select(*by, key, vector).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, key), "vectors")
    start = df.withColumn("code", rank).where(F.col("code") <= k).withColumn("code", F.col("code") - 1)
    book = keep(start.select(*by, "code", F.col(vector).alias("e")), "codes")
    for _ in range(rounds):
        sums = code_sums(df, book, by, vector, most).groupBy(*by, "code", "i").agg((F.try_divide(F.sum("s"), F.sum("n"))).alias("m"))
        sums = sums.groupBy(*by, "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("_new"))
        moved = keep(book.join(sums, [*by, "code"], "left").select(*by, "code", F.coalesce("_new", "e").alias("e"), F.coalesce(F.col("_new") != F.col("e"), F.lit(False)).alias("_moved")), "codes")
        book = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            break
    return book


def code_sums(df: DataFrame, book: DataFrame, by: list[str], vector: str = "v", most: int = 8_000_000) -> DataFrame:
    """by, code, i, s, n: of each codeword's rows, the sum and number of the values of component i; one row of each from a task."""
    _checked(book, most)
    held: dict[tuple, list] = {}
    for r in book.select(*by, "code", "e").collect():
        held.setdefault(tuple(r[c] for c in by), []).append((r.code, r.e))
    # of each key: its codes, and their words as rows
    books = {}
    for k, own in held.items():
        own.sort(key=lambda r: r[0])
        words = np.full((len(own), max(len(e) for _, e in own)), np.nan)
        for row, (_, e) in zip(words, own, strict=True):
            row[: len(e)] = e
        if None not in k:
            books[k] = [c for c, _ in own], words
    shared = df.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", code int, i int, s double, n long"
    types = [df.schema[c].dataType for c in by]

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by))), strict=True)):
                rows.setdefault(key, []).append(at)
            for key in rows.keys() & shared.value.keys():
                codes, words = shared.value[key]
                own = batch.column(len(by)).take(pa.array(rows[key]))
                flat, size = own.flatten(), own.value_lengths().to_numpy()
                width = max(words.shape[1], int(size.max()))
                # a vector that lacks a component is near none: it goes to the lowest code, and counts where it has values
                v, has = np.full((len(size), width), np.nan), np.zeros((len(size), width), bool)
                inside = np.arange(width) < size[:, None]
                v[inside], has[inside] = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
                words = np.pad(words, ((0, 0), (0, width - words.shape[1])), constant_values=np.nan)
                step = max(1, (1 << 21) // words.size)
                for lo in range(0, len(v), step):
                    some, given = v[lo : lo + step], has[lo : lo + step]
                    far = ((some[:, None, :] - words[None]) ** 2).sum(2)
                    code = np.where(np.isnan(far), np.inf, far).argmin(1)
                    for c in np.unique(code):
                        hit = code == c
                        add = np.stack([np.where(given[hit], some[hit], 0.0).sum(0), given[hit].sum(0)])
                        old = total.get((*key, codes[c]), np.zeros((2, 0)))
                        total[(*key, codes[c])] = add + np.pad(old, ((0, 0), (0, width - old.shape[1]))) if old.shape[1] <= width else old + np.pad(add, ((0, 0), (0, old.shape[1] - width)))
        keys = [(*k, i, s, int(n)) for k, both in total.items() for i, (s, n) in enumerate(both.T.tolist())]
        columns = list(zip(*keys, strict=True)) if keys else [()] * (len(by) + 4)
        kinds = [*(to_arrow_type(t) for t in types), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*by, "code", "i", "s", "n"])

    return df.where(F.size(vector) > 0).select(*by, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def nearest(df: DataFrame, book: DataFrame, by: list[str], vector: str = "v", most: int = 8_000_000) -> DataFrame:
    """The rows with the code of the nearest codeword of their key, the lowest on ties, and its squared distance."""
    books = book.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("code", "e"))).alias("_book"))
    _checked(book, most)
    far = F.transform("_book", lambda c: F.struct(F.aggregate(F.zip_with(F.col(vector), c["e"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["code"].alias("code")))
    return df.join(F.broadcast(books), by).withColumn("_best", F.array_min(far)).select(*df.columns, F.col("_best.code").alias("code"), F.col("_best.d").alias("distance"))


def assign_codes(df: DataFrame, codebook: DataFrame, vector: str = "v", most: int = 8_000_000) -> DataFrame:
    """code of the nearest codeword, the lowest on ties, and its squared distance. The codebook (code, e) is a model of bounded size."""
    _checked(codebook, most)
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "e"))).alias("_book"))
    far = F.transform("_book", lambda c: F.struct(F.aggregate(F.zip_with(F.col(vector), c["e"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["code"].alias("code")))
    return df.crossJoin(F.broadcast(book)).withColumn("_best", F.array_min(far)).select(*df.columns, F.col("_best.code").alias("code"), F.col("_best.d").alias("distance"))
