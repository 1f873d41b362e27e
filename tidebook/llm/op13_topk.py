"""Operator 13, exact top-k search by distributed histogram selection.

Queries and candidates are dealt into groups of bounded size, and a task scores one group of queries against one of
candidates as a matrix product. Every score is counted in a histogram of its query; summed over all tasks, the
histograms tell which bin holds the kth highest score, and the next round divides that bin, until it is one value wide.
A last scoring pass keeps what is above the kth value, and of what equals it the smallest ids that are still needed.
A task sends of a histogram only the bins from the top down to where its own scores already make up what is wanted:
no bin below that can hold the kth value of all.

Nothing is broadcast and no list of scores is ever gathered: a round moves counts, the last pass at most k rows for each
query and task. The rounds are as many as the range of scores needs (two for unit vectors), whatever the number of rows.

Defined results: a component x becomes floor(256 * x) in double. Vectors that are null or hold null or non-finite
components take no part, nor do those whose integer components' squares sum to more than 2^60, as scores could leave
long. A query's candidates are all rows of its own length but itself; rows that share an id or are alike are rows of
their own, and so are their queries. Ties go to the smaller id, null ids last; a null id is no query. Vectors without
components score 0. Fewer candidates than k are all returned. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import stored

SCALE, MOST_SQUARES = 256, 2**60
K, EVERY = 5, 50
#: Candidates and queries of a task, scores worked out at a time, bins of a histogram.
CANDIDATES, QUERIES, SCORES, BINS = 8192, 4096, 1 << 20, 1024
#: Below this bound whole numbers are exact in double, so that the product may run there.
EXACT = 2**53


def prepared(vectors: DataFrame, is_query: Column) -> DataFrame:
    """r (a number of the row), vec_id, is_query, v (integer components) and sq (their squares' sum) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = vectors.where(F.col("embedding").isNotNull()).where(~bad).select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    x = x.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")))
    return x.where(F.col("sq") <= MOST_SQUARES).withColumn("r", F.monotonically_increasing_id())


def _matrix(lists: pa.ChunkedArray, exact: bool) -> np.ndarray:
    n = len(lists)
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(n, len(flat) // n).astype(np.float64 if exact else np.int64))


def _scored(c: pa.Table, q: pa.Table, exact: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of queries with their scores and which of them count (not a query's own row)."""
    cv, qv = _matrix(c["v"], exact), _matrix(q["v"], exact)
    cr, qr = c["r"].to_numpy(), q["r"].to_numpy()
    step = max(1, SCORES // len(cr))
    for i in range(0, len(qr), step):
        part = slice(i, i + step)
        yield part, (qv[part] @ cv.T).astype(np.int64), cr[None, :] != qr[part][:, None]


def counted(k: int, exact: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """r, bin, n: the histograms of a task's queries inside their intervals [lo, lo + span), from the top to where ``k - above`` are counted."""

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if c.num_rows and q.num_rows:
            r, lo, span, above = (q[name].to_numpy() for name in ("r", "lo", "span", "above"))
            width = -(-span // BINS)
            for part, s, ok in _scored(c, q, exact):
                off = s - lo[part][:, None]
                ok &= (off >= 0) & (off < span[part][:, None])
                at, _ = np.nonzero(ok)
                n = len(s)
                h = np.bincount(at * BINS + off[ok] // width[part][at], minlength=n * BINS).reshape(n, BINS)
                higher = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
                a, b = np.nonzero((h > 0) & (higher < (k - above[part])[:, None]))
                out.append((r[part][a], b, h[a, b]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("r", "bin", "n"), cols, strict=True)})

    return run


def filtered(k: int, exact: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """r, query_id, vec_id, score: what lies above the kth value, and of what equals it the smallest ids still needed."""

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        order = c.sort_by([("vec_id", "ascending")]) if c.num_rows else c  # nulls come last
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if c.num_rows and q.num_rows:
            lo, above = q["lo"].to_numpy(), q["above"].to_numpy()
            for part, s, ok in _scored(order, q, exact):
                tie = ok & (s == lo[part][:, None])
                tie &= np.cumsum(tie, axis=1) <= (k - above[part])[:, None]
                a, b = np.nonzero(tie | ok & (s > lo[part][:, None]))
                out.append((a + part.start, b, s[a, b]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 3
        return pa.table({"r": q["r"].take(pa.array(a)), "query_id": q["query_id"].take(pa.array(a)), "vec_id": order["vec_id"].take(pa.array(b)), "score": pa.array(s, pa.int64())}, schema=pa.schema([("r", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row of ``vectors`` (vec_id long, embedding) that ``is_query`` marks."""
    x = stored(prepared(vectors, is_query), "op13")
    known = x.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max("sq").alias("sq")).first()
    groups, sets = (max(1, -(-n // most)) for n, most in ((known.n, CANDIDATES), (known.q, QUERIES)))
    most = math.isqrt(int(known.sq or 0)) + 1
    exact = most * most < EXACT
    one = lambda n, salt: F.pmod(F.xxhash64("r", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = x.select("r", "vec_id", "v", F.size("v").alias("d"), one(groups, 1).alias("g")).withColumn("s", every(sets)).groupBy("d", "g", "s")
    # aliases tell the two sides of the cogroup apart
    ask = x.where("is_query").select(F.col("r").alias("r"), F.col("vec_id").alias("query_id"), F.col("v").alias("v"), "sq")
    # no score of a query is larger than its norm times the largest, rounded up
    reach = (F.ceil(F.sqrt("sq") * float(most) * (1 + 1e-9)) + 1).cast("long")
    state = ask.select("r", (-reach).alias("lo"), (2 * reach + 1).alias("span"), F.lit(0).cast("long").alias("above"))
    dealt = lambda s: ask.drop("sq").join(s, "r").withColumns({"d": F.size("v"), "s": one(sets, 2)}).withColumn("g", every(groups)).groupBy("d", "g", "s")
    span = 2 * (most * most + 2 * most) + 4
    while span > 1:
        bins = cand.cogroup(dealt(state)).applyInArrow(counted(k, exact), "r long, bin long, n long").groupBy("r", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("r").orderBy(F.desc("bin")))
        found = bins.withColumn("upto", upto).join(state.select("r", "above"), "r").groupBy("r").agg(
            F.max_by("bin", F.when(F.col("upto") >= k - F.col("above"), F.col("bin"))).alias("bin"),
            F.coalesce(F.max(F.when(F.col("upto") < k - F.col("above"), F.col("upto"))), F.lit(0)).alias("more"),
        )
        width = F.ceil(F.col("span") / BINS).cast("long") if span < EXACT else F.expr(f"(span + {BINS - 1}) div {BINS}")
        # without such a bin all candidates are fewer than k, and the lower end takes them all
        state = stored(state.join(found, "r", "left").select("r", (F.col("lo") + F.coalesce(F.col("bin"), F.lit(0)) * width).alias("lo"), width.alias("span"), (F.col("above") + F.coalesce("more", F.lit(0))).alias("above")), "op13-state")
        span = -(-span // BINS)
    hits = cand.cogroup(dealt(state)).applyInArrow(filtered(k, exact), "r long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def score(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The top ``k`` of the rows whose vec_id is divisible by ``every``."""
    return top_k(vectors, F.col("vec_id") % every == 0, k)


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}
"""
