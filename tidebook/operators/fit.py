"""Choosing normalising transforms and half-lives: scores, fits and votes over the long form (key columns, value)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import frames
from tidebook.sources import tables

TRANSFORMS = ("identity", "log", "sqrt", "arcsinh", "box_cox", "yeo_johnson")
HALF_LIVES = (5, 10, 20, 40, 80)
WORST = 999.0
#: Rows of a series that a task scores at once, and how many of the last values before them it walks to find the state they start from.
SCORE_ROWS, WALKED = 65536, 4096
#: Of a task that sums over grid points: keys held, and rows worked on at once.
KEYS_HELD, CELLS_ROWS = 4096, 4096


def pearson_p_df(df: DataFrame, by: list[str], value: str = "value", finite: bool = True) -> DataFrame:
    """by, n, score: chi-square over bins of equal normal probability, over k - 3; fewer than 20 values or no spread: 999.

    Two aggregations: moments, then counts per bin. k is 5, 10 or 20 by the number of values. NaN takes no part and an
    infinite spread scores 999; with ``finite`` off both count, and leave all values of their key in the last bin.
    """
    x = df.where(F.col(value).isNotNull())
    x = x.where(~F.isnan(value)) if finite else x
    stats = x.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    stats = stats.withColumn("_bins", F.when(F.col("n") < 100, 5).when(F.col("n") < 500, 10).otherwise(20))
    bad = (F.col("n") < 20) | ~(F.col("_s") > 0)
    bad = bad | F.isnan("_s") | (F.col("_s") == float("inf")) if finite else bad
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    # a bin's number as a sum of comparisons: compiled, unlike a function over an array
    over = lambda k: reduce(lambda u, v: u + v, [(z >= e).cast("int") for e in scalar.normal_edges(k)])
    at = F.when(F.col("_bins") == 5, over(5)).when(F.col("_bins") == 10, over(10)).otherwise(over(20))
    counts = x.join(stats, by).where(~bad).groupBy(*by, at.alias("_b")).agg(F.count("*").alias("_o"), F.first("n").alias("_n"), F.first("_bins").alias("_k"))
    chi = counts.groupBy(*by).agg((F.sum(F.col("_o") * F.col("_o")) * F.first("_k") / F.first("_n") - F.first("_n")).alias("_chi"))
    out = stats.join(chi, by, "left")
    return out.select(*by, "n", F.when(bad | F.col("_chi").isNull(), WORST).otherwise(F.col("_chi") / (F.col("_bins") - 3)).alias("score"))


def fit_transforms(df: DataFrame, by: list[str], value: str = "value", grid: int = 17, rounds: int = 2, finite: bool = True) -> DataFrame:
    """by, n, log_offset, sqrt_offset, box_cox (null unless all are positive), yeo_johnson: fitted per key; fewer than 20 values: none.

    Lambdas maximise the likelihood over a grid of -2..2, then over finer grids around the best: each one aggregation by
    key and grid point, summed before the shuffle; what a round finds is stored, a row a key. Reads df several times: pass a stored table. NaN takes no part unless
    ``finite`` is off.
    """
    x = df.where(F.col(value).isNotNull())
    x = x.where(~F.isnan(value)) if finite else x
    base = x.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("_min"),
        F.sum(F.when(F.col(value) > 0, F.ln(value))).alias("_ln"),
        F.sum(F.signum(value) * F.log1p(F.abs(value))).alias("_yj"),
    ).where("n >= 20")
    low = F.abs("_min")
    base = base.withColumn("log_offset", F.when(F.col("_min") > 0, 0.0).otherwise(low + 1)).withColumn("sqrt_offset", F.when(F.col("_min") >= 0, 0.0).otherwise(low + 0.1))
    base = base.withColumn("box_cox", F.lit(0.0)).withColumn("yeo_johnson", F.lit(0.0))
    # stored once a round, a row a key: otherwise each round would work out all rounds before it again, once for each use
    base = tables.stored(base.withColumn("_id", F.monotonically_increasing_id()), "fit")
    width = 2.0
    for _ in range(rounds):
        steps = [width * (2 * i / (grid - 1) - 1) for i in range(grid)]
        z = _grid_variances(x.join(base, by).select("_id", value, "box_cox", "yeo_johnson"), steps).join(base, "_id")
        best = {}
        for name, v, logs in (("box_cox", "_vb", "_ln"), ("yeo_johnson", "_vy", "_yj")):
            like = (F.col(name) + F.col("_s") - 1) * F.col(logs) - F.col("n") / 2 * F.ln(F.when(F.col(v) > 0, F.col(v)))
            best[name] = F.max_by(F.col(name) + F.col("_s"), F.when(like.isNotNull(), F.struct(like, -F.col("_i")))).alias(f"_best_{name}")
        found = z.groupBy("_id").agg(*best.values())
        base = tables.stored(base.join(found, "_id", "left").select(*[c for c in base.columns if c not in best], *[F.coalesce(f"_best_{c}", c).alias(c) for c in best]), "fit")
        width = 2 * width / (grid - 1)
    return base.select(*by, "n", "log_offset", "sqrt_offset", F.when(F.col("_min") > 0, F.col("box_cox")).alias("box_cox"), "yeo_johnson")


def _grid_variances(rows: DataFrame, steps: list[float]) -> DataFrame:
    """_id, _i, _s, _vb, _vy: population variances of the Box-Cox transform (of the positive values) and the Yeo-Johnson transform at every grid point around a key's two lambdas.

    rows: _id, value, box_cox, yeo_johnson. Tasks sum moments of batches by key and grid point, in numpy: exploding rows
    by grid points would make 17 rows of each. A task holds one figure a key and grid point, at most KEYS_HELD keys.
    """
    s = np.array(steps)

    def moments(key, first, t):
        """Count, mean and squares about it by key, for each grid point; t: grid points x rows in order of keys."""
        n = np.diff(np.append(first, t.shape[1]))
        mean = np.add.reduceat(t, first, axis=1) / n
        return n, mean, np.add.reduceat((t - np.repeat(mean, n, axis=1)) ** 2, first, axis=1)

    def power(lx, lam):
        """(exp(lam lx) - 1) / lam, lx where lam is 0."""
        zero = np.abs(lam) < 1e-10
        return np.where(zero, lx, (np.exp(lam * lx) - 1) / np.where(zero, 1.0, lam))

    def run(batches):
        held: dict = {}

        def put(kind, key, v, t):
            if not len(v):
                return
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for k, n, m, q in zip(key[first].tolist(), *(lambda n, m, q: (n, m.T, q.T))(*moments(key, first, t)), strict=True):
                n0, m0, q0 = held.get((k, kind), (0, 0.0, 0.0))
                d, both = m - m0, n0 + n
                held[k, kind] = both, m0 + d * (n / both), q0 + q + d * d * (n0 * n / both)

        def flush():
            cells = [(k, kind, i, n, float(m[i]), float(q[i])) for (k, kind), (n, m, q) in held.items() for i in range(len(s))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["_id", "kind", "_i", "n", "m", "q"])

        with np.errstate(all="ignore"):
            for batch in batches:
                key, v, b, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                by = np.argsort(key, kind="stable")
                for lo in range(0, len(by), CELLS_ROWS):
                    at = by[lo : lo + CELLS_ROWS]
                    k, x, lb, ly = key[at], v[at], b[at], y[at]
                    pos = ~(x <= 0)  # NaN counts as positive, as in Spark's and SQL's order
                    put(0, k[pos], x[pos], power(np.log(x[pos]), lb[pos] + s[:, None]))
                    lam, up = ly + s[:, None], ~(x < 0)
                    put(1, k, x, np.where(up, 1.0, -1.0) * power(np.log1p(np.abs(x)), np.where(up, lam, 2 - lam)))
                if len(held) > 2 * KEYS_HELD:
                    yield flush()
            if held:
                yield flush()

    x = rows.mapInArrow(run, "_id long, kind int, _i int, n long, m double, q double")
    w = Window.partitionBy("_id", "kind", "_i")
    x = x.withColumn("_mu", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    x = x.groupBy("_id", "_i", "kind").agg((F.sum(F.col("q") + F.col("n") * (F.col("m") - F.col("_mu")) * (F.col("m") - F.col("_mu"))) / F.sum("n")).alias("v"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    return x.groupBy("_id", "_i").agg(of(0).alias("_vb"), of(1).alias("_vy")).withColumn("_s", F.element_at(F.array(*map(F.lit, steps)), F.col("_i") + 1))


def transformed(df: DataFrame, params: DataFrame, by: list[str], on_domain_error: str = "null", value: str = "value") -> DataFrame:
    """Each value under every fitted transform: columns of df, transform, transformed. Parameters join by key."""
    x = df.join(params.select(*by, "log_offset", "sqrt_offset", F.col("box_cox").alias("_bc"), F.col("yeo_johnson").alias("_yj")), by)
    args = {"log": ("log_offset", "1.0"), "sqrt": ("sqrt_offset", "1.0"), "box_cox": ("0.0", "_bc"), "yeo_johnson": ("0.0", "_yj")}
    cells = [F.struct(F.lit(t).alias("transform"), F.expr(scalar.transform(t, value, *args.get(t, ("0.0", "1.0")), on_domain_error)).alias("transformed")) for t in TRANSFORMS]
    return x.select(*df.columns, F.inline(F.array(*cells)))


def winner(scores: DataFrame, by: list[str], choice: str, order: tuple, score: str = "score") -> DataFrame:
    """by, choice with the least score; ties go to the earlier candidate of ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(choice))
    return scores.groupBy(*by).agg(F.min_by(F.struct(choice, score), F.struct(score, rank)).alias("w")).select(*by, f"w.{choice}", f"w.{score}")


def vote(winners: DataFrame, by: list[str], choice: str, order: tuple) -> DataFrame:
    """by, final, stability, n: the most frequent winner over splits, its share; ties to the earlier candidate."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(choice))
    x = winners.groupBy(*by, choice).agg(F.count("*").alias("c"))
    x = x.groupBy(*by).agg(F.max_by(F.struct(choice, "c"), F.struct("c", -rank)).alias("w"), F.sum("c").alias("n"))
    return x.select(*by, F.col(f"w.{choice}").alias("final"), (F.col("w.c") / F.col("n")).alias("stability"), "n")


def ewma_state(df: DataFrame, by: list[str], half_lives: tuple[int, ...] = HALF_LIVES, value: str = "value", order: tuple[str, ...] = ("us", "event_id"), finite: bool = True) -> DataFrame:
    """by, half_life, mean, var, n: the state after all values in order, as weighted sums: value i of n weighs alpha (1-alpha)^(n-i), the first (1-alpha)^(n-1).

    Null values take no part, NaN and infinite ones only where ``finite`` is off: they then spoil their key's state.
    """
    x = df.where(F.col(value).isNotNull())
    x = x.where(~F.isnan(value) & (F.abs(value) < float("inf"))) if finite else x
    x = frames.ranked(x, by, list(order), F.floor(F.col(order[0]) / frames.HOUR_US), "_rank").withColumn("_rank", F.col("_rank") + 1)
    x = x.join(x.groupBy(*by).agg(F.count("*").alias("_n")), by)
    aggs = []
    for h in half_lives:
        a = 1 - 2 ** (-1 / h)
        weight = F.when(F.col("_rank") == 1, 1.0).otherwise(a) * F.pow(F.lit(1 - a), F.col("_n") - F.col("_rank"))
        aggs += [F.sum(weight * F.col(value)).alias(f"_m{h}"), F.sum(weight * F.col(value) * F.col(value)).alias(f"_q{h}")]
    y = x.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    cells = [F.struct(F.lit(h).alias("half_life"), F.col(f"_m{h}").alias("mean"), F.greatest(F.col(f"_q{h}") - F.col(f"_m{h}") * F.col(f"_m{h}"), F.lit(0.0)).alias("var")) for h in half_lives]
    return y.select(*by, "n", F.inline(F.array(*cells)))


def ewma_scores(df: DataFrame, by: list[str], idx: str, keep: str, values: list[str], moves: list[Column], half_life: float, digits: int, rows: int = SCORE_ROWS, walked: int = WALKED, clip: float = 3.0) -> DataFrame:
    """by, split_id, feature, keep, z: each value's score by the state after the values up to it that move its split's state, clipped and rounded; null values have none.

    The state is walked value by value (m + a d; (1 - a) (v + a d d); d: the value less m), a block of rows of a key at
    once, all splits and columns of it in one task. A block starts from the state that its last ``walked`` values before
    it give; when there are no more than that, they are all. Earlier ones weigh 2 ** (-walked / half_life), so that the
    walk falls in with the whole one to the last bit. Values that aren't finite have no end: what follows has no state.
    Rows stay as wide as they are: only the result has a row for each split and column.
    """
    a = 1 - 2 ** (-1 / half_life)
    splits, n_lanes = range(len(moves)), len(moves) * len(values)
    bits = sum((m.cast("int") * 2**s for s, m in enumerate(moves)), F.lit(0))
    x = tables.stored(df.select(*by, F.floor(F.col(idx) / rows).alias("_blk"), idx, keep, bits.alias("_moves"), *values), "scores")
    types = dict(x.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in by)

    def walk(v, k, m, q):
        """States after each of the values v, from k values before them with the state m, q."""
        ms, qs = [], []
        for one in v.tolist():
            if k:
                d = one - m
                m, q = m + a * d, (1 - a) * (q + a * d * d)
            else:
                m, q, k = one, 0.0, 1
            ms.append(m)
            qs.append(q)
            if m != m:
                break
        left = [math.nan] * (len(v) - len(ms))
        return np.array(ms + left), np.array(qs + left)

    def lanes(t):
        """The rows in order; for each split and column the values, which there are, and which of them move the state."""
        t = t.sort_by(idx)
        of, cols = t["_moves"].to_numpy(), [t[c] for c in values]
        there = [c.is_valid().to_numpy() for c in cols]
        number = [c.to_numpy() for c in cols]
        return t, [(s, i, number[i], there[i], there[i] & ((of >> s) & 1 == 1)) for s in splits for i in range(len(values))]

    def ends(t):
        """What a block hands on, for each split and column: how many values moved the state, whether all were finite, the last of them."""
        found = [v[up] for *_, v, _, up in lanes(t)[1]]
        key = [pa.array([t[c][0].as_py()] * n_lanes, t.schema.field(c).type) for c in (*by, "_blk")]
        return pa.Table.from_arrays([*key, pa.array(range(n_lanes), pa.int32()), pa.array([len(v) for v in found], pa.int64()), pa.array([bool(np.isfinite(v).all()) for v in found]), pa.array([v[-walked:].tolist() for v in found], pa.list_(pa.float64()))], names=[*by, "_blk", "_lane", "_n", "_ok", "_last"])

    def starts(t):
        """The state before each block."""
        t = t.sort_by("_blk")
        k, ok, last, out = 0, True, np.empty(0), []
        for n, fine, more in zip(t["_n"].to_pylist(), t["_ok"].to_pylist(), t["_last"], strict=True):
            m, q = walk(last, 0, 0.0, 0.0) if ok or k <= walked else (np.array([math.nan]),) * 2
            out.append((k, float(m[-1]), float(q[-1])) if k else (0, 0.0, 0.0))
            k, ok, last = k + n, ok and fine, np.append(last, more.values.to_numpy())[-walked:]
        return t.select([*by, "_blk", "_lane"]).append_column("_k", pa.array([o[0] for o in out], pa.int64())).append_column("_m", pa.array([o[1] for o in out], pa.float64())).append_column("_q", pa.array([o[2] for o in out], pa.float64()))

    def scores(t, before):
        t, found = lanes(t)
        before = before.sort_by("_lane")
        out = []
        for (s, i, v, there, up), k, m, q in zip(found, *(before[c].to_pylist() for c in ("_k", "_m", "_q")), strict=True):
            ms, qs = walk(v[up], k, m, q)
            c = np.cumsum(up)[there]
            v, up = v[there], up[there]
            with np.errstate(all="ignore"):
                z = (v - np.append(m, ms)[c]) / np.sqrt(np.append(q, qs)[c] + 1e-12)
            z = np.where(np.isnan(z), clip, np.clip(z, -clip, clip))
            z = np.where(k + c == 0, v, np.where((k + c == 1) & up, 0.0, z))
            keys = [pa.repeat(t[b][0], len(v)) for b in by]
            out.append(pa.Table.from_arrays([*keys, pa.repeat(pa.scalar(s, pa.int32()), len(v)), pa.repeat(pa.scalar(values[i]), len(v)), t[keep].filter(pa.array(there)), pa.array(scalar.rounded_values(z, digits))], names=[*by, "split_id", "feature", keep, "z"]))
        return pa.concat_tables(out)

    key = [*by, "_blk"]
    e = x.drop(keep).groupBy(*key).applyInArrow(ends, f"{ddl}, _blk long, _lane int, _n long, _ok boolean, _last array<double>")
    e = e.groupBy(*by, "_lane").applyInArrow(starts, f"{ddl}, _blk long, _lane int, _k long, _m double, _q double")
    return x.groupBy(*key).cogroup(e.groupBy(*key)).applyInArrow(scores, f"{ddl}, split_id int, feature string, `{keep}` {types[keep]}, z double")
