"""Book array operators: column expressions over bids and asks as arrays of [price, volume].

Sides are sorted once (bids downwards, asks upwards) by ``sorted_book``; the depth figures then read slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUGE = 1e308


def best_bid(bids: str = "bids") -> Column:
    return F.aggregate(bids, F.lit(-HUGE), lambda a, x: F.greatest(a, x[0]))


def best_ask(asks: str = "asks") -> Column:
    return F.aggregate(asks, F.lit(HUGE), lambda a, x: F.least(a, x[0]))


def mid_price(empty_null: bool = False) -> Column:
    """Mean of the best prices. An empty side counts as -1e308 or 1e308, or makes it null."""
    mid = (best_bid() + best_ask()) / 2
    return F.when((F.size("bids") > 0) & (F.size("asks") > 0), mid) if empty_null else mid


def spread() -> Column:
    return best_ask() - best_bid()


def volume(side: Column) -> Column:
    return F.aggregate(side, F.lit(0.0), lambda a, x: a + x[1])


def microprice() -> Column:
    """Best prices weighted by the volume on the other side, over all levels at the best price; the mid without volume."""
    b, a = best_bid(), best_ask()
    vb, va = volume(F.filter("bids", lambda x: x[0] == b)), volume(F.filter("asks", lambda x: x[0] == a))
    return F.when(vb + va > 0, (a * vb + b * va) / (vb + va)).otherwise((b + a) / 2)


def sorted_book(df: DataFrame, by_volume: bool = False) -> DataFrame:
    """Bids downwards, asks upwards by price. Levels of one price stay in their stored order, or go by their volume too."""
    if by_volume:
        return df.withColumn("bids", F.reverse(F.array_sort("bids"))).withColumn("asks", F.array_sort("asks"))
    keyed = lambda side, sign: F.array_sort(F.transform(side, lambda x, i: F.struct(x[0].alias("p"), (sign * i).alias("i"), x.alias("x"))))
    return df.withColumn("bids", F.reverse(keyed("bids", -1))["x"]).withColumn("asks", keyed("asks", 1)["x"])


def name_of(k: int) -> str:
    return "all" if k == 0 else f"top_{k}"


def top(side: str, k: int) -> Column:
    return F.col(side) if k == 0 else F.slice(side, 1, k)


def depth_bands(df: DataFrame, bands: tuple[int, ...] = (5, 50)) -> DataFrame:
    """All five depth figures of each band, over a sorted book; 0 is the whole book. Sums are shared columns."""
    x = df.withColumns({f"_{s}{k}": volume(top(side, k)) for k in {0, *bands} for s, side in (("b", "bids"), ("a", "asks"))})
    out = {}
    for k in bands:
        vb, va = F.col(f"_b{k}"), F.col(f"_a{k}")
        both, whole = vb + va, F.col("_b0") + F.col("_a0")
        n = lambda side, k=k: F.size(side) if k == 0 else F.least(F.lit(k), F.size(side))
        at = lambda side, n=n: F.when(F.size(side) > 0, F.try_element_at(F.col(side), F.greatest(n(side), F.lit(1)))[0])
        pairs = F.slice(F.arrays_zip(F.col("bids").alias("b"), F.col("asks").alias("a")), F.lit(1), F.greatest(F.least(n("bids"), n("asks")), F.lit(0)))
        gap = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"][0] - x["b"][0]) * (x["a"][1] + x["b"][1]))
        weight = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"][1] + x["b"][1]))
        out |= {
            f"depth_imbalance_{name_of(k)}": F.when(both == 0, 0.0).otherwise((vb - va) / both),
            f"depth_{name_of(k)}": both,
            f"liquidity_concentration_{name_of(k)}": F.when(whole > 0, both / whole).otherwise(0.0),
            f"price_impact_proxy_{name_of(k)}": F.when(both > 0, (at("asks") - at("bids")) / (both + 1e-12)).otherwise(0.0),
            f"liquidity_spread_{name_of(k)}": gap / (weight + 1e-12),
        }
    return x.withColumns(out).drop(*(c for c in x.columns if c not in df.columns))


def pv_pairs() -> Column:
    """Levels from the far bid to the far ask; trusts the stored order."""
    return F.concat(F.reverse("bids"), "asks")


def price_standardize(pairs: str | Column, mid: str = "mid_price", vol: str = "volatility") -> Column:
    """[(price - mid) / scale, volume] of each level; a null volatility leaves the least scale (greatest skips nulls)."""
    scale = F.greatest(F.col(vol) * F.col(mid), F.lit(1e-6)) + 1e-8
    return F.transform(pairs, lambda x: F.array((x[0] - F.col(mid)) / scale, x[1]))


def price_clip(pairs: str | Column, delta: float) -> Column:
    return F.filter(pairs, lambda x: (x[0] >= -delta) & (x[0] <= delta))


def pv_unzip(pairs: str | Column) -> tuple[Column, Column]:
    return F.transform(pairs, lambda x: x[0]), F.transform(pairs, lambda x: x[1])


def volume_coverage(before: str, after: str) -> Column:
    """Percent of the volume that the clip keeps; 0 where there was none."""
    b, a = volume(F.col(before)), volume(F.col(after))
    return F.when(b > 0, 100.0 * a / b).otherwise(0.0)


def log_bin_edges(bins: int = 1000, eps: float = 0.5, delta: float = 1000.0) -> list[float]:
    """bins/2 log-spaced points eps..delta, mirrored, with -inf, 0 and inf: bins + 3 edges."""
    n = bins // 2
    ratio = (delta / eps) ** (1 / (n - 1))
    up = [eps * ratio**i for i in range(n)]
    return [float("-inf"), *(-x for x in reversed(up)), 0.0, *up, float("inf")]


def bin_of(z: Column, bins: int, eps: float, delta: float) -> Column:
    """The bin of a finite price among log_bin_edges, in closed form, set right by the edges beside it; the last interval counts with the one before."""
    edges = log_bin_edges(bins, eps, delta)
    n, step = bins // 2, math.log(delta / eps) / (bins // 2 - 1)
    k = F.floor(F.ln(F.greatest(F.abs(z), F.lit(1e-300)) / eps) / step)
    k = F.greatest(F.least(k, F.lit(n - 1)), F.lit(-1)).cast("int")  # -1: below eps
    guess = F.when(z >= 0, n + 2 + k).otherwise(n - 1 - k)
    lit = F.array(*map(F.lit, edges))
    at = lambda i: F.element_at(lit, F.greatest(F.least(i, F.lit(len(edges) - 1)), F.lit(0)) + 1)
    right = F.when(z < at(guess), guess - 1).when(z >= at(guess + 1), guess + 1).otherwise(guess)
    return F.least(right, F.lit(len(edges) - 3)).cast("int")


def bin_totals(bins: int = 1000, eps: float = 0.5, delta: float = 1000.0) -> Callable[..., Column]:
    """A function of arrays of [price, volume]: (bin, volume) in order of bins, each bin's total over the row's levels; null without levels.

    The bins lie between log_bin_edges; the last interval counts with the one before. Levels without a finite price or
    a positive volume are left out. A batch of rows is worked out at once, inside its task.
    """
    edges = np.array(log_bin_edges(bins, eps, delta))

    @F.arrow_udf("array<struct<bin int, volume double>>")
    def totals(pairs: pa.Array) -> pa.Array:
        row, levels = pc.list_parent_indices(pairs).to_numpy(), pairs.flatten()
        price, vol = (pc.list_element(levels, i) for i in (0, 1))
        given = pc.is_valid(vol).to_numpy(zero_copy_only=False)
        p, v = (x.to_numpy(zero_copy_only=False) for x in (price, vol))
        good = np.isfinite(p) & given & ((v > 0) | np.isnan(v))
        r, p, v = row[good], p[good], v[good]
        order = np.lexsort((v, p, r))
        r, p, v = r[order], p[order], v[order]
        at = np.minimum(np.searchsorted(edges, p, "right") - 1, len(edges) - 3)
        first = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        n = np.bincount(r[first], minlength=len(pairs))
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(at[first], pa.int32()), pa.array(np.add.reduceat(v, first) if len(first) else v, pa.float64())], ["bin", "volume"])
        return pa.ListArray.from_arrays(pa.array(upto), cells, mask=pa.array(n == 0))

    return totals


def with_bins(df: DataFrame, pairs: str, bins: int = 1000, eps: float = 0.5, delta: float = 1000.0, name: str = "binned") -> DataFrame:
    """Adds an array of (bin, volume) in order of bins: the total volume of the row's levels in each, inside the row; null without levels."""
    return df.withColumn(name, bin_totals(bins, eps, delta)(pairs))


def log_bins(df: DataFrame, pairs: str, keys: list[str], bins: int = 1000, eps: float = 0.5, delta: float = 1000.0) -> DataFrame:
    """keys, bin, volume: total volume of a row's levels per bin, without a shuffle."""
    return df.select(*keys, F.inline(bin_totals(bins, eps, delta)(pairs)))  # of the expression itself: a filter on a named array would work it out once more


def dense_bins(binned: str, n_bins: int) -> Column:
    """Shares of the row's volume in each bin, zeros where it has none, from an array of (bin, volume) in order: nothing leaves its row."""
    total = F.aggregate(binned, F.lit(0.0), lambda a, r: a + r["volume"])
    last = lambda i: F.when(i == 0, -1).otherwise(F.get(F.col(binned), i - 1)["bin"])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    upto = F.transform(binned, lambda r, i: F.concat(zeros(r["bin"] - last(i) - 1), F.array(r["volume"] / total)))
    after = zeros(F.lit(n_bins - 1) - F.element_at(binned, -1)["bin"])
    return F.coalesce(F.flatten(F.concat(upto, F.array(after))), zeros(F.lit(n_bins)))


def clr(v: str) -> Column:
    """Centred log-ratio of a vector: ln(x + 1e-10) less its mean."""
    logs = F.transform(v, lambda x: F.ln(x + 1e-10))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.transform(logs, lambda x: x - mean)


def consolidate(names: list[str]) -> tuple[Column, Column]:
    """features[] and feature_names[] from columns, in the given order."""
    return F.array(*names), F.array(*map(F.lit, names))


def project_features(features: str, names: str, wanted: list[str]) -> Column:
    """features[] re-indexed to the wanted names; an absent name is 0.0."""
    m = F.map_from_arrays(F.col(names), F.col(features))
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(w)), F.lit(0.0)) for w in wanted])


def all_finite(features: str) -> Column:
    """Whether a row has features and none of them is null, NaN or infinite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(features).isNotNull() & F.forall(features, ok)
