"""All tests of many series at once: one exchange by series, one aggregated row a series, and small solves on those rows.

A test that is linear in lagged values needs only sums of products of values some lags apart, and the few values at
both ends: the sums over any range of rows are those of the whole less what falls outside. So one set of lag products
gives the Ljung-Box and KPSS sums, the Phillips-Perron residuals' autocovariances and every augmented Dickey-Fuller
regression, whatever its number of lags; two more sets, of squares, give McLeod-Li and ARCH. Order statistics are taken
from the same rows, sorted. Nothing is shuffled but the series themselves, once.

series: keys, i (order), value without nulls; a series is a window of bounded length. Results: keys, test, category,
n_obs, statistic, p_value, n_lags, critical_1, critical_5, critical_10, skewness, kurtosis (null where a test has none).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import stats

#: Lags of Ljung-Box and McLeod-Li, and of ARCH, at most.
LB_LAGS, ARCH_LAGS = 10, 5
#: Critical values of KPSS and Anderson-Darling at 1, 5, 10 %.
KPSS_CRITICAL, ANDERSON_CRITICAL = (0.739, 0.463, 0.347), (1.092, 0.787, 0.656)

CATEGORIES = {
    "adf": "stationarity", "kpss": "stationarity", "pp": "stationarity", "jarque_bera": "normality", "shapiro": "normality", "anderson": "normality",
    "dagostino": "normality", "ljung_box": "autocorrelation", "durbin_watson": "autocorrelation", "arch_lm": "heteroskedasticity", "breusch_pagan": "heteroskedasticity",
    "white": "heteroskedasticity", "bds": "independence", "runs": "independence", "mcleod_li": "independence", "moments": "distribution", "hill": "distribution", "hurst": "long_memory",
}


def pp_lags(n: float) -> int:
    return max(1, math.ceil(12 * (n / 100) ** 0.25))


def most_lags(n: int) -> int:
    """Lags that the longest series' tests reach."""
    return max(stats.adf_lags(n) + 1, pp_lags(n) + 1, LB_LAGS)


SUMMED = (
    "n long, mean double, sd double, skewness double, kurtosis double, sd_lags array<double>, su_lags array<double>, ss_lags array<double>, d_head array<double>, d_tail array<double>, "
    "s_head array<double>, s_tail array<double>, cum2 double, step2 double, value2 double, bp double, wa double, wb double, wc double, n1 long, runs long, ad double, sw double, sv double, big long, tail long, xk double, logs double"
)


@lru_cache(maxsize=256)
def shapiro_weights(n: int) -> np.ndarray:
    """The weights of n ordered values, three or more: those of stats.shapiro_texts."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = scalar.norm_ppf_values((np.arange(1.0, n + 1) - 0.375) / (n + 0.25))
    mm, mn, mk, u = float(m @ m), m[-1], m[-2], 1 / math.sqrt(n)
    an, ak = mn / math.sqrt(mm) + np.polyval(stats.SW_LAST, u), mk / math.sqrt(mm) + np.polyval(stats.SW_NEXT, u)
    if n <= 5:
        a = m / math.sqrt((mm - 2 * mn * mn) / (1 - 2 * an * an))
    else:
        a = m / math.sqrt((mm - 2 * mn * mn - 2 * mk * mk) / (1 - 2 * an * an - 2 * ak * ak))
        a[-2], a[1] = ak, -ak
    a[-1], a[0] = an, -an
    return a


def summed(v: np.ndarray, lags: int) -> tuple:
    """The figures of SUMMED of one series in order; NaN counts as the largest value, as in SQL."""
    n = len(v)
    k = np.arange(1.0, n + 1)
    mean = v[0] if v[0] == v.min() == v.max() else v.mean()
    d = v - mean
    d2 = d * d
    m2, q = float(d2.mean()), v * v
    flat = m2 == 0
    sd = None if n < 2 else math.sqrt(m2 * n / (n - 1)) if m2 >= 0 else math.nan
    u, s = q - q.mean(), d2 - m2
    products = lambda x, most: [float(x[i:] @ x[: n - i]) if i < n else 0.0 for i in range(most + 1)]
    # residuals of a line, and their squares with time and its square
    kc = k - k.mean()
    slope = float(kc @ d) / float(kc @ kc) if n > 1 else math.nan
    e2 = (d - slope * kc) ** 2
    t2 = k * k

    def corr(x: np.ndarray, y: np.ndarray) -> float | None:
        x, y = x - x.mean(), y - y.mean()
        of = math.sqrt(float(x @ x) * float(y @ y)) if n > 1 else 0.0
        return float(x @ y) / of if of else None

    wa = corr(e2, k)
    bp = None if n < 2 else 1.0 if wa is None else wa * wa
    by_value = np.sort(v)
    med = by_value[n // 2] if n % 2 else 0.5 * by_value[n // 2 - 1] + 0.5 * by_value[n // 2]
    up = (v > med) | (np.isnan(v) & ~np.isnan(med))
    ad = None
    if sd is not None and sd != 0:
        z = (by_value - mean) / sd
        low, high = np.log(np.maximum(scalar.norm_cdf_values(z), 1e-300)), np.log(np.maximum(scalar.norm_cdf_values(-z), 1e-300))
        ad = float((2 * k - 1) @ low + (2 * (n + 1 - k) - 1) @ high)
    size = np.sort(np.abs(v[v != 0]))[::-1]
    tail = max(10, math.floor(len(size) * 0.1))
    cum = np.cumsum(d)
    end = lags + 1
    return (
        n, float(mean), sd, None if flat else float((d2 * d).mean()) / m2**1.5, None if flat else float((d2 * d2).mean()) / (m2 * m2) - 3,
        products(d, lags), products(u, LB_LAGS), products(s, ARCH_LAGS), d[:end], d[max(0, n - end) :], s[:ARCH_LAGS], s[max(0, n - ARCH_LAGS) :],
        float(cum @ cum), float(np.diff(v) @ np.diff(v)) if n > 1 else None, float(v @ v), bp, wa, corr(e2, t2), corr(k, t2),
        int(up.sum()), int((up[1:] != up[:-1]).sum()) + 1, ad, float(shapiro_weights(n) @ by_value) if n >= 3 else None, m2 * n,
        len(size), tail, float(size[:tail][-1]) if len(size) else None, float(np.log(size[: tail - 1]).sum()) if len(size) else None,
    )


def summaries(series: DataFrame, by: list[str], lags: int) -> DataFrame:
    """One row a series: moments, lag products of centred values, squares and squared deviations, ends, and sums of the order statistics.

    One exchange: a series' values meet in one row, in order, and rows are worked out in numpy.
    """
    x = series.select(*by, "i", "value").repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    x = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_s")).select(*by, F.col("_s.value").alias("_v"))
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by) + ", " + SUMMED
    names = [c.split()[0] for c in SUMMED.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    kinds = [types[c.split()[1]] for c in SUMMED.split(", ")]

    def run(batches):
        for batch in batches:
            v = batch.column(len(by))
            flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy() - v.offsets[0].as_py()
            with np.errstate(all="ignore"):
                rows = [summed(flat[a:b], lags) for a, b in zip(at[:-1], at[1:], strict=True)]
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *out], names=[*by, *names])

    return x.mapInArrow(run, schema)


def lag_sums(series: DataFrame, by: list[str], lags: int) -> DataFrame:
    """Of summaries only what the solves need: lag products and ends of the centred values and of their squares."""
    part = Window.partitionBy(*by)
    w = part.orderBy("i")
    x = series.select(*by, "i", "value").repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    x = x.withColumns({"n": F.count("*").over(part), "d": F.col("value") - F.avg("value").over(part), "_k": F.row_number().over(w)}).drop("value", "i")
    x = x.withColumns({"s": F.col("d") * F.col("d") - F.avg(F.col("d") * F.col("d")).over(part), "_cum": F.sum("d").over(part.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    at = part.orderBy("_k")
    x = x.withColumns({f"_{c}{k}": F.lag(c, k).over(at) for c, most in (("d", lags), ("s", ARCH_LAGS)) for k in range(1, most + 1)})
    products = lambda c, most: F.array(*[F.coalesce(F.sum(F.col(c) * (F.col(f"_{c}{k}") if k else F.col(c))), F.lit(0.0)) for k in range(most + 1)])
    end = lambda c, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("_k", c)))), lambda e: e[c])
    first, last = (lambda most: F.col("_k") <= most), (lambda most: F.col("_k") > F.col("n") - most)
    return x.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("_cum") * F.col("_cum")).alias("cum2"), products("d", lags).alias("sd_lags"), products("s", ARCH_LAGS).alias("ss_lags"),
        end("d", first(lags + 1)).alias("d_head"), end("d", last(lags + 1)).alias("d_tail"), end("s", first(ARCH_LAGS)).alias("s_head"), end("s", last(ARCH_LAGS)).alias("s_tail"),
    )


def adf_critical() -> list[Column]:
    """Critical values at 1, 5 and 10 % for adf_n rows."""
    n = F.col("adf_n").cast("double")
    return [reduce(lambda a, c: a + F.lit(c[1]) / F.pow(n, F.lit(float(c[0]))), list(enumerate(row))[1:], F.lit(row[0])) for row in stats.ADF_CRITICAL]


def anderson_critical() -> list[Column]:
    n = F.col("n").cast("double")
    return [F.round(F.lit(c) / (1 + 4.0 / n - 25.0 / (n * n)), 3) for c in ANDERSON_CRITICAL]


class Lagged:
    """Sums over rows t0..n of products of values some lags apart, from the sums over all rows and the values at both ends."""

    def __init__(self, products: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int) -> None:
        self.products, self.head, self.tail, self.n = products, head, tail, n

    def product(self, i: int, j: int, t0: int) -> float:
        """Sum of x[t-i] * x[t-j] over t = t0..n, where t0 > i and t0 > j."""
        i, j = sorted((i, j))
        k = j - i
        first = self.head[k : t0 - i - 1] @ self.head[: t0 - i - 1 - k] if t0 - i - 1 > k else 0.0
        last = self.tail[len(self.tail) - i :] @ self.tail[len(self.tail) - i - k : len(self.tail) - k] if i else 0.0
        return self.products[k] - first - last

    def total(self, i: int, t0: int) -> float:
        """Sum of x[t-i]; all of them sum to 0."""
        return -self.head[: t0 - i - 1].sum() - (self.tail[len(self.tail) - i :].sum() if i else 0.0)

    def gram(self, lags: list[int], t0: int) -> np.ndarray:
        """Products of 1 and the values at these lags."""
        k = len(lags) + 1
        out = np.empty((k, k))
        out[0, 0] = self.n - t0 + 1
        for a, i in enumerate(lags, 1):
            out[0, a] = out[a, 0] = self.total(i, t0)
            for b in range(a, k):
                out[a, b] = out[b, a] = self.product(i, lags[b - 1], t0)
        return out


def adf(x: Lagged) -> tuple[float, int, int]:
    """t-ratio, lags by AIC on the rows that all candidates have, rows used."""

    def regressors(p: int, t0: int) -> np.ndarray:
        levels = x.gram(list(range(1, p + 2)) + [0], t0)  # 1, x[t-1], ..., x[t-p-1], x[t]
        to = np.zeros((p + 3, p + 3))
        to[0, 0] = to[1, 1] = to[p + 2, p + 2] = 1.0
        to[1, p + 2] = -1.0
        for j in range(1, p + 1):  # x[t-j] - x[t-j-1]
            to[j, 1 + j], to[1 + j, 1 + j] = 1.0, -1.0
        return to.T @ levels @ to

    limit = stats.adf_lags(x.n)
    common, n = regressors(limit, limit + 2), x.n - limit - 1
    fit = lambda p: n * math.log(stats.t_of_level(n, common, list(range(2 + p)))[1] / n) + 2 * (2 + p)
    best = min(range(limit + 1), key=fit)
    return stats.t_of_level(x.n - best - 1, regressors(best, best + 2), list(range(2 + best)))[0], best, x.n - best - 1


def phillips_perron(x: Lagged) -> tuple[float, int]:
    g = x.gram([1, 0], 2)
    n = x.n - 1
    sxx, sxy, syy = g[1, 1] - g[0, 1] ** 2 / n, g[1, 2] - g[0, 1] * g[0, 2] / n, g[2, 2] - g[0, 2] ** 2 / n
    rho = sxy / sxx
    a = (g[0, 2] - rho * g[0, 1]) / n
    q = min(pp_lags(n), n - 1)
    c = [max(syy - rho * sxy, 1e-300)]
    for k in range(1, q + 1):
        t0 = k + 2
        p, s = x.product, lambda i: x.total(i, t0)
        cross = p(0, k, t0) - rho * (p(0, k + 1, t0) + p(1, k, t0)) + rho * rho * p(1, k + 1, t0)
        c.append(cross - a * (s(0) + s(k) - rho * (s(1) + s(k + 1))) + a * a * (x.n - t0 + 1))
    lam = (c[0] + 2 * sum((1 - k / (q + 1)) * c[k] for k in range(1, q + 1))) / n
    s2, g0 = c[0] / (n - 2), c[0] / n
    se = math.sqrt(s2 / sxx)
    return math.sqrt(g0 / lam) * (rho - 1) / se - 0.5 * (lam - g0) / math.sqrt(lam) * (n * se / math.sqrt(s2)), q


def arch(x: Lagged) -> tuple[float, int]:
    own = min(x.n // 10, ARCH_LAGS)
    m = x.gram(list(range(1, own + 1)) + [0], own + 1)
    n = x.n - own
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    total = m[-1, -1] - m[0, -1] ** 2 / n
    return n * (1 - (m[-1, -1] - beta @ m[:-1, -1]) / total) if total > 0 else 0.0, own


def kpss_lags(n: int, c: np.ndarray) -> int:
    """Bandwidth from the first few autocovariances' sums."""
    few = int(math.floor(n ** (2 / 9)))
    k = np.arange(1, few + 1)
    s0, s1 = c[0] / n + (c[1 : few + 1] / (n / 2)).sum(), (k * c[1 : few + 1] / (n / 2)).sum()
    return int(min(math.floor(1.1447 * np.cbrt((s1 / s0) ** 2) * np.cbrt(n)), n - 1)) if s0 else 0


SOLVED = "adf double, adf_lags int, adf_n long, pp double, pp_lags int, arch double, arch_lags int, kpss double, kpss_lags int, adf_p double, pp_p double, arch_p double"


def solved(rows: DataFrame, by: list[str], lags: int) -> DataFrame:
    """Adds what needs a small solve; kpss is null where its bandwidth goes beyond the lag products."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (*by, "n")) + ", " + SOLVED

    def one(n: int, d: Lagged, s: Lagged, cum2: float) -> tuple:
        if not d.products[0] > 0:
            return (None,) * 12
        a, p, used = adf(d) if n > 4 else (None, None, None)
        z, q = phillips_perron(d) if n > 4 else (None, None)
        lm, own = arch(s) if n >= 10 else (None, None)
        bw = kpss_lags(n, d.products) if n >= 20 else None
        kpss = None
        if bw is not None and bw <= lags:
            k = np.arange(1, bw + 1)
            kpss = cum2 / (n * n) / ((d.products[0] + 2 * ((1 - k / (bw + 1)) * d.products[1 : bw + 1]).sum()) / n)
        return a, p, used, z, q, lm, own, kpss, bw, None if a is None else stats.unit_root_p(a), None if z is None else stats.unit_root_p(z), None if lm is None else stats.chi2_tail_value(lm, own)

    names = [c.strip().split()[0] for c in SOLVED.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d, s = (Lagged(np.asarray(p, float), np.asarray(h, float), np.asarray(t, float), r.n) for p, h, t in ((r.sd_lags, r.d_head, r.d_tail), (r.ss_lags, r.s_head, r.s_tail)))
                out.append(one(r.n, d, s, r.cum2))
            add = pd.DataFrame(out, columns=names, index=pdf.index).astype({c: "Int64" for c in ("adf_lags", "adf_n", "pp_lags", "arch_lags", "kpss_lags")})
            yield pd.concat([pdf[[*by, "n"]], add], axis=1)

    return rows.select(*by, "n", "cum2", "sd_lags", "d_head", "d_tail", "ss_lags", "s_head", "s_tail").mapInPandas(run, schema)


def _box(products: str) -> tuple[Column, Column]:
    m = F.least(F.lit(LB_LAGS), F.floor(F.col("n") / 5)).cast("int")
    r = lambda k: F.element_at(products, k + 1) / F.element_at(products, 1)
    total = reduce(lambda a, k: a + F.when(m >= k, r(k) * r(k) / (F.col("n") - k)).otherwise(0.0), range(1, LB_LAGS + 1), F.lit(0.0))
    return F.when((m >= 1) & (F.element_at(products, 1) > 0), F.col("n") * (F.col("n") + 2.0) * total), m


def tests(rows: DataFrame, more: DataFrame, by: list[str], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The tests of summaries and what was solved from them, one row each; those that a series is too short or flat for are left out."""
    x = rows.join(more.drop("n"), by)
    n, none = F.col("n"), F.lit(None).cast("double")
    (lb, m), (ml, _) = _box("sd_lags"), _box("su_lags")
    x = x.withColumns({"_lb": lb, "_ml": ml, "_m": m, "_p2": 2.0 * F.col("n1") * (n - F.col("n1"))})
    text = F.expr
    r2 = (F.col("wa") * F.col("wa") + F.col("wb") * F.col("wb") - 2 * F.col("wa") * F.col("wb") * F.col("wc")) / (1 - F.col("wc") * F.col("wc"))
    x = x.withColumns({
        "_jb": text(stats.JB), "_da": F.when(n >= 20, text(stats.dagostino_text())), "_bp": n * F.col("bp"), "_wh": n * r2,
        "_rz": F.when(F.col("_p2") > 0, (F.col("runs") - F.col("_p2") / n - 1) / F.sqrt(F.col("_p2") * (F.col("_p2") - n) / (n * n * (n - 1.0)))),
        "statistic": F.when((F.col("sv") > 0) & (n >= 3), F.col("sw") * F.col("sw") / F.col("sv")),
    })
    x = x.withColumn("score", F.expr(stats.shapiro_texts()["score"]))
    # stored, so that the closed forms of the tails are not written out inside those of the statistics
    x = keep(x.drop("d_head", "d_tail", "s_head", "s_tail", "sd_lags", "su_lags", "ss_lags"), "statistics")
    exp2 = lambda c: F.exp(-F.col(c) / 2)
    table: dict[str, tuple] = {
        "adf": (F.col("adf"), F.col("adf_p"), F.col("adf_lags"), F.col("adf_n"), adf_critical()),
        "kpss": (F.col("kpss"), text(stats.kpss_p("kpss")), F.col("kpss_lags"), n, [F.lit(c) for c in KPSS_CRITICAL]),
        "pp": (F.col("pp"), F.col("pp_p"), F.col("pp_lags"), n - 1, None),
        "jarque_bera": (F.col("_jb"), exp2("_jb"), None, n, None),
        "shapiro": (F.col("statistic"), text(stats.shapiro_texts()["p"]), None, n, None),
        "anderson": (F.when(F.col("sd") > 0, -n - F.col("ad") / n), none, None, n, anderson_critical()),
        "dagostino": (F.col("_da"), exp2("_da"), None, n, None),
        "ljung_box": (F.col("_lb"), text(stats.tail_by_df("_lb", "_m", LB_LAGS)), F.col("_m"), n, None),
        "durbin_watson": (F.try_divide("step2", "value2"), none, None, n, None),
        "arch_lm": (F.col("arch"), F.col("arch_p"), F.col("arch_lags"), n, None),
        "breusch_pagan": (F.col("_bp"), text(scalar.chi2_tail("_bp", 1)), None, n, None),
        "white": (F.col("_wh"), text(scalar.chi2_tail("_wh", 2)), None, n, None),
        "runs": (F.col("_rz"), text(scalar.two_sided("_rz")), None, n, None),
        "mcleod_li": (F.col("_ml"), text(stats.tail_by_df("_ml", "_m", LB_LAGS)), F.col("_m"), n, None),
        "hill": (F.when((F.col("big") >= F.col("tail")) & (F.col("tail") > 1), F.try_divide(F.lit(1.0), F.col("logs") / (F.col("tail") - 1) - F.ln("xk"))), none, None, F.col("big"), None),
    }
    cell = lambda name, s, p, k, size, crit: F.struct(
        F.lit(name).alias("test"), F.lit(CATEGORIES[name]).alias("category"), size.cast("long").alias("n_obs"), s.cast("double").alias("statistic"), F.when(s.isNotNull(), p).cast("double").alias("p_value"),
        (F.lit(None) if k is None else k).cast("int").alias("n_lags"), *[(none if crit is None else crit[i]).cast("double").alias(f"critical_{c}") for i, c in enumerate((1, 5, 10))], none.alias("skewness"), none.alias("kurtosis"),
    )
    own = F.struct(F.lit("moments").alias("test"), F.lit(CATEGORIES["moments"]).alias("category"), n.cast("long").alias("n_obs"), none.alias("statistic"), none.alias("p_value"), F.lit(None).cast("int").alias("n_lags"), *[none.alias(f"critical_{c}") for c in (1, 5, 10)], F.col("skewness"), F.col("kurtosis"))
    cells = F.array(*[cell(name, *v) for name, v in table.items()], own)
    out = keep(x.select(*by, cells.alias("c")), "tests").select(*by, F.explode("c").alias("c")).select(*by, "c.*")
    return out.where((F.col("statistic").isNotNull() & ~F.isnan("statistic")) | (F.col("test") == "moments"))


def battery(series: DataFrame, by: list[str], keep: Callable[[DataFrame, str], DataFrame], least: int = 30) -> DataFrame:
    """All tests of the series of at least ``least`` values. ``keep`` stores a table that is used twice."""
    sizes = series.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    x = keep(series.join(sizes, by).drop("_n"), "series")
    longest = stats.longest(x, by)
    lags = most_lags(longest)
    rows = keep(summaries(x, by, lags), "summaries")
    more = keep(solved(rows, by, lags), "solved")
    out = tests(rows, more, by, keep)
    like = lambda df, name, **also: df.select(*by, F.lit(name).alias("test"), F.lit(CATEGORIES[name]).alias("category"), F.col("n").cast("long").alias("n_obs"), "statistic", "p_value", *[also.get(c, F.lit(None)).cast("int" if c == "n_lags" else "double").alias(c) for c in ("n_lags", "critical_1", "critical_5", "critical_10", "skewness", "kurtosis")])
    out = out.unionByName(like(stats.bds(x, by), "bds")).unionByName(like(stats.hurst(x, by).where("statistic IS NOT NULL"), "hurst"))
    # bandwidths beyond the lag products, as strongly dependent series have: their values again, for as many lags as they need
    far = more.where(F.col("kpss_lags") > lags).select(*by, "kpss_lags")
    if far.limit(1).count():
        again = stats.kpss(x.join(far.drop("kpss_lags"), by), by).join(far, by)
        out = out.unionByName(like(again, "kpss", n_lags=F.col("kpss_lags"), critical_1=F.lit(KPSS_CRITICAL[0]), critical_5=F.lit(KPSS_CRITICAL[1]), critical_10=F.lit(KPSS_CRITICAL[2])))
    return out
