"""Statistical tests over many series at once: one or two aggregations over the long form (keys, i, value), closed forms on the aggregated row.

Each function returns one row per key with n, statistic and p_value (null where the test gives none).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.functions.scalar import num
from tidebook.operators import frames


def window(by: list[str]):
    return Window.partitionBy(*by).orderBy("i")


def longest(df: DataFrame, by: list[str]) -> int:
    """Rows of the longest series: what bounds the lags of a test."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def moments(df: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sample std, population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))


#: Closed forms over n, skewness and kurtosis, as text.
JB = "(n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0))"


def dagostino_text() -> str:
    n = "CAST(n AS DOUBLE)"
    b2 = f"(3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(sqrt(2 * ({b2} - 1)) - 1)"
    y = f"(skewness * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))))"
    z1 = f"(asinh({y} / sqrt(2 / ({w2} - 1))) / sqrt(0.5 * ln({w2})))"
    e, v = f"(3 * ({n} - 1) / ({n} + 1))", f"(24 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"((kurtosis + 3 - {e}) / sqrt({v}))"
    s = f"(6 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))"
    a = f"(6 + 8 / {s} * (2 / {s} + sqrt(1 + 4 / ({s} * {s}))))"
    d = f"(1 + {x} * sqrt(2 / ({a} - 4)))"
    z2 = f"((1 - 2 / (9 * {a}) - sign({d}) * cbrt((1 - 2 / {a}) / abs({d}))) / sqrt(2 / (9 * {a})))"
    return f"({z1} * {z1} + {z2} * {z2})"


def jarque_bera(df: DataFrame, by: list[str]) -> DataFrame:
    return moments(df, by).select(*by, "n", F.expr(JB).alias("statistic")).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def dagostino(df: DataFrame, by: list[str]) -> DataFrame:
    return moments(df, by).where("n >= 20").select(*by, "n", F.expr(dagostino_text()).alias("statistic")).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def acf(df: DataFrame, by: list[str], lags: int = 20, value: str = "value") -> DataFrame:
    """by, n, c0, acf: array of autocorrelations at lags 1..lags; one window, one aggregation."""
    x = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    w = window(by)
    later = [F.lead("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)]
    x = x.select(*by, "_d", *later)
    sums = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("c0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    return sums.select(*by, "n", "c0", F.array(*[F.try_divide(f"_s{k}", "c0") for k in range(1, lags + 1)]).alias("acf"))


def acf_blocked(df: DataFrame, by: list[str], lags: int = 20, value: str = "value", block: int = 4096) -> DataFrame:
    """As ``acf``, for series of any length (i = 1, 2, ...): products of lagged values by blocks of rows, each with the next block's first rows, added up; no task holds a series."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    x = df.join(means, by).select(*by, (F.col("i") - 1).alias("_i"), (F.col(value) - F.col("_m")).alias("_d"))
    x = frames.lagged(x, by, "_i", {f"_l{k}": ("_d", -k) for k in range(1, lags + 1)}, block)
    sums = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("c0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    return sums.select(*by, "n", "c0", F.array(*[F.try_divide(f"_s{k}", "c0") for k in range(1, lags + 1)]).alias("acf"))


def tail_by_df(x: str, df: str, most: int) -> str:
    """Chi-square tail for a column of degrees of freedom 1..most."""
    return f"(CASE {df} " + " ".join(f"WHEN {k} THEN {scalar.chi2_tail(x, k)}" for k in range(1, most + 1)) + " END)"


def ljung_box(df: DataFrame, by: list[str], square: bool = False) -> DataFrame:
    """Lags min(10, n/5); with square, of the squared values (McLeod-Li)."""
    x = df.withColumn("value", F.col("value") * F.col("value")) if square else df
    x = acf(x, by, 10).withColumn("m", F.least(F.lit(10), F.floor(F.col("n") / 5)).cast("int"))
    term = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, k: a + F.element_at("acf", k) * F.element_at("acf", k) / (F.col("n") - k))
    x = x.where("m >= 1").select(*by, "n", "m", (F.col("n") * (F.col("n") + 2) * term).alias("statistic"))
    return x.select(*by, "n", "statistic", F.expr(tail_by_df("statistic", "m", 10)).alias("p_value"))


def durbin_watson(df: DataFrame, by: list[str]) -> DataFrame:
    x = df.withColumn("_d", F.col("value") - F.lag("value").over(window(by)))
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("value") * F.col("value"))).alias("statistic")).withColumn("p_value", F.lit(None).cast("double"))


def detrended(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with t and the squared residual e2 of value ~ 1 + t."""
    fit = df.groupBy(*by).agg(F.regr_slope("value", "i").alias("_b"), F.regr_intercept("value", "i").alias("_a"))
    x = df.join(fit, by).withColumn("_e", F.col("value") - F.col("_a") - F.col("_b") * F.col("i"))
    return x.select(*by, F.col("i").cast("double").alias("t"), (F.col("_e") * F.col("_e")).alias("e2"))


def _defined(c: Column) -> Column:
    """Null in place of NaN: a correlation with values that aren't finite."""
    return F.when(~F.isnan(c), c)


def breusch_pagan(df: DataFrame, by: list[str]) -> DataFrame:
    x = detrended(df, by).groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") * _defined(F.regr_r2("e2", "t"))).alias("statistic"))
    return x.withColumn("p_value", F.expr(scalar.chi2_tail("statistic", 1)))


def white(df: DataFrame, by: list[str]) -> DataFrame:
    """R2 of e2 on t and t*t from the three correlations."""
    x = detrended(df, by).withColumn("s", F.col("t") * F.col("t"))
    x = x.groupBy(*by).agg(F.count("*").alias("n"), F.corr("e2", "t").alias("a"), F.corr("e2", "s").alias("b"), F.corr("t", "s").alias("c"))
    r2 = (F.col("a") * F.col("a") + F.col("b") * F.col("b") - 2 * F.col("a") * F.col("b") * F.col("c")) / (1 - F.col("c") * F.col("c"))
    return x.select(*by, "n", (F.col("n") * _defined(r2)).alias("statistic")).withColumn("p_value", F.expr(scalar.chi2_tail("statistic", 2)))


def runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Wald-Wolfowitz about the median: z and its two-sided p."""
    med = df.groupBy(*by).agg(F.median("value").alias("_med"))
    x = df.join(med, by).withColumn("_s", (F.col("value") > F.col("_med")).cast("int"))
    x = x.withColumn("_c", F.col("_s") != F.lag("_s").over(window(by)))
    x = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_s").alias("n1"), (F.count_if("_c") + 1).alias("r"))
    x = x.withColumn("p2", 2.0 * F.col("n1") * (F.col("n") - F.col("n1"))).where("p2 > 0")
    z = (F.col("r") - F.col("p2") / F.col("n") - 1) / F.sqrt(F.col("p2") * (F.col("p2") - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1.0)))
    return x.select(*by, "n", z.alias("statistic")).withColumn("p_value", F.expr(scalar.two_sided("statistic")))


def hill(df: DataFrame, by: list[str]) -> DataFrame:
    """Tail index from the largest max(10, n/10) absolute values: 1 over the mean log-ratio of the first k - 1 to the k-th."""
    x = df.select(*by, F.abs("value").alias("a")).where("a > 0")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("a")))).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    x = x.withColumn("k", F.greatest(F.lit(10), F.floor(F.col("n") * 0.1)))
    x = x.where("r <= k").groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.min("a").alias("xk"), F.sum(F.when(F.col("r") < F.col("k"), F.ln("a"))).alias("s"))
    return x.select(*by, "n", F.try_divide(F.lit(1.0), F.col("s") / (F.col("k") - 1) - F.ln("xk")).alias("statistic"), F.lit(None).cast("double").alias("p_value"))


def hurst_of(v: np.ndarray, points: int) -> tuple[bool, float | None]:
    """Whether any lag of a series has a spread, and the slope."""
    n = len(v)
    if n < 20:
        return False, None
    ten, span = math.log(10.0), math.log(n / 2) - math.log(10.0)
    at, rs = [], []
    for lag in sorted({math.floor(math.exp(ten + j * span / (points - 1)) + 1e-9) for j in range(points)}):
        d = v[: n // lag * lag].reshape(-1, lag)
        d = d - d.mean(1, keepdims=True)
        sd, cum = np.sqrt((d * d).mean(1)), np.cumsum(d, 1)
        some = ~(sd <= 0)  # NaN is above 0, as in SQL
        if some.any():
            mean = float(((cum.max(1) - cum.min(1))[some] / sd[some]).mean())
            if not mean <= 0:
                at.append(math.log(lag))
                rs.append(math.log(mean))
    x = np.array(at) - np.mean(at) if at else np.zeros(0)
    return bool(at), float(x @ np.array(rs)) / float(x @ x) if len(at) > 1 else None


def hurst(df: DataFrame, by: list[str], points: int = 20) -> DataFrame:
    """Slope of log mean R/S on log lag, over log-spaced lags of 10 to n/2; i goes 1, 2, ...

    One exchange: a series' values meet in one row, in order, and rows are worked out in numpy.
    """
    # as many partitions as the session has, since each series is gone through twenty times
    x = df.select(*by, "i", "value").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    x = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_s")).select(*by, F.col("_s.value").alias("_v"))
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by) + ", n long, statistic double"

    def run(batches):
        for batch in batches:
            v = batch.column(len(by))
            flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy() - v.offsets[0].as_py()
            with np.errstate(all="ignore"):
                z = [hurst_of(flat[a:b], points) for a, b in zip(at[:-1], at[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(np.diff(at), pa.int64()), pa.array([s for _, s in z], pa.float64())], names=[*by, "n", "statistic"])
            yield out.filter(pa.array([some for some, _ in z], pa.bool_()))

    return x.mapInArrow(run, schema).withColumn("p_value", F.lit(None).cast("double"))


#: KPSS level critical values at 10, 5, 2.5 and 1 %.
KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss_p(x: str) -> str:
    out = f"CASE WHEN {x} <= {KPSS[0][0]} THEN {KPSS[0][1]}"
    for (a, p), (b, q) in zip(KPSS, KPSS[1:], strict=False):
        out += f" WHEN {x} <= {b} THEN {num(p)} + ({x} - {num(a)}) * {num((q - p) / (b - a))}"
    return out + f" ELSE {KPSS[-1][1]} END"


def kpss_of(v: np.ndarray) -> float | None:
    """The statistic of one series; None for fewer than 20 values or without spread."""
    n = len(v)
    if n < 20:
        return None
    d = v - v.mean()
    c0 = float(d @ d)
    if not c0 < math.inf:
        return math.nan
    if c0 == 0:
        return None
    c = [float(d[k:] @ d[:-k]) for k in range(1, math.floor(n ** (2 / 9)) + 1)]
    s0, s1 = c0 / n + sum(x / (n / 2) for x in c), sum(k * x / (n / 2) for k, x in enumerate(c, 1))
    q = int(min(math.floor(1.1447 * np.cbrt((s1 / s0) ** 2) * np.cbrt(n)), n - 1)) if s0 else 0
    long_run = sum((1 - k / (q + 1)) * float(d[k:] @ d[:-k]) for k in range(1, q + 1))
    s = np.cumsum(d)
    return float(s @ s) / (n * n) / ((c0 + 2 * long_run) / n)


def kpss(df: DataFrame, by: list[str]) -> DataFrame:
    """Level stationarity; bandwidth by the data's own autocovariances; n of 20 or more and some spread.

    One exchange: a series' values meet in one row, in order, and rows are worked out in numpy, batch by batch.
    """
    x = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_s")).select(*by, F.col("_s.value").alias("_v"))
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by) + ", n long, statistic double"

    def run(batches):
        for batch in batches:
            v = batch.column(len(by))
            flat, at = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy() - v.offsets[0].as_py()
            z = pa.array([kpss_of(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.float64())
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(np.diff(at), pa.int64()), z], names=[*by, "n", "statistic"])
            yield out.filter(z.is_valid())

    return x.mapInArrow(run, schema).withColumn("p_value", F.expr(kpss_p("statistic")))


def anderson(df: DataFrame, by: list[str]) -> DataFrame:
    """Anderson-Darling for the normal with estimated moments; compare with 0.787 (5 %) over 1 + 4/n - 25/n^2."""
    m = moments(df, by).select(*by, "n", "mean", "std").where("std > 0")
    x = df.join(m, by).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("z")))
    low, high = F.expr(scalar.norm_cdf("z")), F.expr(scalar.norm_cdf("(-z)"))
    tiny = F.lit(1e-300)
    x = x.groupBy(*by, "n").agg(F.sum((2 * F.col("r") - 1) * F.ln(F.greatest(low, tiny)) + (2 * (F.col("n") + 1 - F.col("r")) - 1) * F.ln(F.greatest(high, tiny))).alias("s"))
    return x.select(*by, "n", (-F.col("n") - F.col("s") / F.col("n")).alias("statistic"), F.lit(None).cast("double").alias("p_value"))


#: Polynomials of the Shapiro-Wilk weights and of the normal approximation of its tail (n of 12 or more).
SW_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
SW_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SW_MEAN, SW_LOG_SD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


#: The same for 4 to 11 values: the bound of -ln(1 - W), mean and log deviation.
SW_FEW_BOUND, SW_FEW_MEAN, SW_FEW_LOG_SD = (0.459, -2.273), (-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822)


def shapiro_texts() -> dict[str, str]:
    """The steps as text over n, m, mm (sum of m*m), mn and mk (the two largest m)."""
    u = "(1 / sqrt(CAST(n AS DOUBLE)))"
    an = f"(mn / sqrt(mm) + {scalar.horner(SW_LAST, u)})"
    ak = f"(mk / sqrt(mm) + {scalar.horner(SW_NEXT, u)})"
    phi = f"((mm - 2 * mn * mn - 2 * mk * mk) / (1 - 2 * {an} * {an} - 2 * {ak} * {ak}))"
    ln_n, few = "ln(CAST(n AS DOUBLE))", "CAST(n AS DOUBLE)"
    bound = scalar.horner(SW_FEW_BOUND, few)
    return {
        "m": scalar.norm_ppf("((r - 0.375) / (n + 0.25))"),
        "a": f"(CASE WHEN n = 3 THEN (r - 2) * sqrt(0.5) WHEN r = n THEN {an} WHEN r = 1 THEN -{an} WHEN n <= 5 THEN m / sqrt((mm - 2 * mn * mn) / (1 - 2 * {an} * {an})) "
        f"WHEN r = n - 1 THEN {ak} WHEN r = 2 THEN -{ak} ELSE m / sqrt({phi}) END)",
        # the normal score of 1 - W; null where the p-value needs none
        "score": f"(CASE WHEN n = 3 OR statistic >= 1 THEN CAST(NULL AS DOUBLE) WHEN n <= 11 THEN CASE WHEN ln(1 - statistic) < {bound} THEN (-ln({bound} - ln(1 - statistic)) - {scalar.horner(SW_FEW_MEAN, few)}) / exp({scalar.horner(SW_FEW_LOG_SD, few)}) END "
        f"ELSE (ln(1 - statistic) - {scalar.horner(SW_MEAN, ln_n)}) / exp({scalar.horner(SW_LOG_SD, ln_n)}) END)",
        "p": f"(CASE WHEN statistic >= 1 THEN 1.0 WHEN n = 3 THEN greatest(0.0, {num(6 / math.pi)} * (asin(sqrt(statistic)) - {num(math.asin(math.sqrt(0.75)))})) WHEN score IS NULL THEN 0.0 ELSE 1 - {scalar.norm_cdf('score')} END)",
    }


def shapiro(df: DataFrame, by: list[str]) -> DataFrame:
    """Three values or more."""
    t, part = shapiro_texts(), Window.partitionBy(*by)
    x = df.withColumn("r", F.row_number().over(part.orderBy("value")).cast("double")).withColumn("n", F.count("*").over(part)).where("n >= 3")
    x = x.withColumn("m", F.expr(t["m"]))
    x = x.withColumn("mm", F.sum(F.col("m") * F.col("m")).over(part)).withColumn("mn", F.max("m").over(part)).withColumn("mk", F.max(F.when(F.col("r") == F.col("n") - 1, F.col("m"))).over(part))
    g = x.withColumn("a", F.expr(t["a"])).groupBy(*by, "n").agg(F.sum(F.col("a") * F.col("value")).alias("s"), (F.var_pop("value") * F.count("*")).alias("v")).where("v > 0")
    g = g.select(*by, "n", (F.col("s") * F.col("s") / F.col("v")).alias("statistic")).withColumn("score", F.expr(t["score"]))
    return g.withColumn("p_value", F.expr(t["p"])).drop("score")


# regressions from Gram matrices: the sums are aggregated in Spark, a small solve per key follows


def gram(df: DataFrame, by: list[str], columns: list[Column], keep: Column) -> DataFrame:
    """by, n, g: the upper triangle of sums of products of the columns over the rows kept; made batch by batch, then added up."""
    k = len(columns)
    upper = np.triu_indices(k)
    x = df.select(*by, keep.alias("_ok"), F.array(*[c.cast("double") for c in columns]).alias("_v")).where("_ok").drop("_ok")
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by) + ", n long, g array<double>"

    def partial(batches):
        for pdf in batches:
            v = np.stack(pdf["_v"].to_numpy()) if len(pdf) else np.zeros((0, k))
            rows = [(*(key if isinstance(key, tuple) else (key,)), len(at), (v[at].T @ v[at])[upper].tolist()) for key, at in pdf.groupby(by).indices.items()]
            yield pd.DataFrame(rows, columns=[*by, "n", "g"])

    # added up by position, so that a key's partial sums never meet as a list
    parts = x.mapInPandas(partial, schema).select(*by, "n", F.posexplode("g").alias("_p", "_g"))
    sums = parts.groupBy(*by, "_p").agg(F.sum("n").alias("n"), F.sum("_g").alias("_g"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_g"))), lambda e: e["_g"]).alias("g"))


def square(g, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = g
    return out + np.triu(out, 1).T


def solve_per_key(grams: DataFrame, by: list[str], k: int | None, solve) -> DataFrame:
    """by, n, statistic, p_value from solve(n, gram matrix of k columns, or the numbers as they are) of every key; a few numbers per key."""
    schema = ", ".join(f"`{c}` {grams.schema[c].dataType.simpleString()}" for c in by) + ", n long, statistic double, p_value double"

    def run(batches):
        for pdf in batches:
            got = [solve(int(n), square(g, k) if k else np.asarray(g)) for n, g in zip(pdf["n"], pdf["g"], strict=True)]
            yield pd.concat([pdf[[*by, "n"]], pd.DataFrame(got, columns=["statistic", "p_value"], index=pdf.index)], axis=1)

    return grams.mapInPandas(run, schema)


def chi2_tail_value(x: float, df: int) -> float:
    from math import erfc, exp, gamma, sqrt

    if not x > 0:
        return 1.0
    out = exp(-x / 2) if df % 2 == 0 else erfc(sqrt(x / 2))
    return out + sum((x / 2) ** (j / 2) * exp(-x / 2) / gamma(j / 2 + 1) for j in range(2 - df % 2, df, 2))


def arch_lm(df: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Regression of the squared demeaned values on their own lags, 5 or a tenth of the values if that is less; n times R2."""
    part = Window.partitionBy(*by)
    x = df.withColumn("_d", F.col("value") - F.avg("value").over(part)).withColumn("_s", F.col("_d") * F.col("_d"))
    x = x.withColumn("_lags", F.least(F.floor(F.count("*").over(part) / 10), F.lit(most))).where("_lags > 0")
    w = window(by)
    lags = [F.when(F.col("_lags") >= k, F.lag("_s", k).over(w)).otherwise(0.0) for k in range(1, most + 1)]
    x = x.select(*by, "i", "_lags", F.row_number().over(w).alias("_k"), *[c.alias(f"c{j}") for j, c in enumerate([F.lit(1.0), *lags, F.col("_s")])])
    g = gram(x, by, [F.col(f"c{j}") for j in range(most + 2)], F.col("_k") > F.col("_lags"))

    def solve(n: int, m: np.ndarray) -> tuple[float, float]:
        own = int((np.diag(m)[1:-1] > 0).sum())  # unused lags are zero
        use = list(range(own + 1))
        beta = np.linalg.lstsq(m[np.ix_(use, use)], m[use, -1], rcond=None)[0]
        total = m[-1, -1] - m[0, -1] ** 2 / n
        r2 = 1 - (m[-1, -1] - beta @ m[use, -1]) / total if total > 0 else 0.0
        return n * r2, chi2_tail_value(n * r2, own) if own else float("nan")

    return solve_per_key(g, by, most + 2, solve)


#: The published response surface for the constant-only unit-root test (1, 1/n, 1/n^2, 1/n^3 at 1, 5, 10 %).
ADF_CRITICAL = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))
#: Polynomials of the normal score of its p-value, small and large statistics (constant-only).
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def unit_root_p(t: float) -> float:
    from statistics import NormalDist

    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    c = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return NormalDist().cdf(sum(v * t**i for i, v in enumerate(c)))


def t_of_level(n: int, m: np.ndarray, use: list[int]) -> tuple[float, float]:
    """t-ratio of the second regressor (the lagged level) and the residual sum of squares, from a Gram matrix with the target last."""
    a = m[np.ix_(use, use)]
    inv = np.linalg.pinv(a)
    beta = inv @ m[use, -1]
    rss = max(m[-1, -1] - beta @ m[use, -1], 1e-300)
    return beta[1] / np.sqrt(rss / max(n - len(use), 1) * inv[1, 1]), rss


def adf_lags(n: float) -> int:
    """The usual limit: 12 (n / 100)^(1/4), rounded up, and no more than half the values."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), int(n) // 2 - 2))


def adf(df: DataFrame, by: list[str]) -> DataFrame:
    """Augmented Dickey-Fuller with constant: lags by AIC on the common sample of all candidates (one Gram matrix holds them), then on all rows that the chosen lags leave."""
    w, most = window(by), adf_lags(longest(df, by))
    n = F.count("*").over(Window.partitionBy(*by))
    limit = F.greatest(F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)).cast("int")
    x = df.withColumn("_dx", F.col("value") - F.lag("value").over(w)).withColumn("_lx", F.lag("value").over(w)).withColumn("_lags", limit).withColumn("_k", F.row_number().over(w))
    lags = [F.when(F.col("_lags") >= j, F.coalesce(F.lag("_dx", j).over(w), F.lit(0.0))).otherwise(0.0) for j in range(1, most + 1)]
    k = most + 3
    cols = [F.col(f"c{j}") for j in range(k)]
    x = x.select(*by, "_lags", "_k", *[c.alias(f"c{j}") for j, c in enumerate([F.lit(1.0), F.col("_lx"), *lags, F.col("_dx")])])
    common = gram(x, by, cols, F.col("_k") >= F.col("_lags") + 2)

    def choose(n: int, m: np.ndarray) -> tuple[float, float]:
        limit = int((np.diag(m)[2:-1] > 0).sum())
        return min(range(limit + 1), key=lambda p: n * np.log(t_of_level(n, m, list(range(2 + p)))[1] / n) + 2 * (2 + p)), float("nan")

    best = solve_per_key(common, by, k, choose).select(*by, F.col("statistic").cast("int").alias("_best"))
    # the rows between: those that the chosen lags leave and the common sample lacks
    more = gram(x.join(best, by), by, cols, (F.col("_k") >= F.col("_best") + 2) & (F.col("_k") < F.col("_lags") + 2))
    both = common.unionByName(more).groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list("g").alias("g"))
    add = lambda u, v: F.zip_with(u, v, lambda a, b: a + b)
    total = F.aggregate("g", F.array_repeat(F.lit(0.0), k * (k + 1) // 2), add)
    # the choice rides along as a last number
    both = both.join(best, by).select(*by, "n", F.concat(total, F.array(F.col("_best").cast("double"))).alias("g"))

    def solve(n: int, m: np.ndarray) -> tuple[float, float]:
        t = t_of_level(n, square(m[:-1], k), list(range(2 + int(m[-1]))))[0]
        return t, unit_root_p(t)

    return solve_per_key(both, by, None, solve)


def phillips_perron(df: DataFrame, by: list[str]) -> DataFrame:
    """Z-tau with constant; Bartlett long-run variance over 12 (n/100)^(1/4) lags of the regression's residuals."""
    w = window(by)
    x = df.withColumn("_lx", F.lag("value").over(w)).where("_lx IS NOT NULL")
    fit = x.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("value", "_lx").alias("rho"), F.regr_intercept("value", "_lx").alias("a"), F.regr_sxx("value", "_lx").alias("sxx"))
    e = x.join(fit, by).withColumn("e", F.col("value") - F.col("a") - F.col("rho") * F.col("_lx"))
    lags = max(1, math.ceil(12 * (longest(df, by) / 100) ** 0.25))
    e = e.select(*by, "n", "rho", "sxx", "e", *[F.lead("e", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    g = e.groupBy(*by, "n", "rho", "sxx").agg(F.sum(F.col("e") * F.col("e")).alias("c0"), F.array(*[F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]).alias("c"))
    g = g.withColumn("q", F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int"), F.lit(lags)))
    lam = (F.col("c0") + 2 * F.aggregate(F.sequence(F.lit(1), F.col("q")), F.lit(0.0), lambda s, k: s + (1 - k / (F.col("q") + 1.0)) * F.element_at("c", k))) / F.col("n")
    s2 = F.col("c0") / (F.col("n") - 2)
    se = F.sqrt(s2 / F.col("sxx"))
    g0 = F.col("c0") / F.col("n")
    z = F.sqrt(g0 / lam) * (F.col("rho") - 1) / se - 0.5 * (lam - g0) / F.sqrt(lam) * (F.col("n") * se / F.sqrt(s2))
    out = g.select(*by, "n", z.alias("statistic"))
    schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in out.columns) + ", p_value double"

    def p_values(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[unit_root_p(t) for t in pdf["statistic"]])

    return out.mapInPandas(p_values, schema)


def bds(df: DataFrame, by: list[str], eps: float = 0.5, block: int = 1024) -> DataFrame:
    """BDS of dimension 2 with absolute distance, for series of any length.

    A series is put in order of value and cut into blocks; two blocks meet if their values come within ``eps``. Close
    pairs are counted in each such pair of blocks, in numpy, by row and in all; neither rows nor a matrix of pairs of a
    whole series are ever made.
    """
    part, w = Window.partitionBy(*by), window(by)
    x = df.select(*by, "i", F.col("value").alias("x")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("n", F.count("*").over(part)).where("n >= 100")
    x = x.withColumns({"_k": F.row_number().over(w), "y": F.lead("x").over(w)})
    x = x.withColumn("_r", F.row_number().over(part.orderBy("x", "_k")) - 1)
    x = x.withColumn("b", F.floor(F.col("_r") / block).cast("int")).drop("_r")
    span = x.groupBy(*by, "b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    other = span.select(*by, F.col("b").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = span.join(other, by).where("b <= b2 AND lo2 - hi < %r" % eps).select(*by, "b", "b2")
    both = meet.select(*by, F.col("b").alias("one"), F.col("b2").alias("two"), F.explode(F.array_distinct(F.array("b", "b2"))).alias("b"))
    cells = x.join(both, [*by, "b"]).select(*by, "one", "two", "b", "_k", "n", "x", "y")
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def count(table: pa.Table) -> pa.Table:
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        b, k, v, nxt = (table[c].to_numpy() for c in ("b", "_k", "x", "y"))
        a, c = b == one, b == two
        near = np.abs(v[a][:, None] - v[c][None, :]) < eps
        near &= k[a][:, None] != k[c][None, :]
        follow = near & (np.abs(nxt[a][:, None] - nxt[c][None, :]) < eps)  # the last value has no next: NaN is never near
        whole = near[k[a] > 1][:, k[c] > 1]  # as many values as there are followers
        twice = 1 if one == two else 2
        rows = [(k[a], near.sum(1)), (k[c], near.sum(0))][:twice]
        ks, deg = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        pairs = np.zeros((2, len(ks)), np.int64)
        pairs[:, 0] = twice * int(follow.sum()), twice * int(whole.sum())
        first = {f: pa.array([table[f][0].as_py()] * len(ks), table.schema.field(f).type) for f in by}
        return pa.table(first | {"n": pa.array([table["n"][0].as_py()] * len(ks), pa.int64()), "_k": pa.array(ks, pa.int64()), "deg": pa.array(deg, pa.int64()), "c2": pairs[0], "c1": pairs[1]})

    near = cells.withColumn("_k", F.col("_k").cast("long")).groupBy(*by, "one", "two").applyInArrow(count, f"{types}, n long, _k long, deg long, c2 long, c1 long")
    near = near.groupBy(*by, "n", "_k").agg(*[F.sum(c).alias(c) for c in ("deg", "c2", "c1")])
    g = near.groupBy(*by, "n").agg(F.sum("c2").alias("c2"), F.sum("c1").alias("c1"), F.sum("deg").alias("c"), F.sum(F.col("deg").cast("double") * (F.col("deg") - 1)).alias("_t"))
    n = F.col("n").cast("double")
    m = n - 1
    share, both_, all_ = F.col("c1") / (m * (m - 1)), F.col("c2") / (m * (m - 1)), F.col("c") / (n * (n - 1))
    k = F.col("_t") / (n * (n - 1) * (n - 2))
    sd = 2 * F.abs(k - all_ * all_)  # the dimension-2 case of the general variance
    z = F.when(sd > 0, F.sqrt(m) * (both_ - share * share) / sd)
    return g.select(*by, "n", z.alias("statistic")).withColumn("p_value", F.expr(scalar.two_sided("statistic")))


TESTS = {
    "adf": ("stationarity", adf),
    "kpss": ("stationarity", kpss),
    "pp": ("stationarity", phillips_perron),
    "jarque_bera": ("normality", jarque_bera),
    "shapiro": ("normality", shapiro),
    "anderson": ("normality", anderson),
    "dagostino": ("normality", dagostino),
    "ljung_box": ("autocorrelation", ljung_box),
    "durbin_watson": ("autocorrelation", durbin_watson),
    "arch_lm": ("heteroscedasticity", arch_lm),
    "breusch_pagan": ("heteroscedasticity", breusch_pagan),
    "white": ("heteroscedasticity", white),
    "bds": ("nonlinearity", bds),
    "runs": ("nonlinearity", runs),
    "mcleod_li": ("nonlinearity", lambda df, by: ljung_box(df, by, True)),
    "hill": ("tails", hill),
    "hurst": ("long_memory", hurst),
}


def battery(df: DataFrame, by: list[str], least: int = 30, tests: tuple[str, ...] = tuple(TESTS)) -> DataFrame:
    """All tests of every series with enough values: by, test, category, n, statistic, p_value."""
    x = df.withColumn("_n", F.count("value").over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")
    parts = [f(x, by).select(*by, F.lit(name).alias("test"), F.lit(cat).alias("category"), "n", "statistic", "p_value") for name, (cat, f) in TESTS.items() if name in tests]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
