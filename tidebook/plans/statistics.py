"""Queries of the statistical tests over windows of each (symbol, feature), their battery and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import battery, splits, stats
from tidebook.plans import fixtures as fx
from tidebook.plans.registry import query
from tidebook.plans.splitting import window_table
from tidebook.sources import tables

W = fx.ctes("windows")
BY = ["symbol", "feature", "win"]
K = "symbol, feature, win"
PART = f"PARTITION BY {K}"
_CENTRED = f"cv AS (SELECT *, value - avg(value) OVER ({PART}) AS dv FROM windows)"
_SKEW = "avg(dv * dv * dv) / nullif(power(avg(dv * dv), 1.5), 0) AS skewness, avg(dv * dv * dv * dv) / nullif(power(avg(dv * dv), 2), 0) - 3 AS kurtosis"
MOM = f"{W}, {_CENTRED}, mo AS (SELECT {K}, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, {_SKEW} FROM cv GROUP BY ALL)"


def _rounded(df, digits: int = 5):
    return df.select(*BY, "n", F.round("statistic", digits).alias("statistic"), F.round("p_value", 5).alias("p_value"))


def _sql(source: str, statistic: str, p: str = "NULL::DOUBLE", where: str = "", digits: int = 5) -> str:
    return f"SELECT {K}, n, round(statistic, {digits}) AS statistic, round({p}, 5) AS p_value FROM (SELECT {K}, n, {statistic} AS statistic FROM {source} {where})"


def _test(name: str, sql: str | None, digits: int = 5) -> None:
    query(f"st_{name}", sql)(lambda spark, sf: _rounded(stats.TESTS[name][1](fx.windows(spark, sf), BY), digits))


@query("st_moments", f"{MOM} SELECT {K}, n, round(mean, 7) AS mean, round(std, 7) AS std, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM mo")
def st_moments(spark, sf):
    return stats.moments(fx.windows(spark, sf), BY).select(*BY, "n", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


_test("jarque_bera", f"{MOM} {_sql('mo', stats.JB, 'exp(-statistic / 2)', digits=4)}", 4)
_test("dagostino", f"{MOM} {_sql('mo', stats.dagostino_text(), 'exp(-statistic / 2)', 'WHERE n >= 20', digits=4)}", 4)


def acf_ctes(lags: int, value: str = "value", source: str = "windows") -> str:
    return f"""dm AS (SELECT {K}, i, {value} - avg({value}) OVER ({PART}) AS d FROM {source}),
ld AS (SELECT {K}, d, {", ".join(f"lead(d, {k}) OVER ({PART} ORDER BY i) AS l{k}" for k in range(1, lags + 1))} FROM dm),
ac AS (SELECT {K}, count(*) AS n, sum(d * d) AS c0, {", ".join(f"sum(d * l{k}) / sum(d * d) AS r{k}" for k in range(1, lags + 1))} FROM ld GROUP BY ALL)"""


def _lb(value: str) -> str:
    terms = " + ".join(f"CASE WHEN least(10, n // 5) >= {k} THEN r{k} * r{k} / (n - {k}) ELSE 0 END" for k in range(1, 11))
    stat = f"n * (n + 2.0) * ({terms})"
    return f"{W}, {acf_ctes(10, value)} SELECT {K}, n, round(statistic, 4) AS statistic, round({stats.tail_by_df('statistic', 'least(10, n // 5)', 10)}, 5) AS p_value FROM (SELECT {K}, n, {stat} AS statistic FROM ac WHERE n >= 5)"


_test("ljung_box", _lb("value"), 4)
_test("mcleod_li", _lb("value * value"), 4)
_test("durbin_watson", f"{W}, dd AS (SELECT *, value - lag(value) OVER ({PART} ORDER BY i) AS d FROM windows), dw AS (SELECT {K}, count(*) AS n, sum(d * d) / sum(value * value) AS s FROM dd GROUP BY ALL) {_sql('dw', 's')}")
_DET = f"{W}, ft AS (SELECT {K}, regr_slope(value, i) AS b, regr_intercept(value, i) AS a FROM windows GROUP BY ALL), e2 AS (SELECT {K}, i::DOUBLE AS t, i::DOUBLE * i AS s, power(value - a - b * i, 2) AS e2 FROM windows JOIN ft USING ({K}))"
_test("breusch_pagan", f"{_DET}, bp AS (SELECT {K}, count(*) AS n, count(*) * regr_r2(e2, t) AS s FROM e2 GROUP BY ALL) {_sql('bp', 's', scalar.chi2_tail('statistic', 1))}")
_test("white", f"{_DET}, wh AS (SELECT {K}, count(*) AS n, corr(e2, t) AS a, corr(e2, s) AS b, corr(t, s) AS c FROM e2 GROUP BY ALL) {_sql('wh', 'n * ((a * a + b * b - 2 * a * b * c) / (1 - c * c))', scalar.chi2_tail('statistic', 2))}")
_test(
    "runs",
    f"""{W}, md AS (SELECT {K}, median(value) AS m FROM windows GROUP BY ALL), sg AS (SELECT {K}, i, (value > m)::INT AS s FROM windows JOIN md USING ({K})), ch AS (SELECT *, s <> lag(s) OVER ({PART} ORDER BY i) AS c FROM sg),
rr AS (SELECT {K}, count(*) AS n, 2.0 * sum(s) * (count(*) - sum(s)) AS p2, sum(c::INT) + 1 AS r FROM ch GROUP BY ALL) {_sql("rr", "(r - p2 / n - 1) / sqrt(p2 * (p2 - n) / (n * n * (n - 1.0)))", scalar.two_sided("statistic"), "WHERE p2 > 0")}""",
)
_test(
    "hill",
    f"""{W}, aa AS (SELECT {K}, abs(value) AS a FROM windows WHERE value <> 0), ar AS (SELECT *, row_number() OVER ({PART} ORDER BY a DESC) AS r, count(*) OVER ({PART}) AS n FROM aa), ak AS (SELECT *, greatest(10, floor(n * 0.1)) AS k FROM ar),
hl AS (SELECT {K}, max(n) AS n, 1.0 / (sum(CASE WHEN r < k THEN ln(a) END) / (max(k) - 1) - ln(min(a))) AS s FROM ak WHERE r <= k GROUP BY ALL) {_sql("hl", "s")}""",
)
_test(
    "hurst",
    f"""{W}, cn AS (SELECT *, count(*) OVER ({PART}) AS n FROM windows), lg AS (SELECT DISTINCT {K}, i, value, n, floor(exp(ln(10.0) + j * (ln(n / 2) - ln(10.0)) / 19) + 1e-9) AS lag FROM cn, range(20) t(j) WHERE n >= 20),
ck AS (SELECT *, floor((i - 1) / lag) AS c FROM lg WHERE (floor((i - 1) / lag) + 1) * lag <= n), dv AS (SELECT *, value - avg(value) OVER ({PART}, lag, c) AS d FROM ck), cu AS (SELECT *, sum(d) OVER ({PART}, lag, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM dv),
rs AS (SELECT {K}, n, lag, c, max(cum) - min(cum) AS r, sqrt(avg(d * d)) AS s FROM cu GROUP BY ALL), rl AS (SELECT {K}, n, lag, avg(r / s) AS rs FROM rs WHERE s > 0 GROUP BY ALL),
hu AS (SELECT {K}, n, regr_slope(ln(rs), ln(lag)) AS s FROM rl WHERE rs > 0 GROUP BY ALL) {_sql("hu", "s")}""",
)
_q1 = "floor(power(n, 2.0 / 9))::INT"
_test(
    "kpss",
    f"""{W}, dm AS (SELECT {K}, i, value - avg(value) OVER ({PART}) AS d FROM windows), cs AS (SELECT *, sum(d) OVER ({PART} ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, {", ".join(f"lead(d, {k}) OVER ({PART} ORDER BY i) AS l{k}" for k in range(1, 5))} FROM dm),
kp AS (SELECT {K}, count(*) AS n, sum(s * s) AS ss, sum(d * d) AS c0, [{", ".join(f"coalesce(sum(d * l{k}), 0)" for k in range(1, 5))}] AS c FROM cs GROUP BY ALL HAVING count(*) >= 20 AND sum(d * d) > 0),
ks AS (SELECT *, list_sum(list_transform(range(1, {_q1} + 1), lambda k: k * c[k] / (n / 2))) / (c0 / n + list_sum(list_transform(range(1, {_q1} + 1), lambda k: c[k] / (n / 2)))) AS r FROM kp),
kq AS (SELECT {K}, n, ss, c0, least(floor(1.1447 * cbrt(r * r) * cbrt(n))::INT, n - 1) AS q FROM ks),
kl AS (SELECT a.symbol, a.feature, a.win, sum((1 - (b.i - a.i) / (q + 1.0)) * a.d * b.d) AS long FROM dm a JOIN kq ON a.symbol = kq.symbol AND a.feature = kq.feature AND a.win = kq.win JOIN dm b ON a.symbol = b.symbol AND a.feature = b.feature AND a.win = b.win AND b.i > a.i AND b.i <= a.i + q GROUP BY ALL),
kz AS (SELECT kq.*, coalesce(long, 0) AS long FROM kq LEFT JOIN kl USING ({K})) {_sql("kz", "ss / (n * n) / ((c0 + 2 * long) / n)", stats.kpss_p("statistic"), digits=4)}""",
    4,
)
@query(
    "st_anderson",
    f"""{MOM}, zz AS (SELECT {K}, n, (value - mean) / std AS z, row_number() OVER ({PART} ORDER BY value) AS r FROM windows JOIN mo USING ({K}) WHERE std > 0),
ad AS (SELECT {K}, n, sum((2 * r - 1) * ln(greatest({scalar.norm_cdf("z")}, 1e-300)) + (2 * (n + 1 - r) - 1) * ln(greatest({scalar.norm_cdf("(-z)")}, 1e-300))) AS s FROM zz GROUP BY ALL) SELECT {K}, n, round(-n - s / n, 4) AS statistic, {", ".join(f"round({c} / (1 + 4.0 / n - 25.0 / (n * n)), 3)::DOUBLE AS critical_{p}" for p, c in zip((1, 5, 10), battery.ANDERSON_CRITICAL))} FROM ad""",
)
def st_anderson(spark, sf):
    """The statistic and its critical values at 1, 5 and 10 %; it has no p-value."""
    critical = [c.alias(f"critical_{p}") for p, c in zip((1, 5, 10), battery.anderson_critical(), strict=True)]
    return stats.anderson(fx.windows(spark, sf), BY).select(*BY, "n", F.round("statistic", 4).alias("statistic"), *critical)


_t = stats.shapiro_texts()
_test(
    "shapiro",
    f"""{W}, r0 AS (SELECT {K}, value, row_number() OVER ({PART} ORDER BY value)::DOUBLE AS r, count(*) OVER ({PART}) AS n FROM windows), r1 AS (SELECT *, {_t["m"]} AS m FROM r0 WHERE n >= 3),
r2 AS (SELECT *, sum(m * m) OVER ({PART}) AS mm, max(m) OVER ({PART}) AS mn, max(CASE WHEN r = n - 1 THEN m END) OVER ({PART}) AS mk FROM r1),
sw AS (SELECT {K}, n, sum({_t["a"]} * value) AS s, var_pop(value) * count(*) AS v FROM r2 GROUP BY ALL), sx AS (SELECT {K}, n, s * s / v AS statistic FROM sw WHERE v > 0), sy AS (SELECT *, {_t["score"]} AS score FROM sx)
SELECT {K}, n, round(statistic, 5) AS statistic, round({_t["p"]}, 5) AS p_value FROM sy""",
)
_test("bds", None)


def _solved(spark, sf):
    """What is solved from the lag products of every window: one exchange of the windows, one row each."""
    x = tables.stored(fx.windows(spark, sf), "windows")
    lags = battery.most_lags(stats.longest(x, BY))
    return battery.solved(battery.lag_sums(x, BY, lags), BY, lags)


def _figures(name: str, n, *more):
    return (*BY, n.cast("long").alias("n"), F.round(name, 5).alias("statistic"), F.round(f"{name}_p", 5).alias("p_value"), F.col(f"{name}_lags").alias("n_lags"), *more)


@query("st_adf")
def st_adf(spark, sf):
    """Augmented Dickey-Fuller with the lags that AIC chose, the rows used and their critical values."""
    critical = [F.round(c, 5).alias(f"critical_{p}") for p, c in zip((1, 5, 10), battery.adf_critical(), strict=True)]
    return _solved(spark, sf).where("adf IS NOT NULL").select(*_figures("adf", F.col("adf_n"), *critical))


@query("st_pp")
def st_pp(spark, sf):
    return _solved(spark, sf).where("pp IS NOT NULL").select(*_figures("pp", F.col("n") - 1))


@query("st_arch_lm")
def st_arch_lm(spark, sf):
    return _solved(spark, sf).where("arch IS NOT NULL").select(*_figures("arch", F.col("n")))


@query("acf", f"{W}, {acf_ctes(20)} SELECT {K}, n, k::INT AS k, round(r[k], 6) AS acf FROM (SELECT {K}, n, [{', '.join(f'r{k}' for k in range(1, 21))}] AS r FROM ac), range(1, 21) t(k)")
def acf(spark, sf):
    x = stats.acf(fx.windows(spark, sf), BY).select(*BY, "n", F.posexplode("acf").alias("k", "acf"))
    return x.select(*BY, "n", (F.col("k") + 1).alias("k"), F.round("acf", 6).alias("acf"))


# battery and summaries

WINDOW_KEY = ["split_id", "fold_id", "feature"]
_DONE: dict[tuple[str, str], str] = {}


def window_series(spark, sf):
    """split_id, fold_id, feature, i, value: the features in the representative windows, return features by the stride of their look-back, nulls left out."""
    x = splits.rows_of_windows(fx.long(spark, sf, whole=True), window_table(spark, sf))
    w = Window.partitionBy(*WINDOW_KEY).orderBy("us", "event_id")
    stride = F.when(F.col("feature").rlike("past_logret"), F.regexp_extract("feature", r"_(\d+)$", 1).cast("int")).otherwise(1)
    x = x.withColumn("k", F.row_number().over(w) - 1).where((F.col("k") % stride == 0) & F.col("value").isNotNull())
    return x.select(*WINDOW_KEY, F.row_number().over(Window.partitionBy(*WINDOW_KEY).orderBy("k")).alias("i"), "value")


def battery_of(spark, sf):
    """Every test of every series of a representative window, with its fold type. Worked out once in a session for a folder of tables and stored."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DONE:
        out = battery.battery(window_series(spark, sf), WINDOW_KEY, tables.stored)
        path = tables.folder(spark, "battery")
        out.withColumn("fold_type", F.lit("train")).write.parquet(path)  # windows lie in train folds only
        _DONE[key] = path
    return spark.read.parquet(_DONE[key])


@query("st_battery")
def st_battery(spark, sf):
    """One row a test: split, fold, feature, sizes, statistic, p-value, lags used and critical values."""
    digits = {c: F.round(c, 6) for c in ("statistic", "p_value", "critical_1", "critical_5", "critical_10", "skewness", "kurtosis")}
    return battery_of(spark, sf).withColumns(digits)


_LO, _HI, _SE = scalar.wilson("k", "n")
CLOSED = ("jarque_bera", "breusch_pagan", "runs")


def results(spark, sf):
    """The tests that SQL can express too."""
    return stats.battery(fx.windows(spark, sf), BY, tests=CLOSED).withColumn("sig", F.col("p_value") < 0.05)


#: What a feature's windows are judged by: a test and the condition that counts.
JUDGED = {"stationary": ("adf", "p_value < 0.05"), "normal": ("jarque_bera", "p_value > 0.05"), "autocorrelated": ("ljung_box", "p_value < 0.05")}


def _share(what: str):
    test, holds = JUDGED[what]
    return F.try_divide(100.0 * F.count_if((F.col("test") == test) & F.expr(holds)), F.count_if(F.col("test") == test))


@query("sf_summary")
def sf_summary(spark, sf):
    """By test category: p-values and the share that is significant. By feature: shares of windows stationary, normal and autocorrelated, mean kurtosis. By fold type: what was tested."""
    x = battery_of(spark, sf)
    every = [F.count("*").alias("n_tests")]
    p = [F.round(F.avg("p_value"), 5).alias("mean_p"), F.round(F.median("p_value"), 5).alias("median_p"), F.round(F.try_divide(100.0 * F.count_if(F.col("p_value") < 0.05), F.count("p_value")), 4).alias("pct_significant")]
    own = [F.count_distinct("fold_id").alias("n_windows"), *[F.round(_share(k), 4).alias(f"pct_{k}") for k in JUDGED], F.round(F.avg("kurtosis"), 5).alias("mean_kurtosis")]
    kinds = [F.count_distinct("feature").alias("n_features"), F.count_distinct("fold_id").alias("n_folds")]
    parts = [x.groupBy(F.lit(level).alias("level"), F.col(level).alias("name")).agg(*every, *figures) for level, figures in (("category", p), ("feature", own), ("fold_type", kinds))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def with_t_interval(x):
    """Adds se, low and high to n, mean and std: Student's t at 95 %."""
    t = x.sparkSession.createDataFrame(list(T_TABLE.items()), "_df long, _t double")
    x = x.join(F.broadcast(t), F.col("n") - 1 == F.col("_df"), "left")
    x = x.withColumn("se", F.col("std") / F.sqrt("n")).withColumn("_h", F.col("se") * F.coalesce("_t", F.expr(t_beyond("n - 1"))))
    return x.withColumns({"low": F.col("mean") - F.col("_h"), "high": F.col("mean") + F.col("_h")}).drop("_df", "_t", "_h")


FIGURES = ("mean", "std", "se", "low", "high", "median", "min", "max")


@query("sf_summary_ci")
def sf_summary_ci(spark, sf):
    """Per category and per feature: shares of windows with Wilson intervals; p-values, kurtosis and skewness with t-intervals. One row a figure."""
    x = battery_of(spark, sf)
    names = lambda level: [F.lit(level).alias("level"), F.col(level).alias("name")]
    hits = x.where("p_value IS NOT NULL").select(*names("category"), F.lit("significant").alias("what"), F.expr("p_value < 0.05").alias("hit"))
    for what, (test, holds) in JUDGED.items():
        hits = hits.unionByName(x.where(F.col("test") == test).select(*names("feature"), F.lit(what).alias("what"), F.coalesce(F.expr(holds), F.lit(False)).alias("hit")))
    share = hits.groupBy("level", "name", "what").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    share = share.select("level", "name", "what", "n", (F.col("k") / F.col("n")).alias("mean"), F.expr(_SE).alias("se"), F.expr(_LO).alias("low"), F.expr(_HI).alias("high"))
    values = x.select(*names("category"), F.lit("p_value").alias("what"), F.col("p_value").alias("v"))
    for what, (test, _) in JUDGED.items():
        values = values.unionByName(x.where(F.col("test") == test).select(*names("feature"), F.lit(f"{what}_p").alias("what"), F.col("p_value").alias("v")))
    for what in ("kurtosis", "skewness"):
        values = values.unionByName(x.where("test = 'moments'").select(*names("feature"), F.lit(what).alias("what"), F.col(what).alias("v")))
    m = values.where("v IS NOT NULL").groupBy("level", "name", "what").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = with_t_interval(m).unionByName(share, allowMissingColumns=True)
    return out.select("level", "name", "what", "n", *[F.round(c, 7).alias(c) for c in FIGURES])


@query("sf_violations")
def sf_violations(spark, sf):
    """Features that break a rule, with the figure and its interval: under half the windows stationary, under 30 % normal, mean kurtosis over 5, over 30 % autocorrelated."""
    x = sf_summary_ci(spark, sf).where("level = 'feature'")
    of = lambda what, rule, broken: x.where((F.col("what") == what) & broken).select(F.col("name").alias("feature"), F.lit(rule).alias("violation"), "n", *[F.col(c) * (1 if what == "kurtosis" else 100) for c in ("mean", "low", "high")])
    m = F.col("mean")
    parts = [of("stationary", "not_stationary", m < 0.5), of("normal", "not_normal", m < 0.3), of("kurtosis", "fat_tails", m > 5), of("autocorrelated", "autocorrelated", m > 0.3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("feature", "violation", "n", "value", "low", "high")


RES = f"""{_DET}, {_CENTRED}, mo AS (SELECT {K}, count(value) AS n, {_SKEW} FROM cv GROUP BY ALL HAVING count(value) >= 30),
bp AS (SELECT {K}, count(*) AS n, count(*) * regr_r2(e2, t) AS s FROM e2 GROUP BY ALL HAVING count(*) >= 30),
md AS (SELECT {K}, median(value) AS m FROM windows GROUP BY ALL), sg AS (SELECT {K}, i, (value > m)::INT AS s FROM windows JOIN md USING ({K})), ch AS (SELECT *, s <> lag(s) OVER ({PART} ORDER BY i) AS c FROM sg),
rr AS (SELECT {K}, count(*) AS n, 2.0 * sum(s) * (count(*) - sum(s)) AS p2, sum(c::INT) + 1 AS r FROM ch GROUP BY ALL HAVING count(*) >= 30),
res AS (SELECT {K}, 'jarque_bera' AS test, 'normality' AS category, exp(-{stats.JB} / 2) AS p_value FROM mo UNION ALL SELECT {K}, 'breusch_pagan', 'heteroscedasticity', {scalar.chi2_tail("s", 1)} FROM bp
 UNION ALL SELECT {K}, 'runs', 'nonlinearity', {scalar.two_sided("((r - p2 / n - 1) / sqrt(p2 * (p2 - n) / (n * n * (n - 1.0))))")} FROM rr WHERE p2 > 0)"""


@query("sf_summary_closed", f"{RES} SELECT category, feature, count(*) AS n, round(avg(p_value), 5) AS mean_p, round(median(p_value), 5) AS median_p, round(100.0 * sum((p_value < 0.05)::INT) / count(*), 4) AS pct_significant FROM res GROUP BY GROUPING SETS ((category), (feature), (category, feature))")
def sf_summary_closed(spark, sf):
    """By category, by feature and by both, in one pass."""
    sets = results(spark, sf).groupingSets([["category"], ["feature"], ["category", "feature"]], "category", "feature")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("p_value"), 5).alias("mean_p"), F.round(F.median("p_value"), 5).alias("median_p"), F.round(100.0 * F.count_if("sig") / F.count("*"), 4).alias("pct_significant"))




@query("sf_summary_ci_closed", f"{RES}, cc AS (SELECT category, feature, count(*) AS n, sum((p_value < 0.05)::INT)::BIGINT AS k FROM res GROUP BY ALL) SELECT category, feature, n, k, round({_LO}, 7) AS low, round({_HI}, 7) AS high FROM cc")
def sf_summary_ci_closed(spark, sf):
    x = results(spark, sf).groupBy("category", "feature").agg(F.count("*").alias("n"), F.count_if("sig").alias("k"))
    return x.select("category", "feature", "n", "k", F.round(F.expr(_LO), 7).alias("low"), F.round(F.expr(_HI), 7).alias("high"))


@query(
    "sf_violations_closed",
    f"""{RES}, fe AS (SELECT feature, 100.0 * sum((category = 'normality' AND p_value >= 0.05)::INT) / nullif(sum((category = 'normality')::INT), 0) AS normal FROM res GROUP BY feature), ku AS (SELECT feature, avg(kurtosis) AS kurtosis FROM mo GROUP BY feature)
SELECT feature, round(normal, 4) AS pct_normal, round(kurtosis, 4) AS mean_kurtosis, normal < 30 AS not_normal, kurtosis > 5 AS fat_tails FROM fe JOIN ku USING (feature) WHERE normal < 30 OR kurtosis > 5""",
)
def sf_violations_closed(spark, sf):
    r = results(spark, sf).where("category = 'normality'").groupBy("feature").agg((100.0 * F.count_if(~F.col("sig")) / F.count("*")).alias("normal"))
    k = stats.moments(fx.windows(spark, sf), BY).where("n >= 30").groupBy("feature").agg(F.avg("kurtosis").alias("kurtosis"))
    x = r.join(k, "feature").withColumn("not_normal", F.col("normal") < 30).withColumn("fat_tails", F.col("kurtosis") > 5).where("not_normal OR fat_tails")
    return x.select("feature", F.round("normal", 4).alias("pct_normal"), F.round("kurtosis", 4).alias("mean_kurtosis"), "not_normal", "fat_tails")


def t_quantile(p: float, df: int) -> float:
    """Student's t by bisection on the incomplete beta's continued fraction; once per df on the driver."""
    from math import exp, lgamma, log

    def cdf(t: float) -> float:
        x, a, b = df / (df + t * t), df / 2, 0.5
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0

        def cf(a: float, b: float, x: float) -> float:
            c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
            h = d
            for m in range(1, 300):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
                    h *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            return h

        tail = front * cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * cf(b, a, 1 - x) / b
        return 1 - tail / 2

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


T_TABLE = {df: t_quantile(0.975, df) for df in range(1, 201)}
Z = 1.959963984540054


def t_beyond(df: str) -> str:
    """Student's t at 97.5 % for many degrees of freedom as text: the normal quantile with its corrections in powers of 1/df (off by less than 1e-9 from 200 on)."""
    terms = ((Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384)
    return f"({scalar.num(Z)} + " + " + ".join(f"{scalar.num(t)} / power(CAST({df} AS DOUBLE), {k})" for k, t in enumerate(terms, 1)) + ")"


_T = "CASE " + " ".join(f"WHEN n - 1 = {df} THEN {t!r}" for df, t in T_TABLE.items()) + f" ELSE {t_beyond('(n - 1)')} END"


@query("mean_t_ci", f"{MOM}, g AS (SELECT symbol, feature, count(*) AS n, avg(kurtosis) AS mean, stddev_samp(kurtosis) AS std FROM mo GROUP BY ALL) SELECT symbol, feature, n, round(mean, 5) AS mean, round(std / sqrt(n), 5) AS se, round(mean - std / sqrt(n) * {_T}, 4) AS low, round(mean + std / sqrt(n) * {_T}, 4) AS high FROM g")
def mean_t_ci(spark, sf):
    """Mean kurtosis of a feature's windows with its t-interval; quantiles by degrees of freedom as a small table, by their expansion beyond it."""
    x = stats.moments(fx.windows(spark, sf), BY).groupBy("symbol", "feature").agg(F.count("*").alias("n"), F.avg("kurtosis").alias("mean"), F.stddev("kurtosis").alias("std"))
    return with_t_interval(x).select("symbol", "feature", "n", F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
