"""The tests' values against plain numpy, worked out another way than in the operators; summaries against the battery's rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidebook.operators import stats
from tidebook.plans.catalog import QUERIES


def draws():
    rng = np.random.default_rng(17)
    ar = [0.0]
    for e in rng.normal(size=299):
        ar.append(0.7 * ar[-1] + e)
    return {"noise": rng.normal(size=250), "walk": rng.normal(size=400).cumsum(), "ar": np.array(ar), "fat": rng.standard_t(3, 180), "short": rng.normal(size=40)}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, i + 1, float(v)) for k, x in draws().items() for i, v in enumerate(x)], "k string, i int, value double").cache()


def both(rows, f, plain, digits=6):
    got = {r.k: r.statistic for r in f(rows, ["k"]).collect()}
    for k, x in draws().items():
        want = plain(x)
        assert abs(got[k] - want) < 10**-digits * max(1, abs(want)), (k, got[k], want)


def ols(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / (len(y) - x.shape[1])
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))), e


def plain_adf(x):
    d, limit = np.diff(x), min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)

    def fit(lags, skip):
        t = np.arange(skip, len(d))
        cols = [np.ones(len(t)), x[t], *[d[t - k] for k in range(1, lags + 1)]]
        return ols(d[t], np.stack(cols, 1)), len(t)

    def aic(lags):
        (_, _, e), n = fit(lags, limit)
        return n * (np.log(2 * np.pi) + np.log(e @ e / n) + 1) + 2 * (lags + 2)

    (beta, se, _), _ = fit(best := min(range(limit + 1), key=aic), best)
    return beta[1] / se[1]


def plain_pp(x):
    beta, se, e = ols(x[1:], np.stack([np.ones(len(x) - 1), x[:-1]], 1))
    n, q = len(e), math.ceil(12 * ((len(x) - 1) / 100) ** 0.25)
    g = [e[k:] @ e[: n - k] / n for k in range(q + 1)]
    lam = g[0] + 2 * sum((1 - k / (q + 1)) * g[k] for k in range(1, q + 1))
    s2 = e @ e / (n - 2)
    return math.sqrt(g[0] / lam) * (beta[1] - 1) / se[1] - 0.5 * (lam - g[0]) / math.sqrt(lam) * n * se[1] / math.sqrt(s2)


def plain_kpss(x):
    d, n = x - x.mean(), len(x)
    c = lambda k: d[k:] @ d[: n - k]
    few = int(n ** (2 / 9))
    s0 = c(0) / n + 2 / n * sum(c(k) for k in range(1, few + 1))
    s1 = 2 / n * sum(k * c(k) for k in range(1, few + 1))
    q = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    return (d.cumsum() ** 2).sum() / n**2 / ((c(0) + 2 * sum((1 - k / (q + 1)) * c(k) for k in range(1, q + 1))) / n)


def plain_arch(x):
    s, lags = (x - x.mean()) ** 2, min(5, len(x) // 10)
    y = s[lags:]
    _, _, e = ols(y, np.stack([np.ones(len(y)), *[s[lags - k : len(s) - k] for k in range(1, lags + 1)]], 1))
    return len(y) * (1 - e @ e / ((y - y.mean()) ** 2).sum())


def plain_ljung_box(x):
    d, n = x - x.mean(), len(x)
    r = [d[k:] @ d[: n - k] / (d @ d) for k in range(1, min(10, n // 5) + 1)]
    return n * (n + 2) * sum(v * v / (n - k) for k, v in enumerate(r, 1))


def plain_jb(x):
    d = x - x.mean()
    m = [np.mean(d**k) for k in range(5)]
    return len(x) / 6 * ((m[3] / m[2] ** 1.5) ** 2 + (m[4] / m[2] ** 2 - 3) ** 2 / 4)


def plain_bds(x, eps=0.5):
    n = len(x)
    near = lambda i, j: abs(x[i] - x[j]) < eps
    pairs = [(i, j) for i in range(1, n) for j in range(i + 1, n)]
    c1 = np.mean([near(i, j) for i, j in pairs])
    c2 = np.mean([near(i, j) and near(i - 1, j - 1) for i, j in pairs])
    c = np.mean([near(i, j) for i in range(n) for j in range(i + 1, n)])
    deg = [sum(near(i, j) for j in range(n) if j != i) for i in range(n)]
    k = sum(g * (g - 1) for g in deg) / (n * (n - 1) * (n - 2))
    return math.sqrt(n - 1) * (c2 - c1**2) / (2 * abs(k - c**2))


@pytest.mark.parametrize("name", ["adf", "pp", "kpss", "arch", "ljung_box", "jb"])
def test_values(rows, name):
    f = {"adf": stats.adf, "pp": stats.phillips_perron, "kpss": stats.kpss, "arch": stats.arch_lm, "ljung_box": stats.ljung_box, "jb": stats.jarque_bera}[name]
    both(rows, f, globals()[f"plain_{name}"], 5)


@pytest.mark.parametrize("block", [1024, 50])
def test_bds_by_blocks_of_values(spark, block):
    """Whole or in blocks; discrete values with distances of just the bound, and ties."""
    rng = np.random.default_rng(3)
    series = {"noise": rng.normal(size=230), "walk": rng.normal(size=180).cumsum(), "grid": rng.integers(0, 9, 210) / 4, "near": rng.normal(size=120) * 0.01 + 3, "short": rng.normal(size=99)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, x in series.items() for i, v in enumerate(x)], "sid string, i int, value double")
    got = {r.sid: r for r in stats.bds(df, ["sid"], block=block).collect()}
    assert set(got) == set(series) - {"short"} and got["near"].statistic is None
    for k in ("noise", "walk", "grid"):
        assert got[k].statistic == pytest.approx(plain_bds(series[k]), rel=1e-9) and got[k].n == len(series[k])


#: Published critical values and worked examples: (test, statistic, p within).
KNOWN_P = [(-3.43, 0.01, 0.002), (-2.86, 0.05, 0.004), (-2.57, 0.10, 0.006)]


def test_tails_against_published_quantiles(spark):
    from tidebook.functions import scalar

    for t, p, slack in KNOWN_P:
        assert abs(stats.unit_root_p(t) - p) < slack
    one = lambda e: spark.sql(f"SELECT {e} AS p").first().p
    for x, df, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (9.210, 2, 0.01), (11.070, 5, 0.05), (18.307, 10, 0.05)):
        assert abs(one(scalar.chi2_tail(scalar.num(x), df)) - p) < 1e-4
    for z, p in ((1.959964, 0.05), (2.575829, 0.01)):
        assert abs(one(scalar.two_sided(scalar.num(z))) - p) < 1e-6
    low, high, _ = (one(e) for e in scalar.wilson("20", "50"))
    assert abs(low - 0.2761) < 2e-4 and abs(high - 0.5382) < 2e-4


def test_shapiro_of_published_and_few_values(spark):
    # eleven weights of men, the example of the test's own paper: W 0.79 and a tail under 0.01
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    sets = {"men": men, "three": [1.0, 2.0, 4.0], "five": [2.1, 2.9, 3.4, 4.0, 5.2]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in sets.items() for i, v in enumerate(x, 1)], "k string, i int, value double")
    got = {r.k: (r.statistic, r.p_value) for r in stats.shapiro(df, ["k"]).collect()}
    assert abs(got["men"][0] - 0.79) < 0.005 and got["men"][1] < 0.01
    a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)]) @ np.array(sets["three"])
    w = a * a / (np.var(sets["three"]) * 3)
    assert abs(got["three"][0] - w) < 1e-9 and abs(got["three"][1] - 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))) < 1e-6
    assert 0.9 < got["five"][0] <= 1 and 0.5 < got["five"][1] <= 1


def test_normalising_transforms_by_their_definitions(spark):
    from tidebook.functions import scalar

    box_cox = lambda x, l: math.log(x) if l == 0 else (x**l - 1) / l
    yeo = lambda x, l: (math.log1p(x) if l == 0 else ((x + 1) ** l - 1) / l) if x >= 0 else (-math.log1p(-x) if l == 2 else -((1 - x) ** (2 - l) - 1) / (2 - l))
    one = lambda e: spark.sql(f"SELECT {e} AS y").first().y
    for x in (0.3, 2.5):
        for l in (-1.0, 0.0, 0.5, 2.0):
            assert abs(one(scalar.transform("box_cox", scalar.num(x), "0.0", scalar.num(l))) - box_cox(x, l)) < 1e-12
    for x in (-2.5, -0.3, 0.0, 1.7):
        for l in (-1.0, 0.0, 1.0, 2.0):
            assert abs(one(scalar.transform("yeo_johnson", scalar.num(x), "0.0", scalar.num(l))) - yeo(x, l)) < 1e-12
    assert one(scalar.zscore_clip("9.0D", "1.0D", "4.0D")) == 3.0 and abs(one(scalar.zscore_clip("2.0D", "1.0D", "4.0D")) - 0.5) < 1e-9
    assert abs(one(scalar.position_from_policy("0.8D", "0.6D", 0.5)) - 0.8 * math.exp(-0.25)) < 1e-12


def test_battery_is_its_tests(spark, rows):
    """The fused pass against the single tests, which are held against numpy above; lags, sizes and critical values; bandwidths beyond the lag products."""
    from tidebook.operators import battery
    from tidebook.sources import tables

    series = rows.withColumnRenamed("k", "sid")
    got = {(r.sid, r.test): r for r in battery.battery(series, ["sid"], tables.stored).collect()}
    assert {t for _, t in got} == set(battery.CATEGORIES)
    for name, (_, f) in stats.TESTS.items():
        for r in f(series, ["sid"]).collect():
            g = got[r.sid, name]
            assert g.statistic == pytest.approx(r.statistic, rel=1e-7, abs=1e-9), (name, r.sid)
            assert (g.p_value is None) == (r.p_value is None) and (r.p_value is None or g.p_value == pytest.approx(r.p_value, abs=1e-7)), (name, r.sid)
    n = len(draws()["noise"])
    adf, lb, ad, mo = (got["noise", t] for t in ("adf", "ljung_box", "anderson", "moments"))
    assert adf.n_obs == n - 1 - adf.n_lags and lb.n_lags == 10 and mo.kurtosis is not None and mo.statistic is None
    assert adf.critical_5 == pytest.approx(-2.86154 - 2.8903 / adf.n_obs - 4.234 / adf.n_obs**2 - 40.040 / adf.n_obs**3, abs=1e-9)
    assert (ad.critical_1, ad.critical_5, ad.critical_10) == tuple(round(c / (1 + 4 / n - 25 / n**2), 3) for c in (1.092, 0.787, 0.656))
    lags = battery.most_lags(400)
    for r in battery.solved(battery.lag_sums(series, ["sid"], lags), ["sid"], lags).collect():
        assert (r.adf, r.adf_lags, r.pp, r.arch) == pytest.approx((got[r.sid, "adf"].statistic, got[r.sid, "adf"].n_lags, got[r.sid, "pp"].statistic, got[r.sid, "arch_lm"].statistic), rel=1e-9)
    slow = spark.createDataFrame([("slow", i + 1, (-1.0) ** i + 0.05 * ((i * 7919) % 101) / 101) for i in range(300)], "sid string, i int, value double")
    far = {r.test: r for r in battery.battery(slow, ["sid"], tables.stored).collect()}["kpss"]
    assert far.n_lags > battery.most_lags(300) and far.statistic == pytest.approx(stats.kpss(slow, ["sid"]).first().statistic, rel=1e-9)


def test_summaries_are_those_of_the_battery(spark, sf):
    rows = QUERIES["st_battery"](spark, sf).collect()
    got = {(r.level, r.name): r for r in QUERIES["sf_summary"](spark, sf).collect()}
    own = defaultdict(list)
    for r in rows:
        for level in ("category", "feature", "fold_type"):
            own[level, r[level]].append(r)
    assert set(got) == set(own)
    judged = {"stationary": ("adf", lambda p: p < 0.05), "normal": ("jarque_bera", lambda p: p > 0.05), "autocorrelated": ("ljung_box", lambda p: p < 0.05)}
    hit = lambda of, what: [judged[what][1](r.p_value) for r in of if r.test == judged[what][0]]
    ci = {(r.level, r.name, r.what): r for r in QUERIES["sf_summary_ci"](spark, sf).collect()}
    broken = set()
    for (level, name), of in own.items():
        g, p = got[level, name], [r.p_value for r in of if r.p_value is not None]
        assert g.n_tests == len(of)
        if level == "category":
            assert (g.mean_p is None) == (not p)
            if p:
                assert g.mean_p == pytest.approx(np.mean(p), abs=1e-4) and ci[level, name, "significant"].mean == pytest.approx(np.mean(np.array(p) < 0.05), abs=0.01)
        if level == "fold_type":
            assert g.n_features == len({r.feature for r in of}) and g.n_folds == len({r.fold_id for r in of})
        if level == "feature":
            kurtosis = np.array([r.kurtosis for r in of if r.test == "moments"])
            assert g.mean_kurtosis == pytest.approx(kurtosis.mean(), abs=1e-4)
            for what in judged:
                h = hit(of, what)
                c = ci[level, name, what]
                assert g[f"pct_{what}"] == pytest.approx(100 * np.mean(h), abs=0.5) and c.n == len(h)
                z = 1.959963984540054
                mid, half = (np.mean(h) + z * z / (2 * len(h))) / (1 + z * z / len(h)), z * math.sqrt(np.mean(h) * (1 - np.mean(h)) / len(h) + z * z / (4 * len(h) ** 2)) / (1 + z * z / len(h))
                assert (c.low, c.high) == pytest.approx((max(0, mid - half), min(1, mid + half)), abs=1e-3)
            broken |= {(name, v) for v, bad in (("not_stationary", np.mean(hit(of, "stationary")) < 0.5), ("not_normal", np.mean(hit(of, "normal")) < 0.3), ("fat_tails", kurtosis.mean() > 5), ("autocorrelated", np.mean(hit(of, "autocorrelated")) > 0.3)) if bad}
    assert {(r.feature, r.violation) for r in QUERIES["sf_violations"](spark, sf).collect()} == broken


def test_quantiles_of_t_beyond_the_table(spark):
    """Published values at 97.5 %, and no step where the table ends."""
    from tidebook.plans import statistics

    at = lambda df: spark.sql(f"SELECT {statistics.t_beyond(str(df))} AS t").first().t
    assert at(1000) == pytest.approx(1.962339, abs=1e-6) and at(500) == pytest.approx(1.964720, abs=1e-6) and at(200) == pytest.approx(statistics.T_TABLE[200], abs=1e-8)
    assert statistics.T_TABLE[10] == pytest.approx(2.228139, abs=1e-6)


def test_tail_of_kolmogorov(spark):
    """The limit distribution's published 5 and 1 % points, with many values on both sides."""
    from tidebook.operators import quality

    for t, p in ((1.3581, 0.05), (1.6276, 0.01)):
        n = 2_000_000
        d = t / math.sqrt(n / 2)
        assert spark.sql(f"SELECT {quality.kolmogorov_text(f'{d!r}D', str(n), str(n))} AS p").first().p == pytest.approx(p, abs=2e-4)


def test_autocorrelations_by_blocks(spark, rows):
    want = {r.k: r for r in stats.acf(rows, ["k"], 20).collect()}
    for r in stats.acf_blocked(rows, ["k"], 20, block=32).collect():
        assert r.n == want[r.k].n and r.acf == pytest.approx(want[r.k].acf, abs=1e-12)


def test_a_flat_series_does_not_stop_the_battery(spark):
    """A correlation without spread divided by zero."""
    from tidebook.operators import battery, stats
    from tidebook.sources import tables

    rows = [("flat", i, 0.1) for i in range(1, 61)] + [("noise", i, ((i * 7919) % 101) / 101) for i in range(1, 61)]
    got = {(r.sid, r.test): r for r in battery.battery(spark.createDataFrame(rows, "sid string, i int, value double"), ["sid"], tables.stored).collect()}
    assert got["flat", "moments"].skewness is None and ("flat", "white") not in got and ("flat", "adf") not in got
    assert got["noise", "white"].statistic == pytest.approx(stats.white(spark.createDataFrame(rows[60:], "sid string, i int, value double"), ["sid"]).first().statistic, rel=1e-7)
