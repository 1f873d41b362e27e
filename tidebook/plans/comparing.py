"""Queries that compare samples, code sequences and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import frames
from tidebook.operators import quality as q
from tidebook.operators import stats
from tidebook.plans import fixtures as fx
from tidebook.plans.registry import query
from tidebook.plans.statistics import acf_ctes
from tidebook.sources import tables

VOCAB, LENGTH = 16, 120
RBF_ROWS = 5000
D = 64


def codes(spark, sf):
    """event_id, symbol, sample (0 original, 1 other), seq, pos, code: 16 codes from the values, sequences of 120."""
    x = frames.ranked(fx.events(spark, sf), ["symbol"], ["us", "event_id"], F.col("hour"), "k").withColumn("code", F.expr(f"cast(pmod(floor(value * 100), {VOCAB}) as int)"))
    return x.select("event_id", "symbol", "us", "value", F.expr(f"cast(k div {LENGTH} as int)").alias("seq"), F.expr(f"cast(k % {LENGTH} as int)").alias("pos"), F.expr(f"cast(k div {LENGTH} % 2 as int)").alias("sample"), "code")


C = f"""{fx.ctes("ev")}, ck AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1 AS k FROM ev),
codes AS (SELECT event_id, symbol, us, value, (k // {LENGTH})::INT AS seq, (k % {LENGTH})::INT AS pos, (k // {LENGTH} % 2)::INT AS sample, (floor(value * 100)::BIGINT % {VOCAB})::INT AS code FROM ck)"""


def vectors(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return fx.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 2).cast("int").alias("sample"), v.alias("v"))


V = "WITH vec AS (SELECT vec_id, (vec_id % 2)::INT AS sample, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), vx AS (SELECT vec_id, sample, unnest(range(0, len(v)))::INT AS i, unnest(v) AS value FROM vec)"
VN = V.replace("list_transform(embedding, lambda x: x::DOUBLE)", "list_transform(embedding, lambda x: abs(x)::DOUBLE / list_sum(list_transform(embedding, lambda y: abs(y)::DOUBLE)))")


def simplex(spark, sf):
    a = F.transform("v", F.abs)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf).withColumn("v", F.transform(a, lambda x: x / total))


def exploded(df):
    return df.select("vec_id", "sample", F.posexplode("v").alias("i", "value"))


def steps_sql(source: str, by: str) -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""cn AS (SELECT {b}value, sum((sample = 0)::INT) AS a, sum((sample = 1)::INT) AS b FROM {source} GROUP BY {b}value),
st AS (SELECT *, sum(a) OVER ({part}ORDER BY value) / sum(a) OVER ({part}) AS f, sum(b) OVER ({part}ORDER BY value) / sum(b) OVER ({part}) AS g, sum(a) OVER ({part})::BIGINT AS na, sum(b) OVER ({part})::BIGINT AS nb, lead(value) OVER ({part}ORDER BY value) - value AS gap FROM cn)"""


@query("ks_two_sample", f"{V}, {steps_sql('vx', 'i')}, ks AS (SELECT i, max(abs(f - g)) AS d, max(na) AS na, max(nb) AS nb FROM st GROUP BY i) SELECT i, na, nb, round(d, 9) AS d, round({q.kolmogorov_text()}, 6) AS p_value FROM ks")
def ks_two_sample(spark, sf):
    return q.ks_two_sample(exploded(vectors(spark, sf)), ["i"]).select("i", "na", "nb", F.round("d", 9).alias("d"), F.round("p_value", 6).alias("p_value"))


@query(
    "ks_summary",
    f"""{V}, {steps_sql('vx', 'i')}, ks AS (SELECT i, max(abs(f - g)) AS d, max(na) AS na, max(nb) AS nb FROM st GROUP BY i), kp AS (SELECT i, d, {q.kolmogorov_text()} AS p FROM ks)
SELECT round(avg(d), 7) AS mean_d, round(max(d), 7) AS max_d, round(avg(p), 5) AS mean_p, round(min(p), 6) AS min_p, avg((p < 0.05)::INT) AS rejection_rate, coalesce(list_sort(list(i) FILTER (WHERE p < 0.05)), []) AS rejected FROM kp""",
)
def ks_summary(spark, sf):
    """Over all dimensions: mean and largest D, mean and least p, the share and the numbers of the dimensions that differ."""
    low = F.col("p_value") < 0.05
    x = q.ks_two_sample(exploded(vectors(spark, sf)), ["i"])
    r = lambda e, d: F.round(e, d)
    return x.agg(r(F.avg("d"), 7).alias("mean_d"), r(F.max("d"), 7).alias("max_d"), r(F.avg("p_value"), 5).alias("mean_p"), r(F.min("p_value"), 6).alias("min_p"), F.avg(low.cast("int")).alias("rejection_rate"), F.array_sort(F.collect_list(F.when(low, F.col("i")))).alias("rejected"))


@query("wasserstein_1d", f"{C}, {steps_sql('codes', 'symbol')} SELECT symbol, round(sum(abs(f - g) * coalesce(gap, 0)), 7) AS w1 FROM st GROUP BY symbol")
def wasserstein_1d(spark, sf):
    return q.wasserstein(codes(spark, sf), ["symbol"]).select("symbol", F.round("w1", 7).alias("w1"))


@query(
    "wasserstein_binned",
    f"""{VN}, cu AS (SELECT i, sample, avg(value) AS m FROM vx GROUP BY ALL), pq AS (SELECT i, sum(CASE WHEN sample = 0 THEN m END) OVER (ORDER BY i) AS f, sum(CASE WHEN sample = 1 THEN m END) OVER (ORDER BY i) AS g FROM (SELECT * FROM cu)), ab AS (SELECT i, max(f) AS f, max(g) AS g FROM pq GROUP BY i)
SELECT round(sum(abs(f - g)) / {D - 1}, 8) AS w FROM ab""",
)
def wasserstein_binned(spark, sf):
    """Mean vectors of the two samples as densities over the bins: distance of their running sums."""
    m = exploded(simplex(spark, sf)).groupBy("i").agg(*[F.avg(F.when(F.col("sample") == k, F.col("value"))).alias(f"m{k}") for k in (0, 1)])
    x = m.agg(F.array_sort(F.collect_list(F.struct("i", "m0", "m1"))).alias("a"))  # one row per bin
    d = F.aggregate("a", F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda s, y: F.struct((s["c"] + y["m0"] - y["m1"]).alias("c"), (s["s"] + F.abs(s["c"] + y["m0"] - y["m1"])).alias("s")))
    return x.select(F.round(d["s"] / (D - 1), 8).alias("w"))


FREQ = f"{C}, cf AS (SELECT s.sample, r.code::INT AS code, count(c.event_id) AS n FROM (SELECT DISTINCT sample FROM codes) s CROSS JOIN range({VOCAB}) r(code) LEFT JOIN codes c ON c.sample = s.sample AND c.code = r.code GROUP BY ALL), fr AS (SELECT sample, code, n, n / sum(n) OVER (PARTITION BY sample) AS freq FROM cf)"
WIDE = f"{FREQ}, wd AS (SELECT code, max(CASE WHEN sample = 0 THEN freq END) + 1e-10 AS p, max(CASE WHEN sample = 1 THEN freq END) + 1e-10 AS q FROM fr GROUP BY code), nm AS (SELECT code, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM wd)"


def _freq(spark, sf):
    return q.frequencies(codes(spark, sf), ["sample"], "code", VOCAB)


def _wide(spark, sf):
    x = _freq(spark, sf).groupBy("code").agg(*[F.max(F.when(F.col("sample") == k, F.col("freq"))).alias(n) for k, n in ((0, "p"), (1, "q"))])
    return x


@query("code_frequency", f"{FREQ} SELECT sample, code, n, round(freq, 9) AS freq FROM fr")
def code_frequency(spark, sf):
    return _freq(spark, sf).select("sample", "code", "n", F.round("freq", 9).alias("freq"))


@query("code_usage_perplexity", f"{FREQ} SELECT sample, sum((n > 0)::INT) / {VOCAB} AS usage, round(exp(-sum(freq * ln(freq + 1e-10))), 6) AS perplexity FROM fr GROUP BY sample")
def code_usage_perplexity(spark, sf):
    return _freq(spark, sf).groupBy("sample").agg((F.count_if(F.col("n") > 0) / VOCAB).alias("usage"), F.round(F.exp(-F.sum(F.col("freq") * F.ln(F.col("freq") + 1e-10))), 6).alias("perplexity"))


@query("js_divergence", f"{WIDE} SELECT round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 9) AS js FROM nm")
def js_divergence(spark, sf):
    return q.smoothed(_wide(spark, sf), [], ["p", "q"]).agg(F.round(q.js_divergence(), 9).alias("js"))


@query("freq_compare", f"{WIDE} SELECT round(corr(p, q), 6) AS corr, round(max(abs(p - q)), 9) AS max_diff FROM nm")
def freq_compare(spark, sf):
    return q.smoothed(_wide(spark, sf), [], ["p", "q"]).agg(F.round(F.corr("p", "q"), 6).alias("corr"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 9).alias("max_diff"))


TRANS = f'{C}, nx AS (SELECT *, lead(code) OVER (PARTITION BY sample, symbol, seq ORDER BY pos) AS nxt FROM codes), tc AS (SELECT sample, code AS "from", nxt AS "to", count(*) AS n FROM nx WHERE nxt IS NOT NULL GROUP BY ALL), tm AS (SELECT *, n / sum(n) OVER (PARTITION BY sample, "from") AS p FROM tc)'


def _trans(spark, sf):
    return q.transitions(codes(spark, sf), ["sample"], ["symbol", "seq"], "pos")


@query("transition_matrix", f'{TRANS} SELECT sample, "from", "to", n, round(p, 9) AS p FROM tm')
def transition_matrix(spark, sf):
    return _trans(spark, sf).select("sample", "from", "to", "n", F.round("p", 9).alias("p"))


@query("transition_compare", f'{TRANS}, jn AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM tm WHERE sample = 0) a FULL JOIN (SELECT * FROM tm WHERE sample = 1) b ON a."from" = b."from" AND a."to" = b."to") SELECT round(sqrt(sum((p - q) * (p - q))), 7) AS frobenius, round(sum(abs(p - q)) / {VOCAB * VOCAB}, 9) AS mean_abs, round(sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 7) AS frobenius_corr FROM jn')
def transition_compare(spark, sf):
    t = _trans(spark, sf)
    a, b = (t.where(F.col("sample") == k).select("from", "to", F.col("p").alias(n)) for k, n in ((0, "p"), (1, "q")))
    x = a.join(b, ["from", "to"], "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    d = F.col("p") - F.col("q")
    return x.agg(F.round(F.sqrt(F.sum(d * d)), 7).alias("frobenius"), F.round(F.sum(F.abs(d)) / VOCAB**2, 9).alias("mean_abs"), F.round(F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q"))), 7).alias("frobenius_corr"))


NG = f"{C}, gl AS (SELECT *, lead(code, 1) OVER w AS c1, lead(code, 2) OVER w AS c2 FROM codes WINDOW w AS (PARTITION BY sample, symbol, seq ORDER BY pos)), ng AS (SELECT sample, code || '-' || c1 || '-' || c2 AS gram, count(*) AS n FROM gl WHERE c2 IS NOT NULL GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, gram) AS rank FROM ng)"


def _ngrams(spark, sf):
    return q.ngrams(codes(spark, sf), ["sample"], ["symbol", "seq"], "pos", 3)


def _top(spark, sf, k=20):
    return _ngrams(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= k)


@query("ngrams", f"{NG} SELECT * FROM ng")
def ngrams(spark, sf):
    return _ngrams(spark, sf)


@query("topk_ngrams", f"{NG} SELECT sample, gram, n, rank FROM tk WHERE rank <= 20")
def topk_ngrams(spark, sf):
    return _top(spark, sf)


@query("set_overlap", f"{NG} SELECT count(*) AS common FROM (SELECT gram FROM tk WHERE rank <= 20 AND sample = 0 INTERSECT SELECT gram FROM tk WHERE rank <= 20 AND sample = 1)")
def set_overlap(spark, sf):
    t = _top(spark, sf)
    return t.where("sample = 0").select("gram").intersect(t.where("sample = 1").select("gram")).agg(F.count("*").alias("common"))


@query(
    "ngram_compare",
    f"""{NG}, fq AS (SELECT sample, gram, n / sum(n) OVER (PARTITION BY sample) AS f FROM ng), al AS (SELECT count(*) AS common, round(CASE WHEN isfinite(corr(a.f, b.f)) THEN corr(a.f, b.f) END, 6) AS corr FROM (SELECT * FROM fq WHERE sample = 0) a JOIN (SELECT * FROM fq WHERE sample = 1) b USING (gram)),
tp AS (SELECT count(*) AS top_common, count(*) / 20 AS overlap, coalesce(round(CASE WHEN isfinite(corr(a.n, b.n)) THEN corr(a.n, b.n) END, 6), 0) AS top_corr FROM (SELECT gram, n::DOUBLE AS n FROM tk WHERE rank <= 20 AND sample = 0) a JOIN (SELECT gram, n::DOUBLE AS n FROM tk WHERE rank <= 20 AND sample = 1) b USING (gram))
SELECT common, corr, top_common, overlap, top_corr FROM al, tp""",
)
def ngram_compare(spark, sf):
    """All grams: how many both samples have and how their shares go together. The same of the twenty most frequent of either, beside it."""
    n = tables.stored(_ngrams(spark, sf), "ngrams")
    top = q.compare_top(n, 20).select(F.col("common").alias("top_common"), "overlap", F.round("corr", 6).alias("top_corr"))
    return q.compare_all(n).withColumn("corr", F.round("corr", 6)).crossJoin(F.broadcast(top))  # one row each


HIST = f"""{C}, bd AS (SELECT min(value) AS lo, max(value) AS hi FROM codes), hb AS (SELECT sample, least(floor((value - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM codes, bd GROUP BY ALL),
hw AS (SELECT bin, coalesce(sum(CASE WHEN sample = 0 THEN n END), 0) + 1e-10 AS p, coalesce(sum(CASE WHEN sample = 1 THEN n END), 0) + 1e-10 AS q FROM hb GROUP BY bin), hn AS (SELECT bin, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM hw), {steps_sql("codes", "")}"""


_SIDES = [(f, k) for k in (0, 1) for f in ("avg", "stddev_pop", "min", "max")]
_NAMES = {"avg": "mean", "stddev_pop": "std", "min": "min", "max": "max"}


@query(
    "target_compare",
    f"""{HIST}, mo AS (SELECT {", ".join(f"{f}(CASE WHEN sample = {k} THEN value END) AS {_NAMES[f]}_{k}" for f, k in _SIDES)} FROM codes),
kd AS (SELECT max(abs(f - g)) AS d, max(na) AS na, max(nb) AS nb, sum(abs(f - g) * coalesce(gap, 0)) AS w1 FROM st)
SELECT {", ".join(f"round({_NAMES[f]}_{k}, 7) AS {_NAMES[f]}_{k}" for f, k in _SIDES)}, round(abs(mean_0 - mean_1), 7) AS mean_diff, round(std_1 / (std_0 + 1e-10), 7) AS std_ratio, round(d, 9) AS ks, round({q.kolmogorov_text()}, 6) AS ks_p, round(w1, 7) AS w1,
 (SELECT round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 8) FROM hn) AS js FROM mo, kd""",
)
def target_compare(spark, sf):
    """Either side's moments and range, KS with its p-value, Wasserstein and JS over 50 common bins."""
    x = codes(spark, sf).select("sample", "value")
    side = {"avg": F.avg, "stddev_pop": F.stddev_pop, "min": F.min, "max": F.max}
    m = x.agg(*[side[f](F.when(F.col("sample") == k, F.col("value"))).alias(f"{_NAMES[f]}_{k}") for f, k in _SIDES], F.min("value").alias("lo"), F.max("value").alias("hi"))
    bins = x.crossJoin(F.broadcast(m.select("lo", "hi"))).withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)), F.lit(49)).cast("int"))
    h = bins.groupBy("bin").agg(*[F.count_if(F.col("sample") == k).cast("double").alias(n) for k, n in ((0, "p"), (1, "q"))])
    js = q.smoothed(h, [], ["p", "q"]).agg(F.round(q.js_divergence(), 8).alias("js"))
    gap = F.abs(F.col("f") - F.col("g"))
    steps = q.cdf_steps(x, []).agg(F.max(gap).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum(gap * F.coalesce("gap", F.lit(0.0))).alias("w1"))
    steps = steps.select(F.round("d", 9).alias("ks"), F.round(F.expr(q.kolmogorov_text()), 6).alias("ks_p"), F.round("w1", 7).alias("w1"))
    one = m.crossJoin(js).crossJoin(steps)  # one row each
    return one.select(*[F.round(f"{_NAMES[f]}_{k}", 7).alias(f"{_NAMES[f]}_{k}") for f, k in _SIDES], F.round(F.abs(F.col("mean_0") - F.col("mean_1")), 7).alias("mean_diff"), F.round(F.col("std_1") / (F.col("std_0") + 1e-10), 7).alias("std_ratio"), "ks", "ks_p", "w1", "js")


@query("marginal_hist", f"{V}, mb AS (SELECT i, min(value) AS lo, max(value) AS hi FROM vx WHERE i % 8 = 0 GROUP BY i) SELECT i, sample, least(floor((value - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM vx JOIN mb USING (i) GROUP BY ALL")
def marginal_hist(spark, sf):
    """50-bin histograms of every eighth dimension, both samples."""
    x = exploded(vectors(spark, sf)).where("i % 8 = 0")
    x = x.join(x.groupBy("i").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "i")
    return x.groupBy("i", "sample", F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# dependence

_pair = f"""{C}, av AS (SELECT symbol AS symbol, sample AS feature, 0 AS win, row_number() OVER (PARTITION BY symbol, sample ORDER BY us, event_id) AS i, VALUE_EXPR AS value FROM codes)"""


def _series(spark, sf, absolute):
    v = F.abs(F.col("value") - 50) if absolute else F.col("value")
    x = frames.ranked(codes(spark, sf), ["symbol", "sample"], ["us", "event_id"], F.floor(F.col("us") / frames.HOUR_US), "i")
    return x.select("symbol", "sample", (F.col("i") + 1).alias("i"), v.alias("value"))


def _acf_compare(absolute: bool):
    def run(spark, sf):
        # lag 0 is one of the 21 that the error is a mean of; it is the same in both
        x = stats.acf_blocked(_series(spark, sf, absolute), ["symbol", "sample"], 20).select("symbol", "sample", F.posexplode("acf").alias("k", "r"))
        a, b = (x.where(F.col("sample") == s).select("symbol", "k", F.col("r").alias(n)) for s, n in ((0, "ra"), (1, "rb")))
        return a.join(b, ["symbol", "k"]).groupBy("symbol").agg(F.round(F.sum(F.abs(F.col("ra") - F.col("rb"))) / 21, 7).alias("mae"), F.round(F.corr("ra", "rb"), 5).alias("corr"))

    value = "abs(value - 50)" if absolute else "value"
    sql = f"""{_pair.replace("VALUE_EXPR", value)}, {acf_ctes(20, "value", "av")}, ex AS (SELECT symbol, feature, k, r[k] AS r FROM (SELECT symbol, feature, [{", ".join(f"r{k}" for k in range(1, 21))}] AS r FROM ac), range(1, 21) t(k))
SELECT symbol, round(sum(abs(a.r - b.r)) / 21, 7) AS mae, round(corr(a.r, b.r), 5) AS corr FROM (SELECT * FROM ex WHERE feature = 0) a JOIN (SELECT * FROM ex WHERE feature = 1) b USING (symbol, k) GROUP BY symbol"""
    query("vol_clustering" if absolute else "acf_compare", sql)(run)


_acf_compare(False)
_acf_compare(True)


# vectors


@query("vector_profile", f"{V} SELECT sample, min(value) AS min, max(value) AS max, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std FROM vx GROUP BY sample")
def vector_profile(spark, sf):
    return exploded(vectors(spark, sf)).groupBy("sample").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 7).alias("mean"), F.round(F.stddev_pop("value"), 7).alias("std"))


PAIRS = f"{V}, pr AS (SELECT a.vec_id // 2 AS id, a.v AS v, b.v AS u FROM vec a JOIN vec b ON a.vec_id // 2 = b.vec_id // 2 AND a.sample = 0 AND b.sample = 1), px AS (SELECT id, unnest(range(0, len(v)))::INT AS i, unnest(v) AS v, unnest(u) AS u FROM pr)"


def paired(spark, sf):
    x = vectors(spark, sf).withColumn("id", F.expr("vec_id div 2"))
    return x.where("sample = 0").select("id", "v").join(x.where("sample = 1").select("id", F.col("v").alias("u")), "id")


@query("recon_error", f"{PAIRS} SELECT i, round(avg((v - u) * (v - u)), 7) AS mse, round(avg(abs(v - u)), 7) AS mae FROM px GROUP BY i")
def recon_error(spark, sf):
    x = paired(spark, sf).select(F.posexplode(F.zip_with("v", "u", lambda a, b: a - b)).alias("i", "d"))
    return x.groupBy("i").agg(F.round(F.avg(F.col("d") * F.col("d")), 7).alias("mse"), F.round(F.avg(F.abs("d")), 7).alias("mae"))


@query(
    "recon_summary",
    f"{PAIRS}, pd AS (SELECT i, avg((v - u) * (v - u)) AS m, avg(abs(v - u)) AS a, count(*) AS n FROM px GROUP BY i) SELECT count(*) AS n_features, max(n) AS n, round(sum(m * n) / sum(n), 7) AS mse, round(sum(a * n) / sum(n), 7) AS mae, round(avg(m), 7) AS mean_feature_mse, round(stddev_pop(m), 7) AS std_feature_mse, round(max(m), 7) AS max_feature_mse FROM pd",
)
def recon_summary(spark, sf):
    """Over all vectors and features: MSE and MAE, and how the features' own MSE spread."""
    x = paired(spark, sf).select(F.posexplode(F.zip_with("v", "u", lambda a, b: a - b)).alias("i", "d"))
    x = x.groupBy("i").agg(F.avg(F.col("d") * F.col("d")).alias("m"), F.avg(F.abs("d")).alias("a"), F.count("*").alias("n"))
    whole = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 7)
    return x.agg(F.count("*").alias("n_features"), F.max("n").alias("n"), whole("m").alias("mse"), whole("a").alias("mae"), F.round(F.avg("m"), 7).alias("mean_feature_mse"), F.round(F.stddev_pop("m"), 7).alias("std_feature_mse"), F.round(F.max("m"), 7).alias("max_feature_mse"))


@query("topk_worst_features", f"{PAIRS} SELECT i, round(avg((v - u) * (v - u)), 7) AS mse FROM px GROUP BY i ORDER BY mse DESC, i LIMIT 10")
def topk_worst_features(spark, sf):
    return recon_error(spark, sf).select("i", "mse").orderBy(F.desc("mse"), "i").limit(10)


COS = f"{PAIRS}, cs AS (SELECT id, sum(v * u) / (sqrt(sum(v * v)) * sqrt(sum(u * u))) AS c FROM px GROUP BY id)"


@query("cosine_rows", f"{COS} SELECT count(*) AS n, round(avg(c), 7) AS mean, round(stddev_pop(c), 7) AS std, round(min(c), 7) AS min, round(max(c), 7) AS max, round(median(c), 7) AS median FROM cs")
def cosine_rows(spark, sf):
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = paired(spark, sf).select((dot("v", "u") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("u", "u")))).alias("c"))
    r = lambda f: F.round(f("c"), 7)
    return x.agg(F.count("*").alias("n"), r(F.avg).alias("mean"), r(F.stddev_pop).alias("std"), r(F.min).alias("min"), r(F.max).alias("max"), r(F.median).alias("median"))


@query(
    "mmd",
    f"""{V}, sm AS (SELECT i, sum(CASE WHEN sample = 0 THEN value END) AS s0, sum(CASE WHEN sample = 1 THEN value END) AS s1, sum(CASE WHEN sample = 0 THEN value * value END) AS q0, sum(CASE WHEN sample = 1 THEN value * value END) AS q1, sum((sample = 0)::INT)::DOUBLE AS n0, sum((sample = 1)::INT)::DOUBLE AS n1 FROM vx GROUP BY i),
ln AS (SELECT (sum(s0 * s0) - sum(q0)) / (max(n0) * (max(n0) - 1)) + (sum(s1 * s1) - sum(q1)) / (max(n1) * (max(n1) - 1)) - 2 * sum(s0 * s1) / (max(n0) * max(n1)) AS m FROM sm),
hs AS (SELECT vec_id, sample, v FROM vec WHERE ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT < (SELECT {RBF_ROWS}::DOUBLE / count(*) FROM vec) * 4294967296),
kk AS (SELECT a.sample AS s, b.sample AS t, exp(-list_sum(list_transform(range(1, {D} + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) / {D}) AS k FROM hs a JOIN hs b ON a.vec_id <> b.vec_id)
SELECT kernel, round(m, 7) AS mmd2, round(sqrt(greatest(m, 0)), 5) AS mmd FROM (SELECT 'linear' AS kernel, m FROM ln UNION ALL SELECT 'rbf', avg(CASE WHEN s = 0 AND t = 0 THEN k END) + avg(CASE WHEN s = 1 AND t = 1 THEN k END) - 2 * avg(CASE WHEN s <> t THEN k END) FROM kk)""",
)
def mmd(spark, sf):
    """Linear over all vectors; Gaussian over about RBF_ROWS of them by digest (its definition has that bound), or all if there are fewer."""
    x = vectors(spark, sf)
    some = x.where(F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long") < RBF_ROWS / max(1, x.count()) * 2.0**32)
    both = q.mmd_linear(x).select(F.lit("linear").alias("kernel"), "mmd2").unionByName(q.mmd_rbf(some, "vec_id", 1.0 / D, 8).select(F.lit("rbf").alias("kernel"), "mmd2"))
    return both.select("kernel", F.round("mmd2", 7).alias("mmd2"), F.round(F.sqrt(F.greatest("mmd2", F.lit(0.0))), 5).alias("mmd"))


@query(
    "corr_distance",
    f"""{VN}, lg AS (SELECT vec_id, sample, i, ln(value + 1e-10) AS l FROM vx), cl AS (SELECT vec_id, sample, i, l - avg(l) OVER (PARTITION BY vec_id) AS c FROM lg),
cr AS (SELECT a.i, b.i AS j, coalesce(corr(CASE WHEN a.sample = 0 THEN a.c END, CASE WHEN b.sample = 0 THEN b.c END), 0) AS r0, coalesce(corr(CASE WHEN a.sample = 1 THEN a.c END, CASE WHEN b.sample = 1 THEN b.c END), 0) AS r1 FROM cl a JOIN cl b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)
SELECT round(sqrt(2 * sum((r0 - r1) * (r0 - r1))), 6) AS frobenius, round((2 * sum(r0 * r1) + {D}) / (sqrt(2 * sum(r0 * r0) + {D}) * sqrt(2 * sum(r1 * r1) + {D})), 7) AS frobenius_corr, round(2 * sum(abs(r0 - r1)) / {D * D}, 7) AS mean_abs, round(max(abs(r0 - r1)), 7) AS max_abs FROM cr""",
)
def corr_distance(spark, sf):
    """Correlation matrices of the log-ratio transformed vectors, sample against sample."""
    from tidebook.operators.book import clr

    x = q.correlation_distance(q.correlations(simplex(spark, sf).withColumn("v", clr("v")), ["sample"], D))
    return x.select(*[F.round(c, 6 if c == "frobenius" else 7).alias(c) for c in x.columns])


BOOKK = f"{V}, cb AS (SELECT label AS code, list_transform(range(1, {D} + 1), lambda i: avg_v[i]) AS e FROM (SELECT label, [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, D + 1))}] AS avg_v FROM embeddings GROUP BY label)), ds AS (SELECT vec_id, code, round(list_sum(list_transform(range(1, {D} + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i]))), 9) AS d FROM vec, cb), bs AS (SELECT vec_id, arg_min(code, (d, code)) AS code, min(d) AS distance FROM ds GROUP BY vec_id)"


def codebook(spark, sf):
    """Mean vector of each label, as codewords."""
    x = fx.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy(F.col("label").alias("code")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("e"))


@query("vq_assign", f"{BOOKK} SELECT vec_id, code, round(distance, 4) AS distance FROM bs")
def vq_assign(spark, sf):
    return q.assign_codes(vectors(spark, sf), codebook(spark, sf)).select("vec_id", "code", F.round("distance", 4).alias("distance"))


@query("vq_reconstruct", f"{BOOKK} SELECT bs.code, count(*) AS n, round(avg(distance), 6) AS mean_error FROM bs GROUP BY bs.code")
def vq_reconstruct(spark, sf):
    """Codes back to their codewords; error of the round trip per code."""
    book = codebook(spark, sf)
    x = q.assign_codes(vectors(spark, sf), book).join(F.broadcast(book), "code")
    err = F.aggregate(F.zip_with("v", "e", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    return x.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg(err), 6).alias("mean_error"))


N_BOOKS = 4


def split_vectors(spark, sf):
    """Vectors of each split's training rows: all but those whose turn of validation it is."""
    x = vectors(spark, sf).withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(N_BOOKS - 1))))
    return x.where(F.col("vec_id") % N_BOOKS != F.col("split_id"))


@query("vq_fit")
def vq_fit(spark, sf):
    """A k-means codebook for each split, with each codeword's use and mean squared error."""
    x = split_vectors(spark, sf)
    book = q.fit_codes_by(x, ["split_id"], 8, tables.stored)
    return q.nearest(x, book, ["split_id"]).groupBy("split_id", "code").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_error"))


@query("latent_attach", f"{C} SELECT event_id, code, value FROM codes")
def latent_attach(spark, sf):
    """Codes are a column of the row they come from: nothing to zip."""
    return codes(spark, sf).select("event_id", "code", "value")


@query("params_attach", f"{fx.ctes('split_long')}, ps AS (SELECT split_id, feature, avg(value) AS m FROM split_long WHERE role = 'train' GROUP BY ALL) SELECT split_id, feature, round(sum(value - m), 3) AS s FROM split_long JOIN ps USING (split_id, feature) WHERE role = 'validation' GROUP BY ALL")
def params_attach(spark, sf):
    x = fx.split_long(spark, sf)
    p = x.where("role = 'train'").groupBy("split_id", "feature").agg(F.avg("value").alias("m"))
    return x.where("role = 'validation'").join(p, ["split_id", "feature"]).groupBy("split_id", "feature").agg(F.round(F.sum(F.col("value") - F.col("m")), 3).alias("s"))


REPORT = f"""{C}, sp AS (SELECT *, (us // 86400000000 % {fx.SPLITS})::INT AS split_id FROM codes), cnt AS (SELECT split_id, sample, code, count(*) AS n FROM sp GROUP BY ALL), tot AS (SELECT split_id, sample, sum(n) AS t FROM cnt GROUP BY ALL),
wd AS (SELECT a.split_id, k, coalesce(x.n / a.t, 0) + 1e-10 AS p, coalesce(y.n / b.t, 0) + 1e-10 AS q FROM tot a JOIN tot b ON a.split_id = b.split_id AND a.sample = 0 AND b.sample = 1 CROSS JOIN range({VOCAB}) r(k)
 LEFT JOIN cnt x ON x.split_id = a.split_id AND x.sample = 0 AND x.code = k LEFT JOIN cnt y ON y.split_id = a.split_id AND y.sample = 1 AND y.code = k),
nm AS (SELECT split_id, p / sum(p) OVER (PARTITION BY split_id) AS p, q / sum(q) OVER (PARTITION BY split_id) AS q FROM wd), {steps_sql("sp", "split_id")},
bk AS (SELECT split_id, code, avg(value) AS e FROM sp WHERE sample = 0 GROUP BY ALL), re AS (SELECT split_id, value - e AS d FROM sp JOIN bk USING (split_id, code) WHERE sample = 1)
SELECT split_id, 'codes' AS experiment, 'js' AS metric, round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 7) AS value FROM nm GROUP BY split_id
UNION ALL SELECT split_id, 'codes', 'freq_corr', round(corr(p, q), 6) FROM nm GROUP BY split_id
UNION ALL SELECT split_id, 'end_to_end', 'ks', round(max(abs(f - g)), 7) FROM st GROUP BY split_id
UNION ALL SELECT split_id, 'end_to_end', 'w1', round(sum(abs(f - g) * coalesce(gap, 0)), 6) FROM st GROUP BY split_id
UNION ALL SELECT split_id, 'reconstruction', 'mse', round(avg(d * d), 6) FROM re GROUP BY split_id
UNION ALL SELECT split_id, 'reconstruction', 'max_error', round(max(abs(d)), 7) FROM re GROUP BY split_id"""


@query("quality_report", REPORT)
def quality_report(spark, sf):
    """Metrics of the three comparisons per split, as a long table: codes, values end to end, and values rebuilt from the other sample's mean of their code."""
    x = codes(spark, sf).withColumn("split_id", F.expr(f"cast(us div 86400000000 % {fx.SPLITS} as int)"))
    by = ["split_id"]
    f = q.frequencies(x, [*by, "sample"], "code", VOCAB)
    f = f.groupBy(*by, "code").agg(*[F.max(F.when(F.col("sample") == k, F.col("freq"))).alias(n) for k, n in ((0, "p"), (1, "q"))])
    c = q.smoothed(f.fillna(0.0, ["p", "q"]), by, ["p", "q"]).groupBy(*by).agg(F.round(q.js_divergence(), 7).alias("js"), F.round(F.corr("p", "q"), 6).alias("freq_corr"))
    gap = F.abs(F.col("f") - F.col("g"))
    e = q.cdf_steps(x.select(*by, "sample", "value"), by).groupBy(*by).agg(F.round(F.max(gap), 7).alias("ks"), F.round(F.sum(gap * F.coalesce("gap", F.lit(0.0))), 6).alias("w1"))
    book = x.where("sample = 0").groupBy(*by, "code").agg(F.avg("value").alias("e"))
    d = F.col("value") - F.col("e")
    r = x.where("sample = 1").join(F.broadcast(book), [*by, "code"]).groupBy(*by).agg(F.round(F.avg(d * d), 6).alias("mse"), F.round(F.max(F.abs(d)), 7).alias("max_error"))
    rows = lambda t, name, a, b: t.select(*by, F.lit(name).alias("experiment"), F.expr(f"stack(2, '{a}', {a}, '{b}', {b}) AS (metric, value)"))
    return rows(c, "codes", "js", "freq_corr").unionByName(rows(e, "end_to_end", "ks", "w1")).unionByName(rows(r, "reconstruction", "mse", "max_error"))
