"""Queries of the book array operators, returns and volatility, and the flagship."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import book as b
from tidebook.operators import frames
from tidebook.plans import fixtures as fx
from tidebook.plans.registry import query

W = fx.ctes("book")
BANDS = (3, 5, 50)


@query("mid_price", f"{W} SELECT event_id, (list_max(list_transform(bids, lambda x: x[1])) + list_min(list_transform(asks, lambda x: x[1]))) / 2 AS mid_price FROM book")
def mid_price(spark, sf):
    return fx.book(spark, sf).select("event_id", b.mid_price().alias("mid_price"))


@query("spread", f"{W} SELECT event_id, list_min(list_transform(asks, lambda x: x[1])) - list_max(list_transform(bids, lambda x: x[1])) AS spread FROM book")
def spread(spark, sf):
    return fx.book(spark, sf).select("event_id", b.spread().alias("spread"))


@query(
    "microprice",
    f"""{W}, t AS (SELECT *, list_max(list_transform(bids, lambda x: x[1])) AS pb, list_min(list_transform(asks, lambda x: x[1])) AS pa FROM book),
v AS (SELECT *, list_sum(list_transform(list_filter(bids, lambda x: x[1] = pb), lambda x: x[2])) AS vb, list_sum(list_transform(list_filter(asks, lambda x: x[1] = pa), lambda x: x[2])) AS va FROM t)
SELECT event_id, CASE WHEN vb + va > 0 THEN (pa * vb + pb * va) / (vb + va) ELSE (pb + pa) / 2 END AS microprice FROM v""",
)
def microprice(spark, sf):
    return fx.book(spark, sf).select("event_id", b.microprice().alias("microprice"))


@query(
    "book_sort",
    f"""{W}, s AS (SELECT event_id, 'bid' AS side, list_reverse_sort(bids) AS l FROM book UNION ALL SELECT event_id, 'ask', list_sort(asks) FROM book)
SELECT event_id, side, level::INT AS level, l[level][1] AS price, l[level][2] AS volume FROM s, range(1, {fx.LEVELS + 1}) t(level)""",
)
def book_sort(spark, sf):
    shuffled = fx.book(spark, sf).withColumn("bids", F.reverse("bids")).withColumn("asks", F.reverse("asks"))
    x = b.sorted_book(shuffled, by_volume=True).select("event_id", F.explode(F.map_from_arrays(F.array(F.lit("bid"), F.lit("ask")), F.array("bids", "asks"))).alias("side", "l"))
    x = x.select("event_id", "side", F.posexplode("l").alias("pos", "x"))
    return x.select("event_id", "side", (F.col("pos") + 1).alias("level"), F.col("x")[0].alias("price"), F.col("x")[1].alias("volume"))


def _bands_sql(columns: str) -> str:
    parts = []
    for k in BANDS:
        n, name = min(k, fx.LEVELS), b.name_of(k)
        vb, va = (f"list_sum(list_transform(list_slice({s}, 1, {n}), lambda x: x[2]))" for s in ("bids", "asks"))
        whole = "(list_sum(list_transform(bids, lambda x: x[2])) + list_sum(list_transform(asks, lambda x: x[2])))"
        w = f"list_transform(range(1, {n + 1}), lambda i: asks[i][2] + bids[i][2])"
        g = f"list_transform(range(1, {n + 1}), lambda i: (asks[i][1] - bids[i][1]) * (asks[i][2] + bids[i][2]))"
        parts.append(
            {
                "depth_imbalance": f"CASE WHEN {vb} + {va} = 0 THEN 0.0 ELSE ({vb} - {va}) / ({vb} + {va}) END AS depth_imbalance_{name}",
                "depth": f"{vb} + {va} AS depth_{name}",
                "liquidity_concentration": f"CASE WHEN {whole} > 0 THEN ({vb} + {va}) / {whole} ELSE 0.0 END AS liquidity_concentration_{name}",
                "price_impact_proxy": f"round((asks[{n}][1] - bids[{n}][1]) / ({vb} + {va} + 1e-12), 9) AS price_impact_proxy_{name}",
                "liquidity_spread": f"round(list_sum({g}) / (list_sum({w}) + 1e-12), 9) AS liquidity_spread_{name}",
            }[columns]
        )
    return f"{W} SELECT event_id, {', '.join(parts)} FROM book"


def _bands(family: str, digits: int | None = None):
    def run(spark, sf):
        x = b.depth_bands(b.sorted_book(fx.book(spark, sf)), BANDS)
        names = [f"{family}_{b.name_of(k)}" for k in BANDS]
        return x.select("event_id", *[F.round(c, digits).alias(c) if digits else F.col(c) for c in names])

    return run


for _family, _digits in (("depth_imbalance", None), ("depth", None), ("liquidity_concentration", None), ("price_impact_proxy", 9), ("liquidity_spread", 9)):
    query(f"{_family}_k", _bands_sql(_family))(_bands(_family, _digits))


@query(
    "depth_bands",
    f"""{W}, d AS (SELECT symbol, {", ".join(f"list_sum(list_transform(list_slice({s}, 1, {min(k, fx.LEVELS)}), lambda x: x[2])) AS {s}_{k}" for k in BANDS for s in ("bids", "asks"))} FROM book)
SELECT symbol, {", ".join(f"sum(bids_{k} + asks_{k}) AS depth_{k}, round(avg((bids_{k} - asks_{k}) / (bids_{k} + asks_{k})), 9) AS imbalance_{k}" for k in BANDS)} FROM d GROUP BY symbol""",
)
def depth_bands(spark, sf):
    x = b.depth_bands(b.sorted_book(fx.book(spark, sf)), BANDS)
    return x.groupBy("symbol").agg(*[c for k in BANDS for c in (F.sum(f"depth_{b.name_of(k)}").alias(f"depth_{k}"), F.round(F.avg(f"depth_imbalance_{b.name_of(k)}"), 9).alias(f"imbalance_{k}"))])


# standardised book

STD = f"""{fx.ctes("book")}, m AS (SELECT *, (bids[1][1] + asks[1][1]) / 2 AS mid_price, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 0.001 * (1 + event_id % 7) END AS volatility FROM book),
p AS (SELECT *, list_concat(list_reverse(bids), asks) AS pairs, coalesce(greatest(volatility * mid_price, 1e-6), 1e-6) + 1e-8 AS scale FROM m),
z AS (SELECT event_id, pairs, list_transform(pairs, lambda x: [(x[1] - mid_price) / scale, x[2]]) AS std FROM p),
c AS (SELECT *, list_filter(std, lambda x: x[1] >= -4 AND x[1] <= 4) AS kept FROM z)"""
FEW, MANY = (20, 0.5, 4.0), (1000, 0.5, 1000.0)  # bins, least and largest price; the second are the shipped ones
DELTA, EDGES, ALL_EDGES = 4.0, b.log_bin_edges(*FEW), b.log_bin_edges(*MANY)


def _list(edges):
    return "[" + ", ".join(f"'{'-' if e < 0 else ''}infinity'::DOUBLE" if abs(e) == float("inf") else f"{e!r}::DOUBLE" for e in edges) + "]"


_EDGES = _list(EDGES)


def standardized(spark, sf):
    x = fx.book(spark, sf).withColumn("mid_price", b.mid_price()).withColumn("volatility", F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE 0.001D * (1 + event_id % 7) END"))
    x = x.withColumn("pairs", b.pv_pairs()).withColumn("std", b.price_standardize("pairs"))
    return x.withColumn("kept", b.price_clip("std", DELTA))


def _levels(df, column):
    """A row a level. The outer form, less the rows of empty arrays: for the inner one Spark infers a filter on the array, and works out all that it is made of once more for each level in it."""
    x = df.select("event_id", F.posexplode_outer(column).alias("pos", "x")).where("pos IS NOT NULL")
    return x.select("event_id", (F.col("pos") + 1).alias("level"), F.round(F.col("x")[0], 6).alias("price"), F.col("x")[1].alias("volume"))


def _levels_sql(column: str) -> str:
    return f"{STD} SELECT event_id, level::INT AS level, round({column}[level][1], 6) AS price, {column}[level][2] AS volume FROM (SELECT event_id, {column}, unnest(range(1, len({column}) + 1)) AS level FROM c)"


@query("pv_pairs", _levels_sql("pairs"))
def pv_pairs(spark, sf):
    return _levels(standardized(spark, sf), "pairs")


@query("price_standardize", _levels_sql("std"))
def price_standardize(spark, sf):
    return _levels(standardized(spark, sf), "std")


@query("price_clip", _levels_sql("kept"))
def price_clip(spark, sf):
    return _levels(standardized(spark, sf), "kept")


@query("pv_unzip", f"{STD} SELECT event_id, len(kept)::INT AS n, round(list_sum(list_transform(kept, lambda x: x[1])), 6) AS sum_price, list_sum(list_transform(kept, lambda x: x[2])) AS sum_volume FROM c")
def pv_unzip(spark, sf):
    p, v = b.pv_unzip("kept")
    x = standardized(spark, sf).select("event_id", p.alias("p"), v.alias("v"))
    total = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
    return x.select("event_id", F.size("p").alias("n"), F.round(total("p"), 6).alias("sum_price"), total("v").alias("sum_volume"))


@query("volume_coverage", f"{STD} SELECT event_id, round(100.0 * coalesce(list_sum(list_transform(kept, lambda x: x[2])), 0) / list_sum(list_transform(std, lambda x: x[2])), 9) AS coverage FROM c")
def volume_coverage(spark, sf):
    return standardized(spark, sf).select("event_id", F.round(b.volume_coverage("std", "kept"), 9).alias("coverage"))


_ALL = _list(ALL_EDGES)


@query(
    "log_bin_edges",
    f"""WITH ed AS (SELECT i - 1 AS i, e FROM (SELECT unnest({_ALL}) AS e, unnest(range(1, {len(ALL_EDGES) + 1})) AS i)), v AS (SELECT value / 100 AS z FROM events),
c AS (SELECT k.i, count(*) AS n FROM v ASOF JOIN ed k ON z >= e GROUP BY ALL) SELECT ed.i::INT AS i, round(e, 9) AS edge, coalesce(n, 0) AS n FROM ed LEFT JOIN c USING (i) WHERE isfinite(e)""",
)
def log_bin_edges(spark, sf):
    """The finite edges of the shipped 1003, with how many event values (in hundreds) lie between each and the next."""
    x = fx.events(spark, sf).select((F.col("value") / 100).alias("z"))
    counts = Bucketizer(splits=ALL_EDGES, inputCol="z", outputCol="i").transform(x).groupBy(F.col("i").cast("int").alias("i")).agg(F.count("*").alias("n"))
    edges = spark.createDataFrame([(i, e) for i, e in enumerate(ALL_EDGES) if abs(e) != float("inf")], "i int, edge double")
    return edges.join(counts, "i", "left").select("i", F.round("edge", 9).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def _binned(edges, levels="kept"):
    """Levels by counting the edges at or below each."""
    return f"""{STD}, l AS (SELECT event_id, unnest({levels}) AS x FROM c), ed AS (SELECT unnest({_list(edges)}) AS e),
i AS (SELECT event_id, least(n - 2, {len(edges) - 3})::INT AS bin, x[2] AS v FROM l ASOF JOIN (SELECT e, row_number() OVER (ORDER BY e) + 1 AS n FROM ed) k ON x[1] >= e WHERE x[2] > 0),
s AS (SELECT event_id, bin::INT AS bin, sum(v) AS volume FROM i GROUP BY ALL)"""


ALL_BINNED = _binned(ALL_EDGES, "std")


@query("log_bin_assign", f"{ALL_BINNED} SELECT bin, count(*) AS n, sum(volume) AS volume FROM s GROUP BY bin")
def log_bin_assign(spark, sf):
    return _sparse(spark, sf).groupBy("bin").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def _sparse(spark, sf, bins=MANY, levels="std"):
    return b.log_bins(standardized(spark, sf), levels, ["event_id"], *bins)


@query("bin_aggregate", f"{ALL_BINNED} SELECT * FROM s")
def bin_aggregate(spark, sf):
    return _sparse(spark, sf)


@query("bin_normalize", f"{ALL_BINNED}, t AS (SELECT event_id, sum(volume) AS total FROM s GROUP BY event_id) SELECT event_id, bin, round(s.volume / t.total, 9) AS share, {len(ALL_EDGES) - 2}::INT AS n_bins FROM s JOIN t USING (event_id)")
def bin_normalize(spark, sf):
    """Each row's densities over the shipped 1001 bins, of which those above zero are told."""
    x = b.with_bins(standardized(spark, sf), "std", *MANY).select("event_id", b.dense_bins("binned", len(ALL_EDGES) - 2).alias("bins"))
    # compiled row by row, unlike a filter over an array; the outer form infers no filter that works the bins out again
    return x.select("event_id", F.size("bins").alias("n_bins"), F.posexplode_outer("bins").alias("bin", "share")).where("share > 0").withColumn("share", F.round("share", 9))


@query(
    "clr_transform",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings),
l AS (SELECT vec_id, list_transform(v, lambda x: ln(x + 1e-10)) AS l FROM v)
SELECT vec_id, (i - 1)::INT AS i, round(l[i] - list_sum(l) / len(l), 6) AS clr FROM (SELECT vec_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)""",
)
def clr_transform(spark, sf):
    x = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("v"))
    return x.select("vec_id", F.posexplode(b.clr("v")).alias("i", "clr")).withColumn("clr", F.round("clr", 6))


# returns and volatility in halo frames

#: Rows that past returns look back.
PAST = (1, 2, 3, 5, 10, 20)

HALO = f"""{fx.ctes("series")}, hh AS (SELECT DISTINCT symbol, hour FROM series),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS rank, count(*) OVER (PARTITION BY symbol) AS n FROM hh),
f AS (SELECT series.*, unnest([hour - 1, hour, hour + 1]) AS frame FROM series),
r AS (SELECT *, ln(mid) - ln(lag(mid, 1) OVER w) AS log_return, {", ".join(f"ln(mid) - ln(lag(mid, {n}) OVER w) AS past_{n}" for n in PAST)}, ln(lead(mid, 1) OVER w) - ln(mid) AS fwd_1, ln(lead(mid, 3) OVER w) - ln(lead(mid, 1) OVER w) AS fwd_2_late, row_number() OVER w AS k
 FROM f WINDOW w AS (PARTITION BY symbol, frame ORDER BY us, event_id)),
e AS (SELECT *, sum(log_return * log_return * power({1 - fx.ALPHA20!r}::DOUBLE, -k)) OVER (PARTITION BY symbol, frame ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) * {fx.ALPHA20!r}::DOUBLE * power({1 - fx.ALPHA20!r}::DOUBLE, k) AS variance FROM r),
o AS (SELECT e.* FROM e JOIN rk ON rk.symbol = e.symbol AND rk.hour = e.frame WHERE rank > 1 AND rank <= n - 1 AND (e.hour = frame OR (rank = 2 AND e.hour < frame)))"""


def _framed(spark, sf, compiled=False):
    x = fx.series(spark, sf)
    return frames.framed(
        x.withColumn("log_mid", frames.log_price("mid")) if compiled else x,
        ["symbol"],
        {
            "log_return": lambda w: frames.log_return(w),
            **{f"past_{n}": (lambda w, n=n: frames.log_return(w, n)) for n in PAST},
            "fwd_1": lambda w: frames.forward_log_return(w, 1),
            "fwd_2_late": lambda w: frames.forward_log_return(w, 2, 1),
            "variance": lambda w: frames.ewma_variance(w, 20),
        },
    )


def _returns(names):
    return lambda spark, sf: _framed(spark, sf, names == ["variance"]).select("event_id", *[scalar.rounded(c, 9).alias(c) for c in names])


for _key, _names in (("log_return", ["log_return"]), ("past_logret_n", [f"past_{n}" for n in PAST]), ("fwd_logret_h", ["fwd_1", "fwd_2_late"]), ("ewma_variance", ["variance"])):
    query(_key, f"{HALO} SELECT event_id, {', '.join(f'round({c}, 9) AS {c}' for c in _names)} FROM o")(_returns(_names))


@query("volatility", f"{HALO} SELECT event_id, round(sqrt(variance), 8) AS volatility FROM o")
def volatility(spark, sf):
    return _framed(spark, sf, True).select("event_id", F.round(F.sqrt("variance"), 8).alias("volatility"))


@query("hours_distinct", f"{fx.ctes('series')} SELECT DISTINCT symbol, hour FROM series")
def hours_distinct(spark, sf):
    return frames.hours_distinct(fx.series(spark, sf), ["symbol"])


@query(
    "hours_processable",
    f"{fx.ctes('series')}, h AS (SELECT DISTINCT symbol, hour FROM series), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS rank, count(*) OVER (PARTITION BY symbol) AS n FROM h) SELECT symbol, hour FROM r WHERE rank > 2 AND rank <= n - 1",
)
def hours_processable(spark, sf):
    return frames.hours_processable(fx.series(spark, sf), ["symbol"], 2, 1).select("symbol", "hour")


FLAG = f"""{HALO.replace("WITH ", "WITH ", 1)}, bk AS (SELECT event_id, bids[1][1] AS pb, asks[1][1] AS pa, bids[1][2] AS vb, asks[1][2] AS va, list_sum(list_transform(list_slice(bids, 1, 5), lambda x: x[2])) AS b5, list_sum(list_transform(list_slice(asks, 1, 5), lambda x: x[2])) AS a5 FROM (SELECT event_id, bids, asks FROM (SELECT * FROM ({fx.TEXT["book"]}))))
SELECT o.symbol, o.hour, count(*) AS n, round(avg(pa - pb), 9) AS spread, round(avg((pa * vb + pb * va) / (vb + va) - (pb + pa) / 2), 9) AS microprice_offset, round(avg((b5 - a5) / (b5 + a5)), 9) AS imbalance_5, round(avg(sqrt(variance)), 8) AS volatility
FROM o JOIN bk ON o.event_id = bk.event_id WHERE o.hour = o.frame GROUP BY o.symbol, o.hour"""


@query("flagship_hourly", FLAG)
def flagship_hourly(spark, sf):
    """Per symbol and hour: mean spread, microprice offset, top-5 imbalance and volatility; one window over halo frames."""
    x = b.depth_bands(b.sorted_book(fx.book(spark, sf)), (5,))
    x = x.select("event_id", "symbol", "us", "hour", b.mid_price().alias("mid"), b.spread().alias("spread"), b.microprice().alias("micro"), F.col("depth_imbalance_top_5").alias("imbalance"))
    w = Window.partitionBy("symbol", "frame").orderBy("us", "event_id")
    y = frames.halo(x.withColumn("log_mid", frames.log_price("mid"))).withColumn("log_return", frames.log_return(w)).withColumn("variance", frames.ewma_variance(w, 20)).where("hour = frame")
    y = y.join(frames.hours_processable(x, ["symbol"]).select("symbol", "hour"), ["symbol", "hour"])
    r = lambda c, d=9: F.round(F.avg(c), d)
    return y.groupBy("symbol", "hour").agg(
        F.count("*").alias("n"), r("spread").alias("spread"), r(F.col("micro") - F.col("mid")).alias("microprice_offset"), r("imbalance").alias("imbalance_5"), r(F.sqrt("variance"), 8).alias("volatility")
    )
