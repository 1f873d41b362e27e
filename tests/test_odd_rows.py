"""Rows that the given tables hold seldom or never."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, differ
from tidebook.llm import op9_quality
from tidebook.llm.common import small_batches
from tidebook.operators import book as b
from tidebook.operators import fit, frames, quality, stats
from tidebook.plans import streams
from tidebook.plans.catalog import QUERIES, SQL
from tidebook.sources import tables


def test_all_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, -2.0]), (2, [1.0, None]), (3, [nan]), (4, [0.0, inf]), (5, [-inf]), (6, []), (7, None)]
    got = spark.createDataFrame(rows, "k int, v array<double>").where(b.all_finite("v"))
    assert sorted(r.k for r in got.collect()) == [1, 6]


def test_project_features(spark):
    rows = [(1, ["a", "b"], [1.0, 2.0]), (2, ["b"], [5.0]), (3, ["a", "b"], [None, 2.0])]
    got = spark.createDataFrame(rows, "k int, n array<string>, v array<double>").select("k", b.project_features("v", "n", ["b", "c", "a"]).alias("p"))
    assert {r.k: r.p for r in got.collect()} == {1: [2.0, 0.0, 1.0], 2: [5.0, 0.0, 0.0], 3: [2.0, 0.0, 0.0]}


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest tables with some prices of zero, two of them in a row."""
    path = tmp_path_factory.mktemp("odd")
    c = connect(sf)
    c.execute(f"COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id IN (31, 250, 251, 640, 977) THEN 0.0 ELSE value END AS value, props FROM events) TO '{path}/events.parquet'")
    return str(path)


ZERO_PRICES = (
    "ewma_vol_reward", "filter_min_samples", "filter_standardizable", "filter_transformable", "fit_sample_counts", "flagship_hourly", "fwd_logret_h", "halflife_fit_score", "liquidity_concentration_k",
    "listwise_null_drop", "log_return", "acf", "classify_features", "config_select", "proj_array_by_index", "pearson_p_df", "ewma_standardize", "st_breusch_pagan", "st_white", "depth_k",
)


@pytest.mark.parametrize("name", ZERO_PRICES)
def test_prices_of_zero_against_sql(spark, odd, name):
    assert differ(QUERIES[name](spark, odd), SQL[name], odd) == ([], [])


def test_log_price(spark):
    x = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (None,)], "p double").select(frames.log_price("p").alias("l"))
    a, b, c, d = (r.l for r in x.collect())
    assert (a, b, d) == (0.0, float("-inf"), None) and c != c


def test_levels_of_one_price_keep_their_order(spark):
    rows = [([[0.0, 5.0], [1.0, 2.0], [0.0, 7.0], [0.0, 1.0]], [[0.0, 5.0], [0.0, 7.0], [-1.0, 3.0], [0.0, 1.0]])]
    x = spark.createDataFrame(rows, "bids array<array<double>>, asks array<array<double>>")
    r = b.sorted_book(x).first()
    assert [v for _, v in r.bids] == [2.0, 5.0, 7.0, 1.0] and [v for _, v in r.asks] == [3.0, 5.0, 7.0, 1.0]
    r = b.sorted_book(x, by_volume=True).first()
    assert [v for _, v in r.bids] == [2.0, 7.0, 5.0, 1.0] and [v for _, v in r.asks] == [3.0, 1.0, 5.0, 7.0]


def test_all_grams_are_compared(spark):
    rows = [(s, f"g{i}", n) for s, ns in ((0, range(40, 10, -1)), (1, range(11, 41))) for i, n in enumerate(ns)] + [(0, "x", 99), (1, "y", 99)]
    r = quality.compare_all(spark.createDataFrame(rows, "sample int, gram string, n long")).first()
    assert r.common == 30 and abs(r["corr"] + 1) < 1e-12


def test_grid_variances_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    data = {1: (rng.normal(1, 1, 9000), 0.0, 0.5), 2: (rng.gamma(2.0, 3.0, 500) + 1e4, -0.25, 2.0), 3: (np.array([-1.0, -2.0]), 1.0, 0.0)}
    rows = [(k, float(x), b, y) for k, (xs, b, y) in data.items() for x in xs]
    df = spark.createDataFrame(rows, "_id long, value double, box_cox double, yeo_johnson double").repartition(7, F.rand(1))
    steps = [-0.25, 0.0, 0.25]
    got = {(r._id, r._i): r for r in fit._grid_variances(df, steps).collect()}
    assert len(got) == 9
    for k, (x, b, y) in data.items():
        for i, s in enumerate(steps):
            p, lb, ly = x[x > 0], b + s, y + s
            box = np.log(p) if lb == 0 else (p**lb - 1) / lb
            up, low = np.abs(x) + 1, 2 - ly
            pos, neg = (np.log(up) if e == 0 else (up**e - 1) / e for e in (ly, low))
            assert got[k, i]._vy == pytest.approx(np.where(x >= 0, pos, -neg).var(), rel=1e-7)
            assert got[k, i]._vb == (pytest.approx(box.var(), rel=1e-5) if len(p) else None)


@pytest.mark.parametrize("name", ("price_standardize", "price_clip", "bin_normalize"))
def test_levels_are_worked_out_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "lambda" in x]


@pytest.mark.parametrize("name", ("filter_finite_rows", "removal_report", "dedup_ts"))
def test_values_of_the_table_that_are_not_finite(spark, sf, tmp_path, name):
    odd = "CASE event_id % 53 WHEN 7 THEN NULL WHEN 8 THEN 'nan'::DOUBLE WHEN 9 THEN 'inf'::DOUBLE WHEN 10 THEN 0.0 ELSE value END"
    rows = f"SELECT nullif(event_id, 77) AS event_id, CASE WHEN event_id <> 55 THEN ts END AS ts, user_id, event_type, {odd} AS value, props FROM events"
    connect(sf).execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    assert differ(QUERIES[name](spark, str(tmp_path)), SQL[name], str(tmp_path)) == ([], [])


@pytest.mark.parametrize("name", ("book_state", "stream_dedup", "stream_window_counts"))
def test_batches_of_a_stream_are_bounded(spark, sf, monkeypatch, name):
    monkeypatch.setattr(streams, "SLOT_ROWS", 50)  # 20 batches of 1000 events, were there no bound
    monkeypatch.setattr(streams, "MOST_SLOTS", 2)
    began, cut, partitions = [], tables.time_slots, spark.conf.get("spark.sql.shuffle.partitions")

    def slots(*args, **how):
        began.extend(cut(*args, **how))
        return began

    monkeypatch.setattr(tables, "time_slots", slots)
    assert differ(QUERIES[name](spark, sf), SQL[name], sf) == ([], [])
    assert len(began) == 2 and spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    sent = op9_quality.measure(docs, docs.columns)._jdf.queryExecution().analyzed().children().head().output()
    assert sent.size() == 3
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    with small_batches(spark):
        assert int(spark.conf.get(name)) < int(own)
    assert spark.conf.get(name) == own


def test_bins_are_totalled_in_batches(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [[0.0, 1.0], [-0.0, 2.0], [0.7, 4.0], [-9.0, 8.0], [9.0, 1.0], [0.7, 0.5]]), (2, [[nan, 1.0], [None, 1.0], [inf, 1.0], [0.1, 0.0], [0.1, None], [0.1, -1.0]]), (3, []), (4, None), (5, [[-0.7, 3.0]])]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>")
    edges, want = b.log_bin_edges(20, 0.5, 4.0), Counter()
    for k, levels in rows:
        for p, v in levels or []:
            if p is not None and abs(p) < inf and v and v > 0:
                want[k, min(sum(e <= p for e in edges) - 1, len(edges) - 3)] += v
    got = b.log_bins(df.coalesce(1), "p", ["id"], 20, 0.5, 4.0)
    assert {(r.id, r.bin): r.volume for r in got.collect()} == want
    assert {r.id: r.binned is None for r in b.with_bins(df, "p", 20, 0.5, 4.0).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_kpss_meets_a_series_once(spark):
    rng = np.random.default_rng(5)
    data = {0: rng.normal(size=300), 1: np.cumsum(rng.normal(size=300)), 2: np.ones(40), 3: rng.normal(size=19)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, x in data.items() for i, v in enumerate(x)], "sid int, i int, value double").repartition(6, F.rand(2))
    out = stats.kpss(df, ["sid"])
    got = {r.sid: r for r in out.collect()}
    assert set(got) == {0, 1}
    for k in got:
        n, d = 300, data[k] - data[k].mean()
        c = [d[j:] @ d[: n - j] for j in range(n)]
        s0, s1 = c[0] / n + sum(c[j] for j in (1, 2, 3)) / (n / 2), sum(j * c[j] for j in (1, 2, 3)) / (n / 2)
        q = min(int(1.1447 * np.cbrt((s1 / s0) ** 2) * np.cbrt(n)), n - 1)
        want = (np.cumsum(d) ** 2).sum() / n**2 / ((c[0] + 2 * sum((1 - j / (q + 1)) * c[j] for j in range(1, q + 1))) / n)
        assert got[k].n == n and got[k].statistic == pytest.approx(want, rel=1e-9)
    plan = stats.kpss(df.coalesce(1), ["sid"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_codeword_sums_leave_tasks_added_up(spark):
    rows = [(0, 1, [0.0, 1.0]), (0, 2, [0.0, 3.0]), (0, 3, [9.0, None]), (0, 4, [8.0, 8.0]), (1, 5, [1.0, 1.0]), (None, 6, [1.0, 1.0]), (0, 7, None), (2, 8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "split_id int, vec_id long, v array<double>").coalesce(1)
    book = spark.createDataFrame([(0, 0, [0.0, 2.0]), (0, 1, [9.0, 9.0]), (1, 0, [5.0, 5.0])], "split_id int, code int, e array<double>")
    got = {(r.split_id, r.code, r.i): (r.s, r.n) for r in quality.code_sums(df, book, ["split_id"]).collect()}
    # a vector that lacks a component goes to the lowest code and counts where it has values
    assert got == {(0, 0, 0): (9.0, 3), (0, 0, 1): (4.0, 2), (0, 1, 0): (8.0, 1), (0, 1, 1): (8.0, 1), (1, 0, 0): (1.0, 1), (1, 0, 1): (1.0, 1)}
