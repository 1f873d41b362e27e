"""Operators against their definitions as plain loops, and properties that hold for any data."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict
from datetime import timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import fit, frames, quality, splits, stats, trading
from tidebook.plans import fixtures as fx
from tidebook.streaming import books


def walk(x, alpha):
    m = v = None
    out = []
    for a in x:
        if m is None:
            m, v = a, 0.0
        else:
            d = a - m
            m += alpha * d
            v = (1 - alpha) * (v + alpha * d * d)
        out.append((m, v))
    return out


def test_blocked_scan_is_the_recurrence_for_any_block(spark):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(700)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, idx long, value double")
    want = walk(x, 1 - 2 ** (-1 / 5))
    for block in (7, 64, 512):
        got = {r.idx: r.ewma_value for r in frames.ewma_scan(df, ["k"], "idx", ["value"], 5, block).collect()}
        assert max(abs(got[i] - m) for i, (m, _) in enumerate(want)) < 1e-9


def test_final_state_is_the_recurrence(spark):
    rng = random.Random(2)
    x = [rng.gauss(5, 2) for _ in range(300)]
    df = spark.createDataFrame([("a", i, i, v) for i, v in enumerate(x)], "k string, us long, event_id long, value double")
    for r in fit.ewma_state(df, ["k"]).collect():
        m, v = walk(x, 1 - 2 ** (-1 / r.half_life))[-1]
        assert abs(r["mean"] - m) < 1e-9 and abs(r["var"] - v) < 1e-7


def test_ranks_do_not_hang_on_partitions(spark):
    df = spark.range(1000).withColumn("us", (F.col("id") * 7919) % 1000)
    for n in (1, 5):
        got = frames.ranked(df.repartition(n), [], ["us"], F.floor(F.col("us") / 100)).select("us", "idx").collect()
        assert all(r.us == r.idx for r in got)


def test_roles_cover_each_row_once_and_ranges_leave_validation_alone(spark, sf):
    line = splits.timeline(fx.events(spark, sf))
    f = splits.folds(line, 8).cache()
    s = splits.cpcv_splits(f, 2).cache()
    assert s.count() == 28
    r = splits.ranges(f, s, 10**9, 10**9)
    bad = r.join(splits.validation_folds(s), ["split_id", "fold_id"]).count()
    assert bad == 0
    rows = splits.role_rows(splits.with_roles(fx.events(spark, sf), splits.pieces(f, s, r), s))
    per = rows.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("split_id").alias("d"))
    assert per.where("n != 28 OR d != 28").count() == 0


def test_book_asof_follows_the_updates(spark):
    rng = random.Random(3)
    ups = [(1, "partial", 0, 1.0, 1.0, "Buy")]
    for i in range(2, 400):
        a = rng.choice(["insert", "update", "delete", "insert"]) if i % 120 else "partial"
        ups.append((i, a, rng.randrange(8), float(i), float(rng.randrange(9)), rng.choice(["Buy", "Sell"])))
    df = spark.createDataFrame([("s", q, q * 10, a, i, p, z, d) for q, a, i, p, z, d in ups], books.L2)
    grid = spark.createDataFrame([("s", g) for g in range(105, 4000, 130)], "symbol string, grid_us long")
    got = {}
    for r in books.book_asof(df, grid).collect():
        assert r.id not in got.setdefault(r.grid_us, {})
        got[r.grid_us][r.id] = (r.price, r.size, r.side)
    for g in range(105, 4000, 130):
        book = {}
        books.apply_updates(book, [(a, i, p, z, d) for q, a, i, p, z, d in ups if q * 10 <= g])
        assert got.get(g, {}) == book


def test_stream_scaler_is_the_gated_recurrence(spark, sf, monkeypatch):
    """In several batches: only train and warm-up rows move a key's state; others take the last one, or their own value before the first."""
    from tidebook.plans import streams

    monkeypatch.setattr(streams, "SLOT_ROWS", 1500)
    z = {(r.split_id, r.feature, r.event_id): r.z for r in streams.stream_ewma(spark, sf).collect()}
    rows = defaultdict(list)
    for r in fx.split_long(spark, sf).where("value IS NOT NULL").orderBy("us", "event_id").collect():
        rows[r.split_id, r.feature, r.symbol].append(r)
    assert len(z) == sum(map(len, rows.values()))
    alpha = 1 - 2 ** (-1 / 20)
    for (split, feature, _), own in rows.items():
        m = v = None
        for r in own:
            if r.role in ("train", "train_warmup"):
                d = 0.0 if m is None else r.value - m
                m, v = (r.value, 0.0) if m is None else (m + alpha * d, (1 - alpha) * (v + alpha * d * d))
            want = r.value if m is None else max(-3.0, min(3.0, (r.value - m) / math.sqrt(v + 1e-12)))
            assert abs(z[split, feature, r.event_id] - want) < 2e-5


def series(spark, x):
    return spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "k string, i int, value double")


def test_statistics_tell_noise_from_structure(spark):
    rng = np.random.default_rng(5)
    noise, walk_ = rng.normal(size=500), rng.normal(size=500).cumsum()
    ar = [0.0]
    for e in rng.normal(size=499):
        ar.append(0.6 * ar[-1] + e)
    fat = rng.standard_t(3, 500)
    p = lambda f, x: f(series(spark, x), ["k"]).first().p_value
    assert p(stats.jarque_bera, noise) > 0.01 > p(stats.jarque_bera, fat)
    assert p(stats.ljung_box, noise) > 0.01 > p(stats.ljung_box, ar)
    assert p(stats.adf, noise) < 0.01 < p(stats.adf, walk_)
    assert p(stats.phillips_perron, noise) < 0.01 < p(stats.phillips_perron, walk_)
    assert p(stats.kpss, walk_) <= 0.05 <= p(stats.kpss, noise)
    assert p(stats.shapiro, noise) > 0.01 > p(stats.shapiro, fat)
    assert p(stats.runs, noise) > 0.01 > p(stats.runs, walk_)
    h = np.zeros(800)
    for i in range(1, 800):
        h[i] = rng.normal() * math.sqrt(0.2 + 0.8 * h[i - 1] ** 2)
    assert p(stats.arch_lm, noise) > 0.01 > p(stats.arch_lm, h)


def test_thresholds_of_the_normality_score(spark):
    rng = np.random.default_rng(6)
    rows = [(f"n{n}", float(v)) for n in (19, 20, 99, 100, 499, 500) for v in rng.normal(size=n)] + [("flat", 1.0)] * 50
    got = {r.k: r.score for r in fit.pearson_p_df(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert got["n19"] == got["flat"] == fit.WORST
    assert all(got[f"n{n}"] < 10 for n in (20, 99, 100, 499, 500))


def test_distances_of_a_sample_to_itself_are_zero(spark):
    rows = [(k, float(v)) for v in range(100) for k in (0, 1)]
    df = spark.createDataFrame(rows, "sample int, value double").withColumn("key", F.lit(1))
    assert quality.ks_two_sample(df, ["key"]).first().d == 0
    assert quality.wasserstein(df, ["key"]).first().w1 == 0


def test_episode_account_is_the_loop(spark):
    rng = random.Random(7)
    pos, tgt = [rng.uniform(-1, 1) for _ in range(50)], [rng.gauss(0, 0.01) for _ in range(50)]
    df = spark.createDataFrame([("s", "e", i, p, 1.0, y) for i, (p, y) in enumerate(zip(pos, tgt, strict=True))], "symbol string, episode string, t int, position double, position_std double, target double")
    r = trading.episode_metrics(df).first()
    cost = sum(0.001 * abs(a - b) for a, b in zip(pos, [0.0, *pos], strict=False))
    gain = sum(p * y for p, y in zip(pos, tgt[:-1], strict=False))
    assert abs(r.total_cost - cost) < 1e-12 and abs(r.realised_pnl - gain) < 1e-12 and r.steps == 50


def test_feature_plans_need_no_single_task_and_no_python(spark, sf):
    from tidebook.plans.catalog import QUERIES

    for name in ("flagship_hourly", "depth_bands", "ewma_variance", "role_assign"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
    assert "SinglePartition" not in QUERIES["flagship_hourly"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_empty_side_gives_null_or_the_fold_start(spark):
    from tidebook.operators import book as b

    df = spark.createDataFrame([([[1.0, 2.0]], [])], "bids array<array<double>>, asks array<array<double>>")
    r = df.select(b.mid_price().alias("a"), b.mid_price(True).alias("b"), b.microprice().alias("m")).first()
    assert r.a > 1e307 and r.b is None
    x = b.depth_bands(b.sorted_book(df), (5, 0)).first()
    assert x.depth_top_5 == 2.0 and x.depth_imbalance_all == 1.0



def test_ranks_lags_and_running_sums_by_buckets_are_those_of_whole_windows(spark):
    from pyspark.sql import Window

    from tidebook.operators import frames

    rng = np.random.default_rng(9)
    rows = [(k, int(t), i, float(v)) for k, n in (("a", 500), ("b", 37), ("c", 1)) for i, (t, v) in enumerate(zip(np.sort(rng.integers(0, 50, n)), rng.normal(size=n), strict=True))]
    df = spark.createDataFrame(rows, "k string, us long, id long, value double")
    w = Window.partitionBy("k").orderBy("us", "id")
    want = df.select("k", "id", (F.row_number().over(w) - 1).alias("idx"), F.lag("value", 1).over(w).alias("p1"), F.lag("value", 5).over(w).alias("p5"), F.lead("value", 2).over(w).alias("n2"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("s"))
    x = frames.running(frames.ranked(df, ["k"], ["us", "id"], F.expr("us div 7"), "idx"), ["k"], ["us", "id"], F.expr("us div 7"), F.col("value"), "s")
    got = frames.lagged(x, ["k"], "idx", {"p1": ("value", 1), "p5": ("value", 5), "n2": ("value", -2)}, block=16)
    assert sorted(map(str, got.select("k", "id", "idx", "p1", "p5", "n2", F.round("s", 9).alias("s")).collect())) == sorted(map(str, want.collect()))


def test_bins_in_closed_form_are_those_of_the_edges(spark):
    from tidebook.operators import book as b

    for bins, eps, delta in ((20, 0.5, 4.0), (1000, 0.5, 1000.0)):
        edges = b.log_bin_edges(bins, eps, delta)
        rng = np.random.default_rng(4)
        z = [*edges[1:-1], *np.nextafter(edges[1:-1], -np.inf), *np.nextafter(edges[1:-1], np.inf), 0.0, 1e-9, -1e-9, 1e6, -1e6, *(rng.normal(size=300) * 10), *(10 ** rng.uniform(-3, 4, 300))]
        got = [r.b for r in spark.createDataFrame([(float(v),) for v in z], "z double").select(b.bin_of(F.col("z"), bins, eps, delta).alias("b")).collect()]
        assert got == [min(sum(e <= v for e in edges) - 1, len(edges) - 3) for v in z]


def test_carried_scaling_is_the_recurrence(spark):
    """Blocks and batches of any length, values far from their state, one key that begins in the second batch."""
    from tidebook.streaming.books import ewma_carried

    rng = np.random.default_rng(2)
    x = {"a": np.concatenate([rng.normal(5, 2, 700), rng.normal(1e4, 1, 800)]), "b": rng.normal(-3, 0.1, 40)}
    alpha, got = 1 - 2 ** (-1 / 20), {}
    state = spark.createDataFrame([], "key string, m0 double, v0 double")
    for keys, lo, hi in ((("a",), 0, 613), (("a", "b"), 613, 1500)):
        rows = [(k, i, float(v)) for k in keys for i, v in enumerate(x[k][lo if k == "a" else 0 : hi])]
        out = ewma_carried(spark.createDataFrame(rows, "key string, idx long, value double"), ["key"], "idx", "value", state, 20, block=64).collect()
        for r in sorted(out, key=lambda r: r.idx):
            got.setdefault(r.key, []).append((r.m, r.v))
        state = spark.createDataFrame([(k, *v[-1]) for k, v in got.items()], "key string, m0 double, v0 double")
    for k, v in x.items():
        for (m, var), (wm, wv) in zip(got[k], walk(list(v), alpha), strict=True):
            assert m == pytest.approx(wm, rel=1e-9) and var == pytest.approx(wv, rel=1e-6, abs=1e-9)


def replay(spark, path, rows, schema, build, rows_a_slot, mix_times=False):
    from tidebook.sources import tables
    from tidebook.streaming import books

    df = spark.createDataFrame(rows, schema)
    slots = tables.time_slots(df, f"{path}/in", rows=rows_a_slot)
    if mix_times:
        files = [str(f) for f in Path(path).rglob("in/*/*.parquet")]
        for f, t in zip(files, random.Random(5).sample(range(10**9, 2 * 10**9, 1000), len(files)), strict=True):
            os.utime(f, (t, t))
    schemas = []

    def start(stream):
        out = build(stream)
        schemas.append(out.schema)
        return books.written(f"{path}/out", f"{path}/state")(out)

    books.replay(spark, f"{path}/in", slots, df.schema, start)
    return len(slots), spark.read.schema(schemas[0]).parquet(f"{path}/out").collect()


@pytest.mark.parametrize("rows_a_slot", [100, 3])
def test_every_grid_time_is_told(spark, tmp_path, rows_a_slot):
    """In one batch or several: grid times between updates, quiet keys, the snapshot after the last update."""
    from tidebook.streaming import books

    ms = 1000
    rows = [("s", 1, 10 * ms, "partial", 1, 5.0, 1.0, "Buy"), ("s", 2, 400 * ms, "insert", 2, 6.0, 1.0, "Sell"), ("s", 3, 400 * ms, "delete", 1, 0.0, 0.0, "Buy"), ("s", 4, 750 * ms, "update", 2, 0.0, 3.0, "Sell")]
    rows += [("t", 5, 20 * ms, "insert", 1, 5.0, 1.0, "Buy"), ("t", 6, 900 * ms, "update", 1, 0.0, 2.0, "Buy"), ("u", 7, 150 * ms, "partial", 9, 2.0, 1.0, "Sell"), (None, 8, 1150 * ms, books.HEARTBEAT, None, None, None, None)]
    _, got = replay(spark, str(tmp_path), rows, books.L2, lambda x: books.snapshots(x, 100 * ms, "100 milliseconds"), rows_a_slot)
    # the update at 400 is in the book of 400; nothing begins before a partial; u has no update after its first
    want = [("s", t, 1, 0) for t in (100, 200, 300)] + [("s", t, 0, 1) for t in range(400, 1001, 100)] + [("u", t, 0, 1) for t in range(200, 1001, 100)]
    assert sorted((r.symbol, r.grid_us // ms, r.n_bids, r.n_asks) for r in got) == want


def test_batches_follow_event_time_whatever_the_file_times(spark, tmp_path):
    from tidebook.streaming import books

    rng = random.Random(3)
    rows = [(rng.choice("ab"), 3_600_000_000 * 1000 + i * 97_000_000) for i in range(400)]
    rng.shuffle(rows)
    count = lambda x: books.hourly_counts(x.withColumn("ts", F.timestamp_micros("us")))
    n, got = replay(spark, str(tmp_path), rows, "symbol string, us long", count, 60, mix_times=True)
    closed = (max(us for _, us in rows) - 600_000_000) // 3_600_000_000 * 3_600_000_000
    want = Counter((s, us // 3_600_000_000) for s, us in rows if us < closed)
    assert n > 5 and {(r.symbol, int(r.window.start.replace(tzinfo=timezone.utc).timestamp()) // 3600): r.n for r in got} == want


def test_files_are_ingested_once(spark, tmp_path):
    from tidebook.sources import tables

    path, schema = str(tmp_path), "a long"
    tables.write_files(spark.range(5).withColumnRenamed("id", "a"), path, None, lambda d: "one.parquet")
    tables.write_bytes(spark, f"{path}/bad.parquet", b"no")
    log = spark.createDataFrame([], "filename string, type string, record_count int")
    rows, new = tables.ingested(spark, path, log, "book", schema)
    assert rows.count() == 5 and [tuple(r) for r in new.collect()] == [("one.parquet", "book", 5)]
    rows, again = tables.ingested(spark, path, new, "book", schema)
    assert rows.count() == 0 and again.count() == 0


def test_codebooks_are_those_of_plain_k_means(spark):
    """One codebook a key, from the same first codewords; a key of fewer rows than codes; a codeword without rows stays."""
    from tidebook.sources import tables

    rng = np.random.default_rng(12)
    data = {0: np.concatenate([c + rng.normal(size=(40, 5)) for c in rng.normal(size=(4, 5)) * 5]), 1: rng.normal(size=(90, 5)), 2: rng.normal(size=(3, 5))}
    rows = [(s, 1000 * s + i, v.tolist()) for s, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "split_id int, vec_id long, v array<double>").repartition(5)
    book = quality.fit_codes_by(df, ["split_id"], 4, tables.stored, rounds=6)
    got = {(r.split_id, r.code): np.array(r.e) for r in book.collect()}
    for s, x in data.items():
        ids = sorted(range(len(x)), key=lambda i: hashlib.md5(str(1000 * s + i).encode()).hexdigest())[:4]
        c = x[ids].copy()
        for _ in range(6):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        assert {k for t, k in got if t == s} == set(range(len(c)))
        for k in range(len(c)):
            assert np.abs(got[s, k] - c[k]).max() < 1e-9
    with pytest.raises(ValueError, match="at most"):
        quality.nearest(df, book, ["split_id"], most=10).count()


@pytest.mark.parametrize(("dims", "block"), [(7, 3), (200, 64), (1001, 128)])
def test_correlations_by_blocks(spark, dims, block):
    """Two samples, a dimension that doesn't vary in one of them, dimensions far from zero."""
    rng = np.random.default_rng(6)
    data = {s: rng.normal(size=(40, dims)) @ (np.eye(dims) + 0.1 * rng.normal(size=(dims, dims))) + 3 for s in (0, 1)}
    data[1][:, 2] = 5.0
    df = spark.createDataFrame([(s, v.tolist()) for s, x in data.items() for v in x], "sample int, v array<double>").repartition(3)
    r = quality.correlations(df, ["sample"], dims, block=block)
    with np.errstate(invalid="ignore"):
        p, q = (np.nan_to_num(np.corrcoef(data[s], rowvar=False)) for s in (0, 1))
    if dims < 300:
        got = np.zeros((2, dims, dims))
        for x in r.collect():
            got[x["sample"], x.i, x.j] = got[x["sample"], x.j, x.i] = x.r
        assert np.abs(got - np.stack([p, q])).max() < 1e-9
    d = quality.correlation_distance(r).first()
    want = (np.linalg.norm(p - q), (p * q).sum() / np.linalg.norm(p) / np.linalg.norm(q), np.abs(p - q).mean(), np.abs(p - q).max())
    assert (d.frobenius, d.frobenius_corr, d.mean_abs, d.max_abs) == pytest.approx(want, rel=1e-9)


def test_top_grams_are_compared_alone(spark):
    rows = [(0, "a", 9), (0, "b", 5), (0, "c", 1), (0, "e", 4), (1, "a", 3), (1, "b", 8), (1, "d", 7), (1, "c", 2)]
    df = spark.createDataFrame(rows, "sample int, gram string, n long")
    assert tuple(quality.compare_top(df, 3).first()) == (2, 2 / 3, -1.0)
    assert tuple(quality.compare_top(df, 1).first()) == (0, 0.0, 0.0)


def test_readers_see_whole_versions_while_writers_swap(spark, tmp_path):
    """A reader that follows the pointer all the time finds each version whole; old ones go, the last stay."""
    import threading

    from tidebook.sources import tables

    base, seen, wrong, done = str(tmp_path / "t"), [], [], threading.Event()
    tables.swap(spark.range(100).withColumn("v", F.lit(0)), base, 100)

    def read():
        while not done.is_set():
            try:
                rows = tables.current(spark, base).groupBy("v").count().collect()
                (seen if len(rows) == 1 and rows[0]["count"] == 100 + rows[0].v else wrong).append([tuple(r) for r in rows])
            except Exception as e:  # a version that is gone while it is read
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        tables.swap(spark.range(100 + v).withColumn("v", F.lit(v)), base, 100 + v)
    done.set()
    reader.join()
    assert seen and not wrong and tables.current(spark, base).count() == 105
    assert len([p for p in Path(base).iterdir() if p.name.startswith("version=")]) == tables.GRACE + 1
    with pytest.raises(ValueError, match="rows instead"):
        tables.swap(spark.range(3), base, 4)
    assert tables.current(spark, base).count() == 105


def test_dense_bins_stay_in_their_row(spark):
    from tidebook.operators import book

    edges = book.log_bin_edges(20, 0.5, 4.0)
    rows = [(1, [[-9.0, 2.0], [0.1, 1.0], [0.2, 3.0], [3.9, 4.0]]), (2, []), (3, None), (4, [[9.0, 5.0], [float("nan"), 1.0], [0.3, -1.0]])]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>")
    got = {r.id: r.bins for r in book.with_bins(df, "p", 20, 0.5, 4.0).select("id", book.dense_bins("binned", 21).alias("bins")).collect()}
    for i, p in rows:
        want = np.zeros(21)
        for z, v in p or []:
            if z == z and v > 0:
                want[min(sum(e <= z for e in edges) - 1, 20)] += v
        assert np.allclose(got[i], want / want.sum() if want.sum() else want) and len(got[i]) == 21
