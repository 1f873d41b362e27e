"""Queries of episodes, sequences and trading accounts: positions are sin(event_id), targets the next log returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import frames
from tidebook.operators import trading as t
from tidebook.plans import fixtures as fx
from tidebook.plans.registry import query

LEN = 40


def positions(spark, sf):
    """event_id, symbol, day, run, chunk, episode, t, position, position_std, target; folds change every 90 hours."""
    x = frames.lagged(frames.ranked(fx.series(spark, sf), ["symbol"], ["us", "event_id"], F.col("hour"), "idx"), ["symbol"], "idx", {"later": ("log_mid", -1)})
    x = x.withColumn("target", F.coalesce(F.col("later") - F.col("log_mid"), F.lit(0.0))).drop("idx", "later")
    x = x.withColumn("position", scalar.sin("event_id")).withColumn("position_std", 0.1 + (F.col("event_id") % 10) / 10.0)
    x = t.episodes(x, ["symbol"], ["us", "event_id"], F.expr("hour div 24"), F.expr("hour div 90"), LEN)
    return x.withColumn("episode", F.concat_ws("-", "day", "run", "chunk"))


P = f"""{fx.ctes("series")}, p0 AS (SELECT *, hour // 24 AS day, hour // 90 AS f, coalesce(ln(lead(mid) OVER (PARTITION BY symbol ORDER BY us, event_id)) - ln(mid), 0) AS target, sin(event_id) AS position, 0.1 + (event_id % 10) / 10.0 AS position_std FROM series),
p1 AS (SELECT *, coalesce((f <> lag(f) OVER w)::INT, 0) AS nw FROM p0 WINDOW w AS (PARTITION BY symbol, day ORDER BY us, event_id)), p2 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, run ORDER BY us, event_id) - 1 AS k FROM p2),
pos AS (SELECT event_id, symbol, us, hour, day, run::BIGINT AS run, (k // {LEN})::INT AS chunk, (k % {LEN})::INT AS t, day || '-' || run || '-' || (k // {LEN}) AS episode, position, position_std, target FROM p3)"""
W = "(PARTITION BY symbol, episode ORDER BY t)"


@query("episodes", f"{P} SELECT event_id, day, run, chunk, t FROM pos")
def episodes(spark, sf):
    return positions(spark, sf).select("event_id", "day", F.col("run").cast("long").alias("run"), "chunk", "t")


@query("episodes_synthetic", f"{P}, sq AS (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1) // 120 AS sequence_id FROM pos) SELECT symbol, sequence_id, count(*) AS n, CASE WHEN sequence_id < 80 THEN 'train' ELSE 'val' END AS phase, count(*) <> 120 AS odd_length FROM sq GROUP BY ALL")
def episodes_synthetic(spark, sf):
    x = frames.ranked(fx.events(spark, sf), ["symbol"], ["us", "event_id"], F.col("hour"), "k").groupBy("symbol", F.expr("cast(k div 120 as bigint)").alias("sequence_id")).agg(F.count("*").alias("n"))
    return x.select("symbol", "sequence_id", "n", F.when(F.col("sequence_id") < 80, "train").otherwise("val").alias("phase"), (F.col("n") != 120).alias("odd_length"))


@query("valid_steps", f"{P}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol, episode) AS n FROM pos) SELECT event_id, t FROM c WHERE t >= 5 AND t < n - 3")
def valid_steps(spark, sf):
    return t.valid_steps(positions(spark, sf), 5, 3).select("event_id", "t")


@query("observation_window", f"{P} SELECT event_id, count(position) OVER v AS n, round(coalesce(sum(position) OVER v, 0), 8) AS total, first_value(event_id) OVER v AS oldest FROM pos WINDOW v AS (PARTITION BY symbol, episode ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def observation_window(spark, sf):
    seen = F.collect_list(F.struct("event_id", "position")).over(t.step_window().rowsBetween(-5, -1))
    x = positions(spark, sf).withColumn("seen", seen)
    return x.select("event_id", F.size("seen").cast("long").alias("n"), F.round(F.aggregate("seen", F.lit(0.0), lambda a, s: a + s["position"]), 8).alias("total"), F.try_element_at("seen", F.lit(1))["event_id"].alias("oldest"))


@query("target_hstep", f"{P} SELECT event_id, round(coalesce(sum(target) OVER (PARTITION BY symbol, episode ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0), 8) AS target_3 FROM pos")
def target_hstep(spark, sf):
    return positions(spark, sf).select("event_id", F.round(t.target_sum(3), 8).alias("target_3"))


@query("sequences_fixed", f"{P}, sq AS (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1 AS k FROM pos) SELECT symbol, (k // 120)::INT AS seq, min(event_id) AS first, max(event_id) AS last, sum(event_id)::BIGINT AS total FROM sq GROUP BY symbol, k // 120 HAVING count(*) = 120")
def sequences_fixed(spark, sf):
    x = t.sequences(fx.events(spark, sf), ["symbol"], ["us", "event_id"], 120, "event_id", F.col("hour"))
    return x.select("symbol", "seq", F.array_min("event_id").alias("first"), F.array_max("event_id").alias("last"), F.aggregate("event_id", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(
    "sequences_strided",
    f"{P}, sq AS (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY us, event_id) - 1 AS k FROM pos), st AS (SELECT symbol, event_id, unnest(range(greatest(0, (k - 120 + 30) // 30), k // 30 + 1)) AS seq FROM sq WHERE k >= 0) "
    "SELECT symbol, seq::INT AS seq, min(event_id) AS first, max(event_id) AS last, sum(event_id)::BIGINT AS total FROM st GROUP BY ALL HAVING count(*) = 120",
)
def sequences_strided(spark, sf):
    """Sequences of 120, one every 30 rows."""
    x = t.sequences(fx.events(spark, sf), ["symbol"], ["us", "event_id"], 120, "event_id", F.col("hour"), 30)
    return x.select("symbol", "seq", F.array_min("event_id").alias("first"), F.array_max("event_id").alias("last"), F.aggregate("event_id", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("sequence_count", f"{fx.ctes('split_long')} SELECT split_id, role, (count(*) // 120)::BIGINT AS n FROM split_long WHERE feature = 'level' GROUP BY ALL")
def sequence_count(spark, sf):
    return fx.split_long(spark, sf).where("feature = 'level'").groupBy("split_id", "role").agg(F.floor(F.count("*") / 120).alias("n"))


PNL = f"{P}, ch AS (SELECT *, abs(position - lag(position, 1, 0.0) OVER {W}) AS change FROM pos), pl AS (SELECT *, position * target AS gross, CASE WHEN change > 1e-8 THEN 0.001 * change ELSE 0.0 END AS cost FROM ch)"


@query("pnl_step", f"{PNL} SELECT event_id, round(gross, 9) AS gross, round(cost, 9) AS cost, round(gross - cost, 9) AS reward FROM pl")
def pnl_step(spark, sf):
    return t.with_pnl(positions(spark, sf)).select("event_id", *[scalar.rounded(c, 9).alias(c) for c in ("gross", "cost", "reward")])


REG = f"{PNL}, rg AS (" + " UNION ALL ".join(f"SELECT event_id, symbol, day, episode, t, position, position_std, change, '{n}' AS regime, {'target' if hold else f'position * target - {fee!r}::DOUBLE * change'} AS ret FROM ch" for n, fee, hold in t.REGIMES) + ")"


@query("pnl_fee_scenarios", f"{REG} SELECT event_id, regime, round(ret, 9) AS ret FROM rg")
def pnl_fee_scenarios(spark, sf):
    return t.fee_regimes(positions(spark, sf)).select("event_id", "regime", scalar.rounded("ret", 9).alias("ret"))


_A = 1 - 2 ** (-1 / 10.0)
VOL = f"""{PNL}, sn AS (SELECT *, list(target) OVER (PARTITION BY symbol, episode ORDER BY t ROWS BETWEEN {t.VOL_ROWS} PRECEDING AND CURRENT ROW) AS s FROM pl), vm AS (SELECT *, list_sum(s) / len(s) AS m FROM sn),
vv AS (SELECT *, list_sum(list_transform(s, lambda x: (x - m) * (x - m))) / len(s) AS v0 FROM vm),
vl AS (SELECT *, greatest(CASE WHEN len(s) < {t.VOL_LEAST} THEN {t.VOL_DEFAULT} ELSE sqrt(list_reduce(list_concat([v0], list_reverse(s)), lambda v, x: {1 - _A!r}::DOUBLE * v + {_A!r}::DOUBLE * x * x)) END, {t.VOL_FLOOR}) AS vol,
 CASE WHEN abs(position) < 1e-6 THEN 0.0 WHEN position * target > 0 THEN 2e-6 * abs(position) WHEN position * target < 0 THEN -2e-6 * abs(position) ELSE 0.0 END AS bonus FROM vv)"""


@query("ewma_vol_reward", f"{VOL} SELECT event_id, round(vol, 7) AS vol FROM vl")
def ewma_vol_reward(spark, sf):
    return positions(spark, sf).select("event_id", F.round(t.realised_vol(), 7).alias("vol"))


@query("directional_bonus", f"{VOL} SELECT event_id, round(bonus * 1000000, 6) AS bonus_ppm FROM vl")
def directional_bonus(spark, sf):
    return positions(spark, sf).select("event_id", F.round(t.directional_bonus() * 1000000, 6).alias("bonus_ppm"))


@query("reward_scaled", f"{VOL} SELECT event_id, round((gross - cost + bonus) / vol, 5) AS reward FROM vl")
def reward_scaled(spark, sf):
    x = t.with_pnl(positions(spark, sf))
    # a column of its own: inside the rounding, which names it several times, it would be worked out as often
    x = x.select("event_id", ((F.col("reward") + t.directional_bonus()) / t.realised_vol()).alias("reward"))
    return x.select("event_id", scalar.rounded("reward", 5).alias("reward"))


EPI = f"""{PNL}, rl AS (SELECT *, coalesce(lag(position) OVER {W} * lag(target) OVER {W}, 0) AS realised FROM pl), nt AS (SELECT *, sum(realised - cost) OVER (PARTITION BY symbol, episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS net FROM rl), pk AS (SELECT *, max(net) OVER (PARTITION BY symbol, episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM nt),
em AS (SELECT symbol, episode, any_value(day) AS day, count(*) AS steps, sum(realised) AS realised_pnl, sum(cost) AS total_cost, sum(realised - cost) AS net_pnl, sum((change > 0.01)::INT)::BIGINT AS trades, max(net) - min(net) AS max_drawdown, max(peak - net) AS true_drawdown, max(abs(position)) AS max_position, avg(abs(position)) AS mean_position, sum(gross - cost) AS total_reward, avg(position_std) AS mean_std, min(position_std) AS min_std, max(position_std) AS max_std, {', '.join(f"sum({'target' if hold else f'gross - {fee!r}::DOUBLE * change'}) AS {n}" for n, fee, hold in t.REGIMES)}, CASE WHEN sum(cost) > 1e-12 THEN sum(realised - cost) / sum(cost) ELSE 0.0 END AS pnl_per_cost, sum((change > 0.01)::INT) / count(*)::DOUBLE AS trade_frequency FROM pk GROUP BY symbol, episode)"""
_M = ("realised_pnl", "total_cost", "net_pnl", "max_drawdown", "true_drawdown", "max_position", "mean_position", "total_reward", "mean_std", "min_std", "max_std", "trade_frequency", *(n for n, _, _ in t.REGIMES))


@query("episode_metrics", f"{EPI} SELECT symbol, episode, steps, trades, round(pnl_per_cost, 5) AS pnl_per_cost, {', '.join(f'round({c}, 8) AS {c}' for c in _M)} FROM em")
def episode_metrics(spark, sf):
    return t.episode_metrics(positions(spark, sf)).select("symbol", "episode", "steps", "trades", F.round("pnl_per_cost", 5).alias("pnl_per_cost"), *[F.round(c, 8).alias(c) for c in _M])


_SH = "CASE WHEN count(total_reward) < 2 OR stddev_pop(total_reward) < 1e-8 THEN 0.0 ELSE avg(total_reward) / stddev_pop(total_reward) END"


@query("sharpe", f"{EPI} SELECT symbol, count(*) AS n, round({_SH}, 6) AS sharpe FROM em GROUP BY symbol")
def sharpe(spark, sf):
    return t.episode_metrics(positions(spark, sf)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(t.sharpe("total_reward"), 6).alias("sharpe"))


@query("epoch_metrics", f"{REG}, er AS (SELECT symbol, episode, regime, sum(ret) AS r FROM rg GROUP BY ALL) SELECT symbol, regime, count(*) AS n, round(avg(r), 7) AS mean, round(stddev_pop(r), 7) AS std, round(CASE WHEN count(r) < 2 OR stddev_pop(r) < 1e-8 THEN 0.0 ELSE avg(r) / stddev_pop(r) END, 6) AS sharpe FROM er GROUP BY ALL")
def epoch_metrics(spark, sf):
    x = t.fee_regimes(positions(spark, sf)).groupBy("symbol", "episode", "regime").agg(F.sum("ret").alias("r"))
    return x.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.round(F.avg("r"), 7).alias("mean"), F.round(F.stddev_pop("r"), 7).alias("std"), F.round(t.sharpe("r"), 6).alias("sharpe"))


@query("day_rollup", f"{REG}, dr AS (SELECT symbol, day, sum(CASE WHEN regime = 'taker' THEN (change > 0.01)::INT END)::BIGINT AS trades, count(*) // {len(t.REGIMES)} AS steps, avg(abs(position)) AS mp, min(position_std) AS min_std, max(position_std) AS max_std, {', '.join(f'sum(CASE WHEN regime = {chr(39)}{n}{chr(39)} THEN ret END) AS {n}' for n, _, _ in t.REGIMES)} FROM rg GROUP BY ALL) SELECT symbol, day, trades, steps, round(mp, 8) AS mean_position, min_std, max_std, {', '.join(f'round({n}, 7) AS {n}' for n, _, _ in t.REGIMES)} FROM dr")
def day_rollup(spark, sf):
    """Episodes rolled up to their day: trades, steps, exposure, net return per regime."""
    x = positions(spark, sf)
    x = x.withColumn("change", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(t.step_window())))
    r = t.fee_regimes(x)
    return r.groupBy("symbol", "day").agg(
        F.count_if((F.col("regime") == "taker") & (F.col("change") > 0.01)).alias("trades"),
        F.expr(f"count(*) div {len(t.REGIMES)}").alias("steps"),
        F.round(F.avg(F.abs("position")), 8).alias("mean_position"),
        F.min("position_std").alias("min_std"),
        F.max("position_std").alias("max_std"),
        *[F.round(F.sum(F.when(F.col("regime") == n, F.col("ret"))), 7).alias(n) for n, _, _ in t.REGIMES],
    )
