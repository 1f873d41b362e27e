"""Trading accounts from a table of positions and targets: per step, per episode, per day; no policy, no loop over steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import frames

#: Fee regimes of the account: name, fee per unit of position change (negative: a rebate), whether the position is held at one.
REGIMES = (("buy_and_hold", 0.0, True), ("maker", 0.0, False), ("taker", 0.001, False), ("rebate", -0.00025, False))
VOL_ROWS, VOL_LEAST, VOL_DEFAULT, VOL_FLOOR = 30, 5, 0.002, 1e-5
EPISODE = ["symbol", "episode"]


def episodes(df: DataFrame, by: list[str], order: list[str], day: Column, fold: Column, length: int = 120) -> DataFrame:
    """parent (day and fold run), chunk, t: rows by calendar day, broken where the fold changes, then cut into chunks of a length."""
    x = df.withColumn("day", day).withColumn("_f", fold)
    w = Window.partitionBy(*by, "day").orderBy(*order)
    x = x.withColumn("_new", F.coalesce((F.col("_f") != F.lag("_f").over(w)).cast("int"), F.lit(0)))
    x = x.withColumn("run", F.sum("_new").over(w))
    k = F.row_number().over(Window.partitionBy(*by, "day", "run").orderBy(*order)) - 1
    return x.withColumn("_k", k).withColumn("chunk", F.floor(F.col("_k") / length).cast("int")).withColumn("t", (F.col("_k") % length).cast("int")).drop("_f", "_new", "_k")


def step_window(by: list[str] = EPISODE, order: str = "t"):
    return Window.partitionBy(*by).orderBy(order)


def valid_steps(df: DataFrame, lookback: int, horizon: int, by: list[str] = EPISODE) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_n", n).where((F.col("t") >= lookback) & (F.col("t") < F.col("_n") - horizon)).drop("_n")


def target_sum(horizon: int, by: list[str] = EPISODE) -> Column:
    """Sum of the next targets, fewer at the episode's end; 0 after the last."""
    return F.coalesce(F.sum("target").over(step_window(by).rowsBetween(1, horizon)), F.lit(0.0))


def with_pnl(df: DataFrame, fee: float = 0.001, by: list[str] = EPISODE) -> DataFrame:
    """gross, cost, reward of each step; a change below 1e-8 costs nothing."""
    x = df.withColumn("change", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(step_window(by))))
    x = x.withColumn("gross", F.col("position") * F.col("target")).withColumn("cost", F.when(F.col("change") > 1e-8, fee * F.col("change")).otherwise(0.0))
    return x.withColumn("reward", F.col("gross") - F.col("cost"))


def fee_regimes(df: DataFrame, by: list[str] = EPISODE) -> DataFrame:
    """The steps once per regime: regime, raw return."""
    x = df.withColumn("change", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(step_window(by))))
    rows = [F.struct(F.lit(n).alias("regime"), (F.col("target") if hold else F.col("position") * F.col("target") - fee * F.col("change")).alias("ret")) for n, fee, hold in REGIMES]
    return x.select(*df.columns, F.inline(F.array(*rows)))


def realised_vol(horizon: int = 1, half_life: float = 10.0, by: list[str] = EPISODE) -> Column:
    """Exponentially weighted volatility of the last 31 targets, taken newest first (so the oldest ends up with the most weight)."""
    alpha = 1 - 2 ** (-1 / half_life)
    seen = F.collect_list("target").over(step_window(by).rowsBetween(-VOL_ROWS, 0))
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
    start = F.aggregate(seen, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(seen)
    var = F.aggregate(F.reverse(seen), start, lambda v, x: (1 - alpha) * v + alpha * x * x)
    return F.greatest(F.when(F.size(seen) < VOL_LEAST, VOL_DEFAULT).otherwise(F.sqrt(var)), F.lit(VOL_FLOOR)) * horizon**0.5


def directional_bonus(size: float = 2e-6) -> Column:
    p, y = F.col("position"), F.col("target")
    return F.when(F.abs(p) < 1e-6, 0.0).when(p * y > 0, size * F.abs(p)).when(p * y < 0, -size * F.abs(p)).otherwise(0.0)


def episode_metrics(df: DataFrame, by: list[str] = EPISODE, fee: float = 0.001) -> DataFrame:
    """One row per episode: realised and net P&L, cost, P&L over cost, trades and their share of steps, range of running P&L, drawdown, exposure, uncertainty, and the return of each fee regime."""
    w = step_window(by)
    x = with_pnl(df, fee, by)
    x = x.withColumn("realised", F.coalesce(F.lag("position").over(w) * F.lag("target").over(w), F.lit(0.0)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("net", F.sum(F.col("realised") - F.col("cost")).over(upto))
    x = x.withColumn("peak", F.max("net").over(upto))
    regimes = {n: F.sum(F.col("target") if hold else F.col("gross") - own * F.col("change")).alias(n) for n, own, hold in REGIMES}
    out = x.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.sum("realised").alias("realised_pnl"),
        F.sum("cost").alias("total_cost"),
        F.sum(F.col("realised") - F.col("cost")).alias("net_pnl"),
        F.count_if(F.col("change") > 0.01).alias("trades"),
        (F.max("net") - F.min("net")).alias("max_drawdown"),
        F.max(F.col("peak") - F.col("net")).alias("true_drawdown"),
        F.max(F.abs("position")).alias("max_position"),
        F.avg(F.abs("position")).alias("mean_position"),
        F.sum("reward").alias("total_reward"),
        F.avg("position_std").alias("mean_std"),
        F.min("position_std").alias("min_std"),
        F.max("position_std").alias("max_std"),
        *regimes.values(),
    )
    return out.withColumns({"pnl_per_cost": F.when(F.col("total_cost") > 1e-12, F.col("net_pnl") / F.col("total_cost")).otherwise(0.0), "trade_frequency": F.col("trades") / F.col("steps")})


def sharpe(ret: str, annualise: float | None = None) -> Column:
    """Mean over population deviation of an aggregate; fewer than two values or hardly any spread: 0."""
    s = F.stddev_pop(ret)
    out = F.when((F.count(ret) < 2) | (s < 1e-8), 0.0).otherwise(F.try_divide(F.avg(ret), s))
    return out * annualise**0.5 if annualise else out


def sequences(df: DataFrame, by: list[str], order: list[str], length: int, column: str, bucket: Column, stride: int | None = None) -> DataFrame:
    """Runs of a fixed length as arrays in order, one every ``stride`` rows (end to end where it isn't given); incomplete ones are dropped. bucket grows with the order."""
    stride = stride or length
    x = frames.ranked(df, by, order, bucket, "_k")
    first, last = F.greatest(F.ceil((F.col("_k") - length + 1) / stride), F.lit(0)), F.floor(F.col("_k") / stride)
    x = x.where(first <= last).withColumn("seq", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    x = x.groupBy(*by, "seq").agg(F.array_sort(F.collect_list(F.struct("_k", column))).alias("_s"))
    return x.where(F.size("_s") == length).select(*by, "seq", F.transform("_s", lambda s: s[column]).alias(column))
