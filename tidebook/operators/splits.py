"""Purged and embargoed combinatorial cross-validation: timeline, folds, splits, ranges, and rows' roles.

Folds, splits and ranges are small tables by nature (tens of rows); rows meet them by range joins that stay map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.frames import ranked


def timeline(df: DataFrame, test_ratio: float = 0.2, embargo: int = 20, warmup: int = 20, horizon: int = 20, us: str = "us") -> DataFrame:
    """us, idx, n, part of every distinct time: warmup, train, embargo, test, horizon by position.

    Positions come from counts per hour and ranks inside the hours, not from one sorted task.
    """
    x = ranked(df.select(us).distinct(), [], [us], F.expr(f"{us} div 3600000000"))
    x = x.crossJoin(x.agg(F.count("*").alias("n")))
    start = F.floor(F.col("n") * (1 - test_ratio))
    n_train, n_test = start - embargo, F.col("n") - start
    part = (
        F.when(F.col("idx") >= start, F.when((n_test > horizon) & (F.col("idx") >= F.col("n") - horizon), "test_horizon").otherwise("test"))
        .when(F.col("idx") >= n_train, "embargo")
        .when((n_train > warmup) & (F.col("idx") < warmup), "train_warmup")
        .otherwise("train")
    )
    return x.select(us, "idx", "n", part.alias("part"))


def folds(line: DataFrame, n_folds: int = 8, us: str = "us") -> DataFrame:
    """fold_id, fold_type, start_us, end_us, n_samples: warm-up, equal train folds (the last takes the rest), then the other parts."""
    own = F.col("part") == "train"
    bounds = line.agg(F.min(F.when(own, F.col("idx"))).alias("first"), F.count_if(own).alias("n_train"), F.count_if(F.col("part") == "train_warmup").alias("n_warm"))
    x = line.crossJoin(F.broadcast(bounds))
    inside = F.least(F.floor((F.col("idx") - F.col("first")) / F.floor(F.col("n_train") / n_folds)), F.lit(n_folds - 1))
    after = {"embargo": n_folds + 1, "test": n_folds + 2, "test_horizon": n_folds + 3}
    fold = F.when(F.col("part") == "train_warmup", 0).when(own, inside + 1)
    for k, v in after.items():
        fold = fold.when(F.col("part") == k, v)
    x = x.groupBy(fold.cast("int").alias("fold_id"), F.col("part").alias("fold_type")).agg(F.min(us).alias("start_us"), F.count("*").alias("n_samples"))
    nxt = F.lead("start_us").over(Window.orderBy("start_us"))
    return x.select("fold_id", "fold_type", "start_us", F.coalesce(nxt, F.col("start_us") + 86_400_000_000).alias("end_us"), "n_samples")


def cpcv_splits(fold_table: DataFrame, k: int = 2) -> DataFrame:
    """split_id, v1..vk: all combinations of k train folds in lexical order."""
    train = fold_table.where("fold_type = 'train'").select(F.col("fold_id").alias("v1"))
    x = train
    for i in range(2, k + 1):
        x = x.join(train.select(F.col("v1").alias(f"v{i}")), F.col(f"v{i}") > F.col(f"v{i - 1}"))
    return x.withColumn("split_id", F.row_number().over(Window.orderBy(*[f"v{i}" for i in range(1, k + 1)])) - 1)


def validation_folds(splits: DataFrame) -> DataFrame:
    """split_id, fold_id of the validation folds."""
    return splits.select("split_id", F.explode(F.array(*[c for c in splits.columns if c != "split_id"])).alias("fold_id"))


def ranges(fold_table: DataFrame, splits: DataFrame, purge_us: int, embargo_us: int) -> DataFrame:
    """split_id, fold_id, kind, start_us, end_us: the parts of non-validation train folds before (purge) and after (embargo) each validation fold."""
    val = validation_folds(splits).join(fold_table.select("fold_id", "start_us", "end_us"), "fold_id")
    stack = val.select("split_id", F.explode(F.array(F.struct(F.lit("purge").alias("kind"), (F.col("start_us") - purge_us).alias("lo"), F.col("start_us").alias("hi")), F.struct(F.lit("embargo").alias("kind"), F.col("end_us").alias("lo"), (F.col("end_us") + embargo_us).alias("hi")))).alias("r")).select("split_id", "r.*")
    own = validation_folds(splits).withColumnRenamed("fold_id", "vf")
    train = fold_table.where("fold_type = 'train'").select("fold_id", "start_us", "end_us")
    x = stack.join(train, (F.col("lo") < F.col("end_us")) & (F.col("hi") > F.col("start_us")))
    x = x.join(own.withColumnRenamed("split_id", "s"), (F.col("s") == F.col("split_id")) & (F.col("vf") == F.col("fold_id")), "left_anti")
    return x.select("split_id", "fold_id", "kind", F.greatest("lo", "start_us").alias("start_us"), F.least("hi", "end_us").alias("end_us"))


def assign_folds(df: DataFrame, fold_table: DataFrame, us: str = "us") -> DataFrame:
    """fold_id and fold_type by half-open ranges; rows in none are -1, excluded."""
    f = fold_table.select(F.col("fold_id").alias("_f"), "fold_type", F.col("start_us").alias("_a"), F.col("end_us").alias("_b"))
    x = df.join(F.broadcast(f), (F.col(us) >= F.col("_a")) & (F.col(us) < F.col("_b")), "left")
    return x.withColumn("fold_id", F.coalesce("_f", F.lit(-1))).withColumn("fold_type", F.coalesce("fold_type", F.lit("excluded"))).drop("_f", "_a", "_b")


def plan_of(splits: DataFrame, range_table: DataFrame) -> DataFrame:
    """One row: all splits with their validation folds and ranges as arrays, so that roles need no shuffle of rows."""
    r = range_table.groupBy("split_id").agg(F.collect_list(F.struct("kind", "start_us", "end_us")).alias("ranges"))
    v = validation_folds(splits).groupBy("split_id").agg(F.collect_list("fold_id").alias("val"))
    x = v.join(r, "split_id", "left").select("split_id", "val", F.coalesce("ranges", F.array()).alias("ranges"))
    return x.agg(F.array_sort(F.collect_list(F.struct("split_id", "val", "ranges"))).alias("plan"))


def role(split, us: str = "us") -> Column:
    """Role of a row of assign_folds in one split of the plan: purged, embargoed, validation, train in this order; other fold types as they are."""
    hit = lambda kind: F.exists(split["ranges"], lambda r: (r["kind"] == kind) & (F.col(us) >= r["start_us"]) & (F.col(us) < r["end_us"]))
    inside = F.when(hit("purge"), "purged").when(hit("embargo"), "embargoed").when(F.array_contains(split["val"], F.col("fold_id")), "validation").otherwise("train")
    return F.when(F.col("fold_type") == "train", inside).otherwise(F.col("fold_type"))


def pieces(fold_table: DataFrame, splits: DataFrame, range_table: DataFrame) -> DataFrame:
    """The time axis cut at all bounds of folds and ranges: lo, hi, fold_id, fold_type, split_roles. Some hundred rows, whatever the data."""
    bounds = lambda t: t.select(F.explode(F.array("start_us", "end_us")).alias("lo"))
    cuts = bounds(fold_table).union(bounds(range_table)).distinct().withColumn("hi", F.lead("lo").over(Window.orderBy("lo"))).where("hi IS NOT NULL")
    x = assign_folds(cuts, fold_table, "lo").crossJoin(F.broadcast(plan_of(splits, range_table)))
    return x.withColumn("split_roles", _roles("lo")).drop("plan")


def _roles(us: str) -> Column:
    return F.map_from_arrays(F.transform("plan", lambda s: s["split_id"].cast("string")), F.transform("plan", lambda s: role(s, us)))


def with_roles(df: DataFrame, cut: DataFrame, splits: DataFrame, us: str = "us", bucket_us: int = 3_600_000_000) -> DataFrame:
    """fold_id, fold_type and split_roles map<split_id, role> of each row: one lookup in the pieces, which are dealt by hours.

    Rows meet the pieces of their hour by a hash join; there are as many as hours and cuts, and they are broadcast where
    Spark finds them small. Rows in no piece are excluded in every split.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    own = cut.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "fold_id", "fold_type", "split_roles", F.explode(F.sequence(bucket("lo"), F.floor((F.col("hi") - 1) / bucket_us))).alias("_h"))
    x = df.join(own, (bucket(us) == F.col("_h")) & (F.col(us) >= F.col("_lo")) & (F.col(us) < F.col("_hi")), "left")
    ids = splits.agg(F.array_sort(F.collect_list("split_id")).alias("_ids"))
    none = F.map_from_arrays(F.transform("_ids", lambda s: s.cast("string")), F.transform("_ids", lambda s: F.lit("excluded")))
    x = x.crossJoin(F.broadcast(ids)).withColumn("split_roles", F.coalesce("split_roles", none))
    return x.withColumns({"fold_id": F.coalesce("fold_id", F.lit(-1)), "fold_type": F.coalesce("fold_type", F.lit("excluded"))}).drop("_lo", "_hi", "_h", "_ids")


def role_rows(df: DataFrame) -> DataFrame:
    x = df.select("*", F.explode("split_roles").alias("split_id", "role")).drop("split_roles")
    return x.withColumn("split_id", F.col("split_id").cast("int"))


KEPT = ("train", "train_warmup", "validation")


def materialised(df: DataFrame) -> DataFrame:
    """Rows of each split with a role that is used, to be written partitioned by split_id."""
    return role_rows(df).where(F.col("role").isin(*KEPT))


def test_rows(df: DataFrame) -> DataFrame:
    """Rows that are test in any split, once."""
    return df.where(F.exists(F.map_values("split_roles"), lambda r: r == "test")).withColumn("role", F.lit("test"))


def representative_windows(fold_table: DataFrame, splits: DataFrame, length: int, margin: int, seed: int) -> DataFrame:
    """A pseudo-random window of positions in each (split, train fold), away from its ends; folds too short are left out."""
    val = validation_folds(splits)
    x = splits.select("split_id").crossJoin(fold_table.where("fold_type = 'train'").select("fold_id", "start_us", "end_us", "n_samples")).join(val, ["split_id", "fold_id"], "left_anti")
    x = x.where(F.col("n_samples") >= 2 * margin + length)
    room = F.col("n_samples") - 2 * margin - length + 1
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("split_id").cast("string"), F.col("fold_id").cast("string"))), 1, 8), 16, 10).cast("long")
    start = margin + digest % room
    return x.select("split_id", "fold_id", start.alias("start_idx"), (start + length).alias("end_idx"))


def window_times(windows: DataFrame, fold_table: DataFrame, line: DataFrame, us: str = "us") -> DataFrame:
    """Windows of positions in their folds with the times of their first row and of the row after their last: start_us, end_us (half-open)."""
    at = lambda name, to: line.select(F.col(us).alias(to), F.col("idx").alias(name))
    first = F.broadcast(fold_table.select("fold_id", "start_us")).join(at("_first", "start_us"), "start_us").select("fold_id", "_first")
    x = windows.join(first, "fold_id").withColumns({"_from": F.col("_first") + F.col("start_idx"), "_to": F.col("_first") + F.col("end_idx")})
    x = F.broadcast(x).join(at("_from", "start_us"), "_from")
    return F.broadcast(x).join(at("_to", "end_us"), "_to").drop("_first", "_from", "_to")


def rows_of_windows(df: DataFrame, windows: DataFrame, us: str = "us", bucket_us: int = 3_600_000_000) -> DataFrame:
    """The rows of each window, which may share rows, with the window's columns: rows meet the windows of their hour by a hash join."""
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    own = windows.withColumn("_h", F.explode(F.sequence(bucket("start_us"), F.floor((F.col("end_us") - 1) / bucket_us))))
    x = df.join(own, (bucket(us) == F.col("_h")) & (F.col(us) >= F.col("start_us")) & (F.col(us) < F.col("end_us")))
    return x.drop("_h")
