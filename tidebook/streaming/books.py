"""Level updates to books: the as-of batch form, and the streaming form with keyed state; online scaling, windows and dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidebook.functions import scalar
from tidebook.operators import frames
from tidebook.sources import tables

L2 = "symbol string, seq long, us long, action string, id long, price double, size double, side string"


def book_asof(updates: DataFrame, grid: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """State of each level id at each grid time: symbol, grid_us, id, price, size, side.

    A partial starts an epoch with an empty book; an insert sets a level; an update changes its size only while the
    level exists; a delete removes it. Levels' lives run from an insert to the next insert or delete of the id in the
    epoch; a grid time takes the life and the last update that it falls into. Lives and grid times meet by buckets of
    time, so that no symbol's rows are paired with all of its grid. updates: symbol, seq, us, action, ...
    """
    # an epoch's number is a running sum over buckets of time, so that no task holds a symbol
    bucket = F.floor(F.col("us") / bucket_us)
    events = frames.running(updates, ["symbol"], ["us", "seq"], bucket, (F.col("action") == "partial").cast("int"), "epoch")
    x = events.where("epoch > 0")
    level = Window.partitionBy("symbol", "epoch", "id").orderBy("us", "seq")
    x = x.withColumn("life", F.sum(F.col("action").isin("partial", "insert", "delete").cast("int")).over(level))
    one = Window.partitionBy("symbol", "epoch", "id", "life").orderBy("us", "seq")
    x = x.withColumn("born", F.first("action").over(one)).where("born IN ('partial', 'insert') AND action <> 'delete'")
    x = x.withColumn("price", F.first("price").over(one)).withColumn("side", F.first("side").over(one))
    # each row holds from its time until the next event of the id or the next epoch's start
    nxt = events.withColumn("until", F.lead("us").over(level)).select("symbol", "id", "us", "seq", "until")
    part = Window.partitionBy("symbol").orderBy("epoch")
    epochs = events.where("epoch > 0").groupBy("symbol", "epoch").agg(F.min("us").alias("_start")).withColumn("epoch_end", F.lead("_start").over(part)).drop("_start")
    x = x.join(nxt, ["symbol", "id", "us", "seq"]).join(epochs, ["symbol", "epoch"])
    x = x.withColumn("until", F.least("until", "epoch_end"))
    last = grid.groupBy("symbol").agg((F.max("grid_us") + 1).alias("_last"))
    x = x.join(last, "symbol").withColumn("until", F.coalesce("until", "_last")).where("until > us")
    x = x.withColumn("_b", F.explode(F.sequence(F.floor(F.col("us") / bucket_us), F.floor((F.col("until") - 1) / bucket_us))))
    g = grid.select("symbol", "grid_us", F.floor(F.col("grid_us") / bucket_us).alias("_b"))
    return x.join(g, ["symbol", "_b"]).where("grid_us >= us AND grid_us < until").select("symbol", "grid_us", "id", "price", "size", "side")


def apply_updates(book: dict[int, tuple[float, float, str]], rows: list[tuple]) -> None:
    """Changes a book in place by (action, id, price, size, side) in order."""
    for action, i, price, size, side in rows:
        if action == "partial":
            book.clear()
        if action in ("partial", "insert"):
            book[i] = (price, size, side)
        elif action == "update" and i in book:
            book[i] = (book[i][0], size, book[i][2])
        elif action == "delete":
            book.pop(i, None)


SNAPSHOT = "symbol string, grid_us long, n_bids int, n_asks int, best_bid double, best_ask double"
#: The action of a row that only moves the watermark.
HEARTBEAT = "heartbeat"


class BookKeeper(StatefulProcessor):
    """A book per key as a map of levels, and a snapshot at every grid time that the watermark has passed.

    Updates wait in state under the grid time that is the first to hold them; when the watermark passes it, they are
    applied in order of (us, seq), whatever order they came in. A timer goes from one grid time to the next, so that a
    quiet key has its snapshots too. Only changed levels are written. There is none before the first partial, nor of an
    empty book.
    """

    LEVEL = "price double, size double, side string"
    WAITING = "us array<long>, seq array<long>, action array<string>, id array<long>, price array<double>, size array<double>, side array<string>"
    FIELDS = ("us", "seq", "action", "id", "price", "size", "side")

    def __init__(self, interval_us: int) -> None:
        self.interval_us = interval_us

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "id long", self.LEVEL)
        self.waiting = handle.getMapState("waiting", "cell long, part long", self.WAITING)
        self.at = handle.getValueState("at", "begun boolean, cell long, parts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun, cell, parts = self.at.get() if self.at.exists() else (False, None, 0)
        for frame in rows:  # chunk by chunk: each goes into state under a number of its own
            frame = frame[frame["action"] != HEARTBEAT]
            for own, part in frame.groupby(-(-frame["us"] // self.interval_us)):
                self.waiting.updateValue((int(own), parts), tuple(part[c].tolist() for c in self.FIELDS))
                parts += 1
                if cell is None or own < cell:
                    cell = int(own)
                    self.handle.registerTimer(self._ms(cell))
        if cell is not None:
            self.at.update((begun, cell, parts))
        yield pd.DataFrame(columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun, cell, parts = self.at.get()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.interval_us
        if self._ms(cell) != expiredTimerInfo.getExpiryTimeInMs() or cell > passed:
            return
        book = {k[0]: tuple(v) for k, v in self.levels.iterator()}
        due: dict[int, list[int]] = {}
        for own, part in self.waiting.keys():
            if own <= passed:
                due.setdefault(own, []).append(part)
        before, out = dict(book), []
        figures: tuple | None = None
        for t in range(cell, passed + 1):
            for _, _, action, i, price, size, side in sorted(self._taken(t, due.get(t, ()))):
                begun = begun or action == "partial"
                if begun:
                    apply_updates(book, [(action, i, price, size, side)])
            if book:
                if t in due or figures is None:
                    bids, asks = ([v[0] for v in book.values() if v[2] == s] for s in ("Buy", "Sell"))
                    figures = len(bids), len(asks), max(bids, default=None), min(asks, default=None)
                out.append((key[0], t * self.interval_us, *figures))
        for i in before.keys() - book.keys():
            self.levels.removeKey((i,))
        for i, level in book.items():
            if before.get(i) != level:
                self.levels.updateValue((i,), level)
        self.at.update((begun, passed + 1, parts))
        self.handle.registerTimer(self._ms(passed + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    def _taken(self, cell: int, parts) -> list[tuple]:
        """The updates that wait under a grid time, which leave the state: only one grid time's are in memory at once."""
        out: list[tuple] = []
        for part in parts:
            out.extend(zip(*self.waiting.getValue((cell, part)), strict=True))
            self.waiting.removeKey((cell, part))
        return out

    def _ms(self, cell: int) -> int:
        return cell * self.interval_us // 1000

    def close(self) -> None:
        pass


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def snapshots(updates: DataFrame, interval_us: int = 30_000_000, lateness: str = "1 minute") -> DataFrame:
    """Streaming: snapshots of every key's book at all grid times up to the watermark; updates may come in any order within ``lateness``.

    A snapshot holds the updates up to and at its time; a heartbeat row after the last update lets the last ones out.
    Sets the session's state store to the one that map state and timers need. Grid times are whole milliseconds.
    """
    updates.sparkSession.conf.set(*ROCKS)
    x = updates.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    return x.groupBy("symbol").transformWithStateInPandas(BookKeeper(interval_us), SNAPSHOT, "Append", "EventTime")


def ewma_carried(u: DataFrame, by: list[str], idx: str, value: str, state: DataFrame, half_life: float, block: int = 256) -> DataFrame:
    """by, idx, m, v: exponentially weighted mean and variance after each value (idx 0, 1, ... by key), going on from ``state`` (by, m0, v0).

    A block of values is an affine map of what comes before it: with b = beta^n it takes (m, v) to
    m' = c + s1 + b (m - c), v' = s2 + b (v + (m - c)^2) - (m' - c)^2, where s1 and s2 are the block's own weighted
    sums of x - c and its square, c the block's first value. Maps compose in order; no task holds more than a block or
    the few block ends whose weight still counts.
    """
    alpha = 1 - 2 ** (-1 / half_life)
    beta = 1 - alpha
    x = u.withColumn("_blk", F.floor(F.col(idx) / block)).withColumn("_j", F.col(idx) % block)
    w = Window.partitionBy(*by, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_c", F.first(value).over(w)).withColumn("_d", F.col(value) - F.col("_c"))
    weight = alpha * F.pow(F.lit(beta), -F.col("_j"))
    for name, term in (("_s1", F.col("_d")), ("_s2", F.col("_d") * F.col("_d"))):
        x = x.withColumn(name, F.sum(weight * term).over(w) * F.pow(F.lit(beta), F.col("_j")))

    def after(m, v, c, s1, s2, b):
        d = s1 + b * (m - c)
        return c + d, F.greatest(s2 + b * (v + (m - c) * (m - c)) - d * d, F.lit(0.0))

    ends = x.groupBy(*by, "_blk").agg(F.count("*").alias("n"), *[F.max_by(f"_{k}", idx).alias(k) for k in ("c", "s1", "s2")]).join(state, by, "left")
    reach = frames._reach(beta, block)
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(-reach, -1)
    ends = ends.withColumn("_e", F.collect_list(F.struct("n", "c", "s1", "s2")).over(earlier))
    # what a window's oldest map starts from has no weight left, unless it is the state itself
    first = F.coalesce(F.get("_e", F.lit(0))["c"], F.col("c"))
    start = F.struct(F.coalesce("m0", first).alias("m"), F.coalesce("v0", F.lit(0.0)).alias("v"))

    def compose(a, e):
        m, v = after(a["m"], a["v"], e["c"], e["s1"], e["s2"], F.pow(F.lit(beta), e["n"]))
        return F.struct(m.alias("m"), v.alias("v"))

    ends = ends.select(*by, "_blk", F.aggregate("_e", start, compose).alias("_in"))
    x = x.join(ends, [*by, "_blk"])
    m, v = after(F.col("_in.m"), F.col("_in.v"), F.col("_c"), F.col("_s1"), F.col("_s2"), F.pow(F.lit(beta), F.col("_j") + 1))
    return x.select(*by, idx, m.alias("m"), v.alias("v"))


class OnlineScaler:
    """foreachBatch: z-scores of rows in event order; only rows whose ``moves`` holds move their key's state (n, m, v).

    The state is a small table, one version a batch, so that a batch that is run again starts from what it started from
    before and writes the same. Inside a batch a key's rows are spread by blocks.
    """

    def __init__(self, path: str, by: list[str], moves: str, order: list[str], half_life: float = 20, bucket: str = "us div 3600000000") -> None:
        self.path, self.by, self.moves, self.order, self.half_life, self.bucket = path, by, moves, order, half_life, bucket

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, by = batch.sparkSession, self.by
        types = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in by)
        state = spark.read.schema(f"{types}, n0 long, m0 double, v0 double")
        state = state.parquet(f"{self.path}/state/{batch_id}") if batch_id else spark.createDataFrame([], f"{types}, n0 long, m0 double, v0 double")
        x = frames.running(batch.where("value IS NOT NULL").withColumn("upd", F.expr(self.moves)), by, self.order, F.expr(self.bucket), F.col("upd").cast("long"), "k")
        x = tables.stored(x, "scaler")
        u = x.where("upd").select(*by, (F.col("k") - 1).alias("idx"), "value")
        s = tables.stored(ewma_carried(u, by, "idx", "value", state, self.half_life).withColumn("k", F.col("idx") + 1).drop("idx"), "scaled")
        y = x.join(s, [*by, "k"], "left").join(state, by, "left")
        n, m, v = F.coalesce("n0", F.lit(0)) + F.col("k"), F.coalesce("m", "m0"), F.coalesce("v", "v0")
        y = y.withColumns({"_n": n, "_m": m, "_v": v})
        z = F.when(F.col("_n") == 0, F.col("value")).when((F.col("_n") == 1) & F.col("upd"), 0.0).otherwise(F.expr(scalar.zscore_clip("value", "_m", "_v")))
        y.withColumn("z", z).drop("k", "upd", "n0", "m0", "v0", "m", "v", "_n", "_m", "_v").write.mode("overwrite").parquet(f"{self.path}/out/{batch_id}")
        last = s.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("m", "k").alias("m"), F.max_by("v", "k").alias("v"))
        new = state.join(last, by, "full").select(*by, (F.coalesce("n0", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n0"), F.coalesce("m", "m0").alias("m0"), F.coalesce("v", "v0").alias("v0"))
        new.write.mode("overwrite").parquet(f"{self.path}/state/{batch_id + 1}")


def hourly_counts(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling hours with a watermark; late rows are dropped."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "symbol").agg(F.count("*").alias("n"))


def once_per_time(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["symbol", "ts"])


def replay(spark: SparkSession, source: str, slots: list[int], schema, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a streaming query over the slots of ``tables.time_slots``, one batch a slot, in the order of their names.

    ``start`` is given the stream of one slot and starts the query with a checkpoint that is the same each time, so
    state, watermark and what has been read go on from slot to slot, also after a stop in between. A slot's files are
    read in parallel. State has two partitions a core, as each is loaded and written anew in every batch, however little is in it.
    """
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, min(int(own), 2 * spark.sparkContext.defaultParallelism))
    try:
        for k in slots:  # braces make it a pattern, so that no slot's folder is taken for the base of all
            start(spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(f"{source}/slot={{{k}}}")).awaitTermination()
    finally:
        spark.conf.set(name, own)


def written(path: str, checkpoint: str) -> Callable[[DataFrame], StreamingQuery]:
    """Starts a query that appends to a table and stops when all is read."""
    return lambda df: df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
