"""Queries of level updates and of the streaming operators: streams read the given tables and run until all is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidebook.plans import fixtures as fx
from tidebook.plans import selection  # noqa: F401  its SQL is read below
from tidebook.plans.registry import SQL, query
from tidebook.plans.splitting import _folder
from tidebook.sources import tables
from tidebook.streaming import books as s

GRID = 6 * 3_600_000_000


def updates(spark, sf):
    """Level updates from events: a partial every 500 events, else insert, update or delete by turns, on 40 levels."""
    a = "CASE WHEN event_id % 500 = 0 THEN 'partial' WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 3 = 1 THEN 'update' ELSE 'delete' END"
    x = fx.events(spark, sf)
    return x.select("symbol", F.col("event_id").alias("seq"), "us", F.expr(a).alias("action"), F.expr("(event_id div 7) % 40").alias("id"), F.col("value").alias("price"), (1.0 + F.col("event_id") % 50).alias("size"), F.expr("CASE WHEN (event_id div 7) % 2 = 0 THEN 'Buy' ELSE 'Sell' END").alias("side"))


U = f"""{fx.ctes("ev")}, up AS (SELECT symbol, event_id AS seq, us, CASE WHEN event_id % 500 = 0 THEN 'partial' WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 3 = 1 THEN 'update' ELSE 'delete' END AS action, event_id // 7 % 40 AS id, value AS price, 1.0 + event_id % 50 AS size, CASE WHEN event_id // 7 % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side FROM ev),
gr AS (SELECT DISTINCT symbol, (us // {GRID} + 1) * {GRID} AS grid_us FROM ev),
pa AS (SELECT g.symbol, g.grid_us, arg_max(u.seq, (u.us, u.seq)) AS pseq, max(u.us) AS pus FROM gr g JOIN up u ON u.symbol = g.symbol AND u.us <= g.grid_us AND u.action = 'partial' GROUP BY ALL),
se AS (SELECT p.symbol, p.grid_us, u.* EXCLUDE (symbol) FROM pa p JOIN up u ON u.symbol = p.symbol AND u.us <= p.grid_us AND (u.us, u.seq) >= (p.pus, p.pseq)),
lb AS (SELECT symbol, grid_us, id, max(CASE WHEN action <> 'update' THEN (us, seq) END) AS born FROM se GROUP BY ALL),
bb AS (SELECT se.symbol, se.grid_us, se.id, se.price, se.side, se.us AS bus, se.seq AS bseq FROM se JOIN lb USING (symbol, grid_us, id) WHERE (se.us, se.seq) = lb.born AND action <> 'delete'),
bk AS (SELECT bb.symbol, bb.grid_us, bb.id, bb.price, bb.side, (SELECT arg_max(size, (us, seq)) FROM se WHERE se.symbol = bb.symbol AND se.grid_us = bb.grid_us AND se.id = bb.id AND (se.us, se.seq) >= (bb.bus, bb.bseq) AND action <> 'delete') AS size FROM bb)"""


def grid(spark, sf):
    return fx.events(spark, sf).select("symbol", F.expr(f"(us div {GRID} + 1) * {GRID}").alias("grid_us")).distinct()


def _asof(spark, sf):
    return s.book_asof(updates(spark, sf), grid(spark, sf))


@query("book_asof", f"{U} SELECT symbol, grid_us, id, price, size, side FROM bk")
def book_asof(spark, sf):
    return _asof(spark, sf)


@query("book_snapshot", f"{U} SELECT symbol, grid_us, sum((side = 'Buy')::INT)::BIGINT AS n_bids, sum((side = 'Sell')::INT)::BIGINT AS n_asks, max(CASE WHEN side = 'Buy' THEN price END) AS best_bid, min(CASE WHEN side = 'Sell' THEN price END) AS best_ask FROM bk GROUP BY ALL")
def book_snapshot(spark, sf):
    buy, sell = F.col("side") == "Buy", F.col("side") == "Sell"
    return _asof(spark, sf).groupBy("symbol", "grid_us").agg(F.count_if(buy).alias("n_bids"), F.count_if(sell).alias("n_asks"), F.max(F.when(buy, F.col("price"))).alias("best_bid"), F.min(F.when(sell, F.col("price"))).alias("best_ask"))


#: Rows of a batch, and batches at most: each has fixed costs (a query, its state's versions, a task a partition), which must not grow with the table.
SLOT_ROWS, MOST_SLOTS = 250_000, 8


def replayed(spark, df, build, shuffle: Callable[[str], None] | None = None):
    """What ``build`` makes of a table replayed as a stream, batch by batch of event time; all that it has written."""
    base = _folder(spark)
    slots = tables.time_slots(df, f"{base}/in", rows=SLOT_ROWS, most=MOST_SLOTS)
    if shuffle:
        shuffle(f"{base}/in")
    schema = []

    def start(stream):
        out = build(stream)
        schema.append(out.schema)
        return s.written(f"{base}/out", f"{base}/state")(out)

    s.replay(spark, f"{base}/in", slots, df.schema, start)
    return spark.read.schema(schema[0]).parquet(f"{base}/out")


def timed(spark, sf):
    """Events with ts as a timestamp."""
    return fx.events(spark, sf).withColumn("ts", F.timestamp_micros("us"))


@query("stream_ingest", f"{fx.ctes('ev')} SELECT event_id, symbol, value FROM ev")
def stream_ingest(spark, sf):
    return replayed(spark, timed(spark, sf), lambda x: x.select("event_id", "symbol", "value"))


@query("stream_dedup", f"{fx.ctes('ev')} SELECT DISTINCT symbol, us FROM ev")
def stream_dedup(spark, sf):
    """Every row comes twice; one a symbol and time stays."""
    return replayed(spark, timed(spark, sf), lambda x: s.once_per_time(x.union(x))).select("symbol", "us")


@query("stream_window_counts", f"{fx.ctes('ev')} SELECT hour * 3600000000 AS hour_us, symbol, count(*) AS n FROM ev WHERE (hour + 1) * 3600000000 <= (SELECT max(us) FROM ev) - 600000000 GROUP BY ALL")
def stream_window_counts(spark, sf):
    """Hourly counts that the watermark has closed."""
    x = replayed(spark, timed(spark, sf), s.hourly_counts)
    return x.select(F.unix_micros("window.start").alias("hour_us"), "symbol", "n")


@query("stream_ewma", SQL["ewma_standardize"])
def stream_ewma(spark, sf):
    """The scaling of ``ewma_standardize`` online: long rows arrive in time order, take their roles, and only train and warm-up rows move a key's state."""
    base = _folder(spark)
    df = fx.long(spark, sf)
    slots = tables.time_slots(df, f"{base}/in", rows=SLOT_ROWS, most=MOST_SLOTS)
    step = s.OnlineScaler(base, ["split_id", "feature", "symbol"], "role IN ('train', 'train_warmup')", ["us", "event_id"])
    s.replay(spark, f"{base}/in", slots, df.schema, lambda x: fx.with_roles(x).writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/out/*").select("split_id", "feature", "event_id", F.round("z", 5).alias("z"))


STATES = U.replace(f"SELECT DISTINCT symbol, (us // {GRID} + 1) * {GRID} AS grid_us FROM ev", f"SELECT symbol, unnest(range(min((us + {GRID - 1}) // {GRID}), (SELECT max((us + {GRID - 1}) // {GRID}) + 1 FROM ev))) * {GRID} AS grid_us FROM ev GROUP BY symbol")


@query("book_state", f"{STATES} SELECT symbol, grid_us, sum((side = 'Buy')::INT)::INT AS n_bids, sum((side = 'Sell')::INT)::INT AS n_asks, max(CASE WHEN side = 'Buy' THEN price END) AS best_bid, min(CASE WHEN side = 'Sell' THEN price END) AS best_ask FROM bk GROUP BY ALL")
def book_state(spark, sf):
    """Every grid time from a symbol's first book to the first one after the last update of all, as the as-of form gives it."""
    x = updates(spark, sf)
    # one row beyond the lateness lets the snapshots after the last updates out
    end = x.agg((F.expr(f"(max(us) + {GRID - 1}) div {GRID}") * GRID + 120_000_000).alias("us")).select(*[F.col("us") if c == "us" else F.lit(s.HEARTBEAT if c == "action" else None).cast(x.schema[c].dataType).alias(c) for c in x.columns])
    return replayed(spark, x.unionByName(end), lambda u: s.snapshots(u, GRID))
