"""Operator 8, mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's target over its size is each of its documents' expected copies. Documents of a source are ordered by size,
then by a digest of their own; their expected copies are prefix-summed, one random offset per source is added, and a
document is emitted once per whole number that its part of the sum crosses. The prefix sum is taken in bins of like
size and digest (a count per bin, then ranks inside a bin), so no source is ordered in one task.

Defined results: a null text has size 0; null is a source of its own, last; a source without words has target 0 and
nothing taken; very long texts are counted whole; equal sizes go by the digest, and repeated rows take neighbouring
ranks; reruns agree (digests of the id, no random state); an empty table gives no rows; other columns pass through
``emit`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import md5_int, n_words, numbered, renamed, stored

#: The weights repeat along the sources; all targets together are this share of all sizes; no target exceeds its source this many times.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED, BINS = "mix-1", 64
LIMIT = 2**32


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> target, by filling up: with level v, a target is least(MOST * size, v * weight).

    Sources in order of size over weight: those before the first whose cap the level doesn't reach stop at their cap.
    Works on one row per source, never on documents.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    x = sizes.withColumn("weight", weight)
    by = Window.orderBy((MOST * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("capped", F.coalesce(F.sum(MOST * F.col("source_size")).over(upto), F.lit(0)))
    x = x.withColumn("level", (SHARE * F.sum("source_size").over(Window.partitionBy()) - F.col("capped")) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("level") * F.col("weight") <= MOST * F.col("source_size"), F.col("level"))).over(Window.partitionBy())
    return x.withColumn("level", level).select("source", "source_size", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """The documents' columns as _own_0, _own_1, ..., with size, source_size, target and copies (0, 1 or 2)."""
    own = numbered(docs)
    x = docs.select(*own, F.col("source").alias("_source"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), n_words("text").alias("_size"), md5_int(8, F.lit(seed), F.col("doc_id"), F.md5("text")).alias("_tie"))
    # like sizes together: a bin per 9 % of size, split by digest
    x = x.withColumn("_class", F.floor(8 * F.log2(1.0 + F.col("_size"))).cast("int")).withColumn("_bin", F.pmod(F.col("_tie"), F.lit(bins)).cast("int"))
    counts = stored(x.groupBy("_key", "_source", "_class", "_bin").agg(F.count("*").alias("n"), F.sum("_size").alias("s")), "op8")
    before = F.sum("n").over(Window.partitionBy("_key").orderBy("_class", "_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_key").alias("b_key"), F.col("_source").alias("b_source"), F.col("_class").alias("b_class"), F.col("_bin").alias("b_bin"), F.coalesce(before, F.lit(0)).alias("b_start"))
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum("s").alias("source_size"))
    goal = targets(sizes).select(F.col("source").alias("g_source"), "source_size", "target")
    starts = starts.join(goal, F.col("b_source").eqNullSafe(F.col("g_source"))).drop("g_source", "b_source")
    rank = F.row_number().over(Window.partitionBy("_key", "_class", "_bin").orderBy("_size", "_tie"))
    x = x.withColumn("_rank", rank).join(starts, (F.col("_key") == F.col("b_key")) & (F.col("_class") == F.col("b_class")) & (F.col("_bin") == F.col("b_bin")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = md5_int(8, F.lit(seed), F.col("_source")) / F.lit(float(LIMIT))
    upto = F.col("b_start") + F.col("_rank")
    copies = F.floor(offset + upto * each) - F.floor(offset + (upto - 1) * each)
    return x.select(*[f"_own_{i}" for i in range(len(own))], F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    x = mixed(docs.select("doc_id", "text", "source"))
    return x.select(F.col("_own_0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    return renamed(mixed(docs).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def _digest(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(f"coalesce(({p})::VARCHAR, '~')" for p in parts)}), 1, 8))::BIGINT"


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {_digest(f"'{SEED}'", "doc_id", "md5(text)")} AS tie FROM documents),
b AS (SELECT *, floor(8 * log2(1.0 + size)) AS class, tie % {BINS} AS bin FROM d),
w AS (SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM d GROUP BY source),
c AS (SELECT *, coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, ({SHARE} * total - capped)::DOUBLE / rest AS level FROM c),
v AS (SELECT max(level) AS level FROM l WHERE level * weight <= {MOST} * source_size),
t AS (SELECT source, source_size, least(({MOST} * source_size)::DOUBLE, v.level * weight) AS target, {_digest(f"'{SEED}'", "source")} / {float(LIMIT)}::DOUBLE AS shift FROM l, v),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bin, size, tie) AS upto FROM b),
e AS (SELECT r.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS per FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(shift + upto * per) - floor(shift + (upto - 1) * per)) * size)::BIGINT AS taken FROM e
"""
