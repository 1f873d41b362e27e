"""Helpers shared by the training-data operators: tables, scratch space, words.

Words everywhere are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that end a word.
BLANKS = " \t\n\x0b\x0c\r"
#: Java regular expression of a word.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text, in order; none for null. str.split() would also cut at other Unicode blanks."""
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def n_words(col: str | Column) -> Column:
    """Number of words of a text column, JVM-side; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared storage that spark.checkpoint.dir names. In local mode that may be unset; on a cluster it must not be."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and store that Spark would resolve it by, for readers and writers outside Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows travel to Python at once: for steps that carry whole texts and are run, by being stored, inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables. Only once all that was made of them is stored itself: nothing may read them again, not even to make up for a lost executor."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_fold(doc_id: Column, n: int, k: int = 1) -> Column:
    """Whether crc32 of the id's text leaves k modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n == k


def row_key(*cols: str | Column) -> Column:
    """One string for a row's given columns, nulls apart from empty texts: rows alike get the same key."""
    return F.md5(F.concat_ws("\x01", *[F.coalesce(F.md5((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in cols]))


def md5_int(digits: int, *cols: Column) -> Column:
    """A whole number from the first hex digits (at most 15) of the md5 of the columns' texts joined by '|'; nulls read as '~'."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def sampled(df: DataFrame, size: int, *key: Column) -> DataFrame:
    """About ``size`` rows, the same ones on every run: those whose key's digest is below the share wanted; all if there are no more.

    Rows with equal keys are one row, so that repeated rows can't exceed the bound: give what tells rows apart, texts as
    their md5. Keys are counted by a mergeable sketch, to about two in a hundred.
    """
    x = df.withColumn("_drawn", md5_int(12, *key))
    n = x.agg(F.approx_count_distinct("_drawn", 0.02)).first()[0]
    x = x if n <= size else x.where(F.col("_drawn") < int(size / n * 16**12))
    return x.dropDuplicates(["_drawn"]).drop("_drawn")


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[str, int]]:
    """The most frequent of stored counts (w, n), at most ``limit``, most frequent first.

    A histogram over an eighth of an octave gives the count from which on at most ``limit`` remain; only those rows
    travel to the driver, however many partitions there are.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    left, cut = limit, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):  # a few hundred rows at most
        if r.k > left:
            break
        left, cut = left - r.k, r.b
    return [] if cut is None else sorted(((r.w, r.n) for r in counts.where(step >= cut).collect()), key=lambda x: (-x[1], x[0]))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]]) -> DataFrame:
    """mapInArrow with a function made once per task: each batch in gives one batch of columns out."""
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def numbered(df: DataFrame) -> list[Column]:
    """A caller's columns as _own_0, _own_1, ..., so that their names can't clash with an operator's own."""
    return [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(df.columns)]


def renamed(df: DataFrame, like: DataFrame) -> DataFrame:
    """Only the numbered columns, under their names again."""
    return df.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(like.columns)])
