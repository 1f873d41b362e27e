"""Sources and sinks: whole directories with schemas, pruned by partition; appends that don't repeat keys; versioned swaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared storage that spark.checkpoint.dir names. In local mode that may be unset; on a cluster it must not be."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read back, so that what follows doesn't work it out again."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_lob(raw: DataFrame) -> DataFrame:
    """Raw book rows (texts) to typed ones; rows with any null, or that don't parse, go."""
    side = lambda c: F.from_json(c, "array<array<double>>")
    return raw.dropna().select(F.to_timestamp("timestamp").alias("timestamp"), side("bids").alias("bids"), side("asks").alias("asks"), *[c for c in raw.columns if c not in ("timestamp", "bids", "asks")]).dropna(subset=["timestamp", "bids", "asks"])


def read_books(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Books of a folder of raw files, with further columns (as DDL)."""
    return parse_lob(spark.read.schema(", ".join(filter(None, (schemas.RAW_BOOK, more)))).parquet(path))


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's classes: any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def write_files(df: DataFrame, path: str, by: str | None, name) -> None:
    """One Parquet file per value of a column, or one in all, under given names: a folder as another system would fill it."""
    spark, tmp = df.sparkSession, f"{path}/_parts-{uuid.uuid4().hex}"
    writer = df.repartition(by).write.partitionBy(by) if by else df.coalesce(1).write
    writer.parquet(tmp)
    fs, root = hadoop(spark, tmp)
    base = lambda p: p.getName()
    for part in fs.listStatus(root):
        folder_ = part.getPath()
        if by and part.isDirectory():
            file = next(f.getPath() for f in fs.listStatus(folder_) if base(f.getPath()).startswith("part-"))
            fs.rename(file, hadoop(spark, f"{path}/{name(base(folder_).split('=')[1])}")[1])
        elif not by and base(folder_).startswith("part-"):
            fs.rename(folder_, hadoop(spark, f"{path}/{name(None)}")[1])
    fs.delete(root, True)


def ingested(spark: SparkSession, path: str, log: DataFrame, kind: str, schema) -> tuple[DataFrame, DataFrame]:
    """The rows of a folder's files that the log doesn't have, and their log rows: filename, type, record_count.

    Files are told by ``_metadata.file_name``. Tasks count the rows of each from its footer, no column is read; an anti
    join with the log picks what is new. Neither the log nor file names come to the driver. An empty file is logged
    with 0; one that can't be read is skipped, and isn't logged, so that the next run tries it again. A file that is
    damaged past its footer gives fewer rows than its record_count.
    """
    known = log.select(F.col("filename").alias("_file")).distinct()
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file")).join(known, "_file", "left_anti")
    counts = rows.groupBy(F.col("_file").alias("filename")).agg(F.count("*").alias("n"))
    # what has no rows is small, if it is sound: its footer tells
    small = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).where(F.col("length") <= EMPTY_BYTES)
    small = small.select(F.element_at(F.split("path", "/"), -1).alias("_file"), "content").join(known, "_file", "left_anti").mapInArrow(_without_rows, "filename string, n long")
    fresh = stored(counts.unionByName(small), "ingest")
    return rows.drop("_file"), fresh.select("filename", F.lit(kind).alias("type"), F.col("n").cast("int").alias("record_count"))


#: No sound file without rows is larger.
EMPTY_BYTES = 16 << 20


def _without_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """filename and 0 of the files whose footer can be read and tells of no rows."""
    for batch in batches:
        out = []
        for name, content in zip(batch["_file"].to_pylist(), batch["content"], strict=True):
            try:
                if pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows == 0:
                    out.append(name)
            except (pa.ArrowInvalid, OSError):
                continue
        yield pa.record_batch({"filename": pa.array(out, pa.string()), "n": pa.array([0] * len(out), pa.int64())})


def time_slots(df: DataFrame, path: str, us: str = "us", rows: int = 1_000_000, most: int | None = None) -> list[int]:
    """Write a table as folders ``slot=k`` of about ``rows`` rows each, cut by event time; the slots, in order.

    With ``most`` there are no more slots than that, and larger ones for larger tables.

    The bounds come from quantiles, so slots are alike in size however the times are spread. A slot is written by as
    many tasks as it needs (ranges of time), and its name alone says where it stands: file times don't matter.
    """
    n = df.count()
    parts = max(1, -(-n // rows))
    parts = min(parts, most) if most else parts
    cuts = sorted(set(df.approxQuantile(us, [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    slot = F.lit(0)
    for c in cuts:
        slot = slot + (F.col(us) > int(c)).cast("int")
    df.withColumn("slot", slot).repartitionByRange("slot", us).sortWithinPartitions("slot", us).write.partitionBy("slot").parquet(path)
    fs, root = hadoop(df.sparkSession, path)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.isDirectory() and "=" in f.getPath().getName())


def time_range(df: DataFrame, start: int, end: int, columns: list[str] | None = None, ts: str = "us") -> DataFrame:
    """Half-open [start, end); the filter and the columns reach the scan."""
    x = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    return x.select(*columns) if columns else x


def role_scan(df: DataFrame, split_id: int, roles: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    x = df.where(F.col("split_id") == split_id)
    if roles:
        x = x.where(F.col("role").isin(roles))
    return x.select(*columns) if columns else x


def iso_text(us: str = "us") -> Column:
    """Milliseconds, as ISO text in UTC."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def split_info(df: DataFrame) -> DataFrame:
    return df.groupBy("split_id").agg(F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.count("*").alias("n"))


def append_by_day(df: DataFrame, path: str, us: str = "us") -> None:
    """Append partitioned by day, in time order inside files, without one global sort."""
    x = df.withColumn("day", F.expr(f"cast({us} div 86400000000 as int)"))
    x.repartitionByRange("day", us).sortWithinPartitions("day", us).write.mode("append").partitionBy("day").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Append the first row per key, in the given order, of keys that the table doesn't have yet: the same append again adds nothing."""
    spark = df.sparkSession
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    fs, p = hadoop(spark, path)
    if fs.exists(p):
        first = first.join(spark.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    first.write.mode("append").parquet(path)


POINTERS, GRACE = "pointers", 2


def swap(df: DataFrame, base: str, expected: int | None = None, grace: int = GRACE) -> str:
    """Put a new version in a table's place: written beside the old one, its rows counted, then named by a pointer of the next number.

    The highest number counts. A pointer comes into being whole, by one rename, and none is ever replaced: there is
    always one, and of two writers that take the same number one fails. The last ``grace`` versions stay for readers
    that have begun; older ones go, their pointers first.
    """
    spark = df.sparkSession
    path = f"{base}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path).count()
    if expected is not None and got != expected:
        raise ValueError(f"{path} has {got} rows instead of {expected}")
    known = _pointers(spark, base)
    number = known[-1] + 1 if known else 0
    tmp, target = f"{base}/new-{uuid.uuid4().hex}", _pointer(base, number)
    write_bytes(spark, tmp, path.encode())
    fs, p = hadoop(spark, target)
    fs.mkdirs(p.getParent())
    if not fs.rename(hadoop(spark, tmp)[1], p) or _read_text(spark, target) != path:
        raise RuntimeError(f"another writer has made version {number} of {base}")
    for old in known[: max(0, len(known) - grace)]:
        gone = _read_text(spark, _pointer(base, old))
        fs.delete(hadoop(spark, _pointer(base, old))[1], False)
        fs.delete(hadoop(spark, gone)[1], True)
    return path


def _pointer(base: str, number: int) -> str:
    return f"{base}/{POINTERS}/{number:012d}"


def _pointers(spark: SparkSession, base: str) -> list[int]:
    fs, p = hadoop(spark, f"{base}/{POINTERS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def pointed(spark: SparkSession, base: str) -> str | None:
    known = _pointers(spark, base)
    return _read_text(spark, _pointer(base, known[-1])) if known else None


def current(spark: SparkSession, base: str) -> DataFrame:
    """The version that the highest pointer names."""
    return spark.read.parquet(pointed(spark, base))


def swap_partition(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that the rows have, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
