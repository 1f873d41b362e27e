"""Operator 4, WARC archives read index first.

Writing: every task streams its rows as gzip members, one per record, into archives in the shared folder and returns an
index row per record: file, offset, length, url, digest. The index is written as a table; files of a lost or repeated
task attempt are named by attempt and no index row points at them. Reading: the index's selected rows are dealt by file
and stretch of ``STRETCH`` bytes, sorted by offset, and neighbouring ranges (at most ``GAP`` bytes apart) are read at once.

Equal payloads of at least 100 bytes: the record with the smallest page_id is the response, the others revisit it
without a payload of their own. Defined results: a null html is an empty payload; smaller payloads are all responses;
rows that share the smallest page_id of a payload are each a response; a null page_id never is the first of equal
payloads unless all are null (then all are responses); null urls are written empty, control characters in urls are
percent-encoded; very long payloads are one record; an empty table has an empty index; columns other than page_id,
url and html are ignored, whatever their names.

Files are reached through ``pyarrow.fs``, so the shared folder may be in any store that it knows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import qualified, scratch, stored

LEAST = 100
ROLL, STRETCH, GAP = 256 << 20, 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to.

    Equal payloads meet as digests; whole pages are shuffled once, by page and digest, so that no payload is a hot key.
    """
    html = F.coalesce("html", F.lit(""))
    x = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    some = x.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "page_id").agg(F.count("*").alias("_n"))
    groups = some.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    again = some.join(groups, F.col("payload_digest") == F.col("_digest")).where(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")))
    again = again.select(F.coalesce("page_id", F.lit(0)).alias("_page"), F.col("page_id").isNull().alias("_null"), "_digest", "_first")
    on = (F.coalesce("page_id", F.lit(0)) == F.col("_page")) & (F.col("page_id").isNull() == F.col("_null")) & (F.col("payload_digest") == F.col("_digest"))
    y = x.join(again, on, "left")
    return y.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("_first").alias("refers_to"))


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, html: str, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """One record, as a gzip member of its own."""
    body = html.encode("utf-8", "surrogatepass") if kind == "response" else b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean_url(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + len(body)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, wbits=31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + head + body + b"\r\n\r\n") + z.flush()


def parsed(member: bytes) -> tuple:
    """(page_id, url, payload bytes, payload digest, type, refers_to, payload or None) of one gzip member; fails on a damaged one."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s or "")) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its record says")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("WARC-Refers-To")), payload.decode("utf-8", "surrogatepass") if kind == "response" else None


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and their index; returns the index as a stored table."""
    # as Spark itself resolves it: a plain path on a cluster is one of its shared store, not of a machine's own disk
    folder = qualified(pages.sparkSession, folder or scratch(pages.sparkSession, "warc"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, store, path = TaskContext.get(), *fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at, files = "", None, 0, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ROLL:
                        if out:
                            out.close()
                        name, at, files = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0, files + 1
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], r["html"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"])
                    out.write(data)
                    rows.append((r["page_id"], f"{folder}/{name}", at, len(data), clean_url(r["url"]), r["payload_digest"], r["record_type"]))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64() if i in (0, 2, 3) else pa.string()) for i in range(7)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out:
                out.close()

    return stored(with_types(pages).mapInArrow(archive, INDEX), "warc-index")


def read(index: DataFrame, select: Column | None = None) -> DataFrame:
    """The records that an index names, or the selected ones: sorted byte ranges, neighbours read at once.

    The index is dealt by what its ranges hold, one task a stretch of bytes, not by its own size; plain paths in it are
    resolved as Spark resolves them. Rows leave a task once they hold a stretch of decoded bytes.
    """
    chosen = index if select is None else index.where(select)
    root = qualified(index.sparkSession, "/")[:-1]
    chosen = chosen.withColumn("file", F.when(F.col("file").contains(":/"), F.col("file")).otherwise(F.concat(F.lit(root), "file")))
    stretch = F.floor(F.col("offset") / STRETCH)
    tasks = chosen.select("file", stretch.alias("_s")).distinct().count()
    dealt = chosen.select("file", "offset", "length", stretch.alias("_s")).repartition(max(1, tasks), "file", "_s").sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened = None, ""

        def fetch(run: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal handle, opened
            file, first = run[0][:2]
            if file != opened:
                if handle:
                    handle.close()
                store, path = fs.FileSystem.from_uri(file)
                handle, opened = store.open_input_file(path), file
            data = handle.read_at(run[-1][1] + run[-1][2] - first, first)
            rows, size = [], 0
            for _, o, n in run:
                rows.append(parsed(data[o - first : o - first + n]))
                size += len(rows[-1][-1] or "")
                if size >= STRETCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in ROW.split(", ")])

        for batch in batches:
            run: list[tuple[str, int, int]] = []
            for x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if run and (x[0] != run[0][0] or x[1] > run[-1][1] + run[-1][2] + GAP or x[1] + x[2] - run[0][1] > STRETCH):
                    yield from fetch(run)
                    run = []
                run.append(x)
            if run:
                yield from fetch(run)
        if handle:
            handle.close()

    return dealt.select("file", "offset", "length").mapInArrow(ranges, ROW)


def score(pages: DataFrame) -> DataFrame:
    """Per page, what its record says after archives and index are written and read back."""
    return read(write(pages.select("page_id", "url", "html"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM f
"""
