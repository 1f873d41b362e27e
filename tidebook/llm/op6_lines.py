"""Operator 6, line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host; a line's ratio is the number of the host's pages that contain it over the host's pages and
``PRIOR`` more, so that few pages say little and no host is treated apart. Lines over the ratio are boilerplate and go
from every page of that host. The host is any column or expression; for documents it is their source.

Defined results: lines are cut at ``\\n`` and compared whole; lines of blanks only are never boilerplate; a null text
stays null; an empty text stays empty; null hosts are one host; repeated rows count as pages of their own; a text of
which every line goes becomes empty; a line just at the ratio stays; very long texts and lines are taken whole; an empty
table gives no rows. Extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import numbered, row_key, stored

RATIO, PRIOR = 0.05, 100
BLANK_LINE = r"^[\x20\x09-\x0D]*$"


def digest(line: str | Column) -> Column:
    """A line's md5 in 16 bytes: what is shuffled in its place."""
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, host: Column, text: str, ratio: float = RATIO, prior: int = PRIOR) -> DataFrame:
    """_host, _line (digest) of the lines to drop; a few per host (at most its mean lines a page / ratio)."""
    lines = F.transform(F.filter(F.array_distinct(F.split(text, "\n")), lambda v: ~v.rlike(BLANK_LINE)), digest)
    counts = pages.select(host.alias("_host"), F.explode(lines).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    # no line under the prior's own share can be over the ratio, so most go before they meet their host
    counts = counts.where(F.col("_n") > ratio * prior)
    totals = pages.groupBy(host.alias("_of")).agg(F.count("*").alias("_pages"))
    return counts.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_n") > ratio * (F.col("_pages") + prior)).select("_host", "_line")


def drop_boilerplate(pages: DataFrame, key: list[str], host: str | Column = "source", text: str = "text", ratio: float = RATIO, prior: int = PRIOR) -> DataFrame:
    """The pages with their boilerplate lines gone, and n_dropped. key: columns that tell pages apart.

    Lines meet the dropped ones by md5; what goes from a page is gathered by the page's key, so that a page's text is
    shuffled once and a frequent line only as its digest.
    """
    host = F.col(host) if isinstance(host, str) else host
    bad = stored(boilerplate(pages, host, text, ratio, prior), "op6")
    keyed = pages.select(*numbered(pages), F.col(text).alias("_text"), host.alias("_of"), row_key(*key, host, text).alias("_key"))
    lines = keyed.select("_key", "_of", F.explode(F.transform(F.array_distinct(F.split("_text", "\n")), digest)).alias("_md5"))
    hits = lines.join(bad, F.col("_of").eqNullSafe(F.col("_host")) & (F.col("_md5") == F.col("_line"))).groupBy(F.col("_key").alias("_page")).agg(F.collect_set("_md5").alias("_bad"))
    x = keyed.join(hits, F.col("_key") == F.col("_page"), "left")
    kept = F.filter(F.split("_text", "\n"), lambda v: ~F.coalesce(F.array_contains("_bad", digest(v)), F.lit(False)))
    new = F.when(F.col("_bad").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("_bad").isNull(), F.lit(0)).otherwise(F.size(F.split("_text", "\n")) - F.size(kept)).cast("long")
    out = [(new if c == text else F.col(f"_own_{i}")).alias(c) for i, c in enumerate(pages.columns)]
    return x.select(*out, dropped.alias("n_dropped"))


def score(docs: DataFrame, ratio: float = RATIO, prior: int = PRIOR) -> DataFrame:
    """Per document: doc_id, lines dropped, and the length and md5 of what stays."""
    x = drop_boilerplate(docs.select("doc_id", "source", "text"), ["doc_id"], "source", "text", ratio, prior)
    return x.select("doc_id", "n_dropped", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
l AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
c AS (SELECT source, line, count(DISTINCT page) AS n FROM l WHERE NOT regexp_matches(line, '^[\\x20\\x09-\\x0D]*$') GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
bad AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n > {RATIO} * (total + {PRIOR})),
k AS (SELECT l.page, l.line, l.pos, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.line = bad.line AND l.source IS NOT DISTINCT FROM bad.source),
g AS (SELECT page, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY page)
SELECT d.doc_id, coalesce(g.n_dropped, 0) AS n_dropped, coalesce(length(g.kept), 0)::BIGINT AS n_chars_left, md5(g.kept) AS text_md5
FROM d LEFT JOIN g ON d.page = g.page
"""
