"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, a line's ratio is the host's pages that contain it over the host's pages; lines above ``RATIO`` on at
least ``MIN_PAGES`` pages are boilerplate of that host and are dropped from its pages. Lines are told apart by 64-bit
hashes of their whole bytes. Only hashes are shuffled, counted in every task first, so that neither a host with a third
of all pages nor a line on all of them gathers in one task. A host's boilerplate is at most its lines a page over the
ratio; it goes to the pages by broadcast if all hosts' lines together are few. Else pages send their lines' hashes to
be joined by host and line, and get back those of their own that are to go. ``host_of`` takes the host from an address.

Defined cases: empty lines are kept and not counted; a page counts once for a line however often it has it; null
hosts form one host; null text stays null; a page of boilerplate alone becomes an empty text; repeated rows are pages
each; an empty table gives no rows. ``dedup`` returns the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines (8 bytes each) up to which they are broadcast.
BROADCAST_LINES = 250_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Of a page's lines that are not empty, each once."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x != ""), lambda x: F.xxhash64(x)))


def host_of(url: Column) -> Column:
    """The host of a page's address in lower case, without user, port and a leading ``www.``; null if it has none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(authority, r"^www\.", "")
    return F.when(host != "", host)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hashes: the lines to drop, by host."""
    pages = docs.select(F.col(host).cast("string").alias("host"), F.col("text").alias("text"))
    seen = pages.select("host", F.explode(_hashes(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "total_host")
    often = seen.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("hashes"))


def marked(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """row (all columns of docs), kept (its lines that stay) and n_lines."""
    drop = stored(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    size = drop.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)), F.count("*")).first()
    rows = docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("__host"), F.col("text").alias("__text"))
    if size[0] + size[1] <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(drop), F.col("__host").eqNullSafe(F.col("host")), "left")
    else:
        # a page's own boilerplate, found by host and line; equal pages of a host have the same
        rows = rows.withColumn("__key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length("__host"), F.lit(-1)), "__host", "__text"), 256)))
        pages = docs.select(F.col(host).cast("string").alias("__host"), F.col("text").alias("__text"))
        pages = pages.withColumn("__key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length("__host"), F.lit(-1)), "__host", "__text"), 256)))
        seen = pages.select("__key", "__host", F.explode(_hashes(F.col("__text"))).alias("__line")).distinct()
        each = drop.select("host", F.explode("hashes").alias("line"))
        found = seen.join(each, F.col("__host").eqNullSafe(F.col("host")) & (F.col("__line") == F.col("line"))).groupBy("__key").agg(F.collect_set("line").alias("hashes"))
        joined = rows.join(found.withColumnRenamed("__key", "__page"), F.col("__key") == F.col("__page"), "left")
    lines = _lines(F.col("__text"))
    kept = F.when(F.col("hashes").isNull(), lines).otherwise(F.filter(lines, lambda x: (x == "") | ~F.array_contains("hashes", F.xxhash64(x))))
    return joined.select("row", kept.alias("kept"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"))


def dedup(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """docs with boilerplate lines gone from text, and n_chars, if there, counted anew."""
    text = F.array_join("kept", "\n")
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    found = marked(docs, host, **limits)
    return found.select([out[c].alias(c) if c in out else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    dropped = F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped")
    return found.select("row.doc_id", "row.source", F.array_join("kept", "\n").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), dropped)


ORACLE = f"""
WITH pages AS MATERIALIZED (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents
), lines AS (
    SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages
), often AS (
    SELECT s.source, line
    FROM (SELECT source, line, count(DISTINCT page) AS n FROM lines WHERE line <> '' GROUP BY source, line) s
    JOIN (SELECT source, count(*) AS pages FROM pages GROUP BY source) p ON s.source IS NOT DISTINCT FROM p.source
    WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages
), cut AS (
    SELECT page, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE o.line IS NULL), '') AS text, count(*) AS n_lines, count(o.line) AS n_dropped
    FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY page
)
SELECT p.doc_id, p.source, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped FROM pages p LEFT JOIN cut c ON p.page = c.page
"""
