"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's frequency is the number of the host's
pages that hold it divided by the host's page total, and lines above the
boilerplate ratio are dropped from every page of that host.  Pages with the
same text are one page here: a page that was crawled a thousand times is the
near-duplicate operator's work, and must not make its own lines look like the
site's frame.

Counting goes through partial aggregation in two steps (distinct (host, line,
page), then pages per (host, line)), so neither a hot host nor a hot line
gathers in one task.  A line in more than ``ratio`` of the pages: a host has
fewer than (mean lines per page) / ratio of those, so a host's list is short
and the page is cleaned in place, without a shuffle of its text.

Lines are compared without surrounding white space; blank lines are kept.

Cases: null host is a host of its own; a null text has no lines and stays
null; a page left without lines becomes an empty text; repeated rows are
cleaned alike and count once; hosts with too few pages (a line must be on
``min_pages`` different ones) lose nothing; an empty table stays empty; other
columns pass through and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

RATIO = 0.1
MIN_PAGES = 3
#: Boilerplate lists (16 bytes a line) are broadcast while all together they
#: stay within this many lines.
BROADCAST_LINES = 1_000_000


def _line_key(line: Column) -> Column:
    """128 bits of hash of a line without surrounding white space; null for a
    blank line."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def line_frequencies(pages: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, line, pages, total, ratio): ``line`` is the key of a line."""
    t = pages[f"`{text}`"]
    per_page = pages.select(pages[f"`{host}`"].alias("host"), F.xxhash64(t).alias("page"),
                            F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), _line_key).alias("keys"))
    totals = (per_page.select("host", "page").distinct().groupBy(F.col("host").alias("_host"))
              .agg(F.count(F.lit(1)).alias("total")))
    counted = (per_page.select("host", "page", F.explode(F.array_distinct("keys")).alias("line"))
               .where("line IS NOT NULL").distinct()
               .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))
    return (counted.join(totals, F.col("host").eqNullSafe(F.col("_host")))
            .select("host", "line", "pages", "total", (F.col("pages") / F.col("total")).alias("ratio")))


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per host the keys of the lines to drop."""
    found = line_frequencies(pages, host, text).where((F.col("ratio") > ratio) & (F.col("pages") >= min_pages))
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO,
            min_pages: int = MIN_PAGES, marks: bool = False, length: str | None = None) -> DataFrame:
    """``pages`` with boilerplate lines dropped from ``text`` (and the column
    ``length``, if named, set to the new length where the text changed).  With
    ``marks`` the result is (row, text, n_lines, n_dropped)."""
    drop = staged(boilerplate(pages, host, text, ratio, min_pages), "line-boilerplate")
    many = drop.agg(F.sum(F.size("lines"))).first()[0] or 0
    drop = drop.select(F.col("host").alias("_host"), F.col("lines").alias("_drop"))
    if many <= BROADCAST_LINES:
        drop = F.broadcast(drop)
    c = {n: pages[f"`{n}`"] for n in pages.columns}
    row = pages.select(F.struct(*[v.alias(n) for n, v in c.items()]).alias("row"))
    old, at = F.col("row")[text], F.col("row")[host]
    lines = F.split(old, "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), _line_key(x)), F.lit(False)))
    out = (row.join(drop, at.eqNullSafe(F.col("_host")), "left")
           .withColumn("_left", F.when(F.col("_drop").isNotNull(), left)))
    new = F.when(F.col("_left").isNull(), old).otherwise(F.array_join("_left", "\n"))
    if marks:
        n_lines = F.coalesce(F.size(lines), F.lit(0))
        gone = F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_left"))
        return out.select("row", new.alias("text"), n_lines.cast("long").alias("n_lines"),
                          gone.cast("long").alias("n_dropped"))
    changed = {text: new}
    if length:
        changed[length] = F.when(F.col("_left").isNull() | (F.size("_left") == F.size(lines)), F.col("row")[length]).otherwise(
            F.char_length(F.array_join("_left", "\n")).cast(pages.schema[length].dataType))
    return out.select(*[changed.get(n, F.col("row")[n]).alias(n) for n in pages.columns])
