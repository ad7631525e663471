"""Line deduplication by site-relative frequency.

Within a host, a line's share is the number of pages that contain it over the number of the host's pages. Lines whose
share exceeds a ratio are boilerplate of that host and are dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Elements that begin or end a line of a page, as in the HTML standard's block level; fixed values.
BLOCKS = "address|article|aside|blockquote|br|div|dd|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul|body|html"


def page_lines(html: Column) -> Column:
    """The visible text of a page with one line for each block; scripts, styles and comments are no text."""
    seen = F.regexp_replace(F.regexp_replace(html, r"[\r\n]+", " "), r"(?i)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(seen, rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n"), r"<[^>]*>", " ")


def _identity(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(df: DataFrame, text: str, host: str, max_ratio: float, least: int, copies_once: bool = False) -> DataFrame:
    """One row per host that has boilerplate: the host and the identities of its lines above the ratio.

    A page counts once for a line however often it repeats it. A host keeps fewer than ``lines per page / max_ratio``
    lines, whatever its number of pages. A null host is a host of its own. With ``copies_once`` the pages of a host that
    have the same text count as one page.
    """
    own = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    lines = df.select(F.col(host).alias("host"), F.explode(F.transform(own, _identity)).alias("line"), *([_identity(F.col(text)).alias("page")] if copies_once else []))
    every = df.select(F.col(host).alias("h"), *([_identity(F.col(text)).alias("page")] if copies_once else []))
    if copies_once:
        lines, every = lines.distinct(), every.distinct()
    pages = every.groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least, 2))
    hot = counts.join(pages, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return hot.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate_lines(df: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.2, least: int = 3, removed: str | None = None, copies_once: bool = False) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``; ``removed`` names a column for the number taken out.

    A line is boilerplate when more than ``max_ratio`` of its host's pages contain it, ``least`` pages at least; hosts of
    every size are judged alike. Lines are compared without surrounding blanks; blank lines are never boilerplate and
    stay. A null text stays null, an empty one empty; repeated rows are pages each; a null host is a host of its own. Line
    breaks between kept lines stay as they are. With ``copies_once`` shares are taken over a host's different texts, so
    copies of a page do not make its lines boilerplate. An empty table stays empty; other columns, of whatever names, are
    kept. Hosts' lines are kept in the shared folder before the join, so that Spark can split a host that has many pages.
    """
    bad, lines = fresh(df, "bad"), fresh(df, "lines")
    found = cut(boilerplate(df, text, host, max_ratio, least, copies_once)).select(F.col("host").alias(f"{bad}h"), F.col("lines").alias(bad))
    joined = df.join(found, F.col(host).eqNullSafe(F.col(f"{bad}h")), "left").withColumn(lines, F.split(F.col(text), "\n"))
    left = F.filter(F.col(lines), lambda x: ~F.coalesce(F.array_contains(F.col(bad), _identity(F.trim(x))), F.lit(False)))
    out = joined.withColumn(f"{lines}k", F.when(F.col(bad).isNull(), F.col(lines)).otherwise(left))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(lines) - F.size(f"{lines}k"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.array_join(f"{lines}k", "\n")).drop(bad, f"{bad}h", lines, f"{lines}k")
