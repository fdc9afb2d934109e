"""Line deduplication by site-relative frequency.

A page is a row, a site its host. A line is boilerplate on a site when the pages that contain it (trimmed of spaces) are
more than ``max_ratio`` of the site's pages and of ``prior`` more that do not contain it. The prior is one rule for sites
of all sizes: a few pages never make a template by their share alone, and on a large site it does not count. Pages are
told apart by their text: exact copies of a page are one, so copies do not vote their own lines away.

Boilerplate lines go from every page of that site, except from a page that would keep no other line: such a page is a copy
of others, a matter for deduplication of documents, and cutting it could take a text away everywhere.

Lines and texts travel as 16-byte digests. A page counts a line once, counting is a partial aggregate by (host, line, text)
and then by (host, line), so neither a hot host nor a hot line gathers in a task. A site has at most mean distinct lines
per page / max_ratio boilerplate lines; this table is written out, so the planner knows its size when it chooses to
broadcast it or not.

Defined results: blank lines are never counted and stay; rows without a host, and null texts, stay as they are; repeated
rows are one page for the counts, and all are cut alike; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize, new_name


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def drop_site_lines(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.01, prior: int = 300, removed: str | None = None) -> DataFrame:
    """df with boilerplate lines cut from text; ``removed`` names a column for the number of lines cut."""
    site, body = F.col(f"`{host}`"), F.col(f"`{text}`")
    lines = F.split(body, "\n", -1)
    said = F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _digest))
    pages = df.filter(site.isNotNull())
    content = F.unhex(F.md5(body)).alias("content")
    total = pages.select(site.alias("site"), content).distinct().groupBy("site").agg(F.count("content").alias("pages"))
    said_by = pages.select(site.alias("site"), content, F.explode(said).alias("line")).distinct()
    counts = said_by.groupBy("site", "line").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") > 1).join(total, "site").filter(F.col("n") > (F.col("pages") + prior) * F.lit(float(max_ratio)))
    bad, key = new_name(df, "_boilerplate"), new_name(df, "_site")
    table = materialize(often.groupBy(F.col("site").alias(key)).agg(F.collect_set("line").alias(bad)), "boilerplate")
    found, stay = new_name(df, "_found"), new_name(df, "_stay")
    # each step is a projection of its own: the digests of a page are made once, not again for each of its lines
    hits = F.array_intersect(F.transform(lines, _digest), F.col(bad))
    joined = df.join(table, site == F.col(key), "left").withColumn(found, hits)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(found), _digest(x)) | (F.trim(x) == ""))
    joined = joined.withColumn(stay, F.when(F.size(found) > 0, kept))
    joined = joined.withColumn(stay, F.when(F.exists(stay, lambda x: F.trim(x) != ""), F.col(stay)))
    if removed:
        joined = joined.withColumn(removed, F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long"))
    joined = joined.withColumn(text, F.coalesce(F.array_join(stay, "\n"), body))
    return joined.select(*(f"`{c}`" for c in df.columns if c != removed), *([removed] if removed else []))
