"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate.

Every page gives each distinct line once, as its host and a 128-bit digest of the trimmed line; counts are
summed before they are shuffled, so that a line on a third of all pages costs a row per task. The lines
over the ratio are written as one row per host: as each of them takes more than max_ratio of the pages, a
host has fewer of them than its mean lines per page divided by max_ratio. Spark joins that table to the
pages by broadcast if its size on disk allows it, else by a shuffle join that splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _lines(text):
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, host: str | Column = "source", id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """Return all columns of docs with text_col cleaned, and _n_lines and _n_dropped.

    A line, trimmed of blanks, is dropped where it stands on more than max_ratio of its host's pages. Boilerplate
    is what repeats, so a line on fewer than min_pages pages (two) never is. host is a column or an expression,
    such as url_filter.host(F.col("url")) for pages. Every row is a page, also one that repeats another; a line counts once a page.
    Blank lines are neither counted nor dropped. A null host is the same host as an empty one. A null text
    stays null with 0 lines; an empty text is one blank line. All rows and all other columns stay; an empty
    table gives none.
    """
    host_key = F.coalesce((F.col(host) if isinstance(host, str) else host).cast("string"), F.lit(""))
    digest = lambda x: F.unhex(F.md5(F.trim(x).cast("binary")))
    kept = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)]
    pages = docs.select(host_key.alias("_host"), F.col(text_col).alias("_text"))
    totals = docs.groupBy(host_key.alias("_h")).agg(F.count("*").alias("_pages"))
    once = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), digest))
    seen = pages.select("_host", F.explode(once).alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    hot = seen.join(totals, F.col("_host") == F.col("_h")).where(F.col("_n") > F.lit(max_ratio) * F.col("_pages"))
    hot = written(hot.groupBy("_h").agg(F.collect_set("_key").alias("_drop")), "hot-lines")
    out = docs.select(host_key.alias("_host"), *kept).join(hot, F.col("_host") == F.col("_h"), "left")
    text = F.col(f"_in_{docs.columns.index(text_col)}")
    # the page's own hot lines first, by hashing: a host's list may be long
    out = out.withColumn("_drop", F.when(F.col("_drop").isNotNull(), F.array_intersect(F.transform(_lines(text), digest), "_drop")))
    out = out.withColumn("_drop", F.when(F.size("_drop") > 0, F.col("_drop")))
    lines = F.filter(_lines(text), lambda x: ~((F.trim(x) != "") & F.array_contains(F.col("_drop"), digest(x))))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text)))
    n_left = F.when(text.isNull(), F.lit(0)).when(F.col("_drop").isNull(), n_lines).otherwise(F.size(lines))
    cleaned = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(lines, "\n"))
    columns = [(cleaned if c == text_col else F.col(f"_in_{i}")).alias(f"_out_{i}") for i, c in enumerate(docs.columns)]
    counts = [n_lines.cast("long").alias("_out_lines"), (n_lines - n_left).cast("long").alias("_out_dropped")]
    return out.select(*columns, *counts).toDF(*docs.columns, "_n_lines", "_n_dropped")


#: The rows of dedup_lines as SQL, over the table documents.
SQL = r"""
WITH hosted AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text FROM documents),
lines AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM hosted WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM hosted GROUP BY host),
hot AS (
  SELECT host, key FROM (SELECT DISTINCT rid, host, trim(line, ' ') AS key FROM lines WHERE trim(line, ' ') <> '') d
  JOIN totals USING (host) GROUP BY host, key, pages HAVING count(*) >= {min_pages} AND count(*) > {max_ratio} * pages),
kept AS (
  SELECT l.rid, count(*) AS n_lines, count(*) FILTER (WHERE h.key IS NOT NULL) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE h.key IS NULL), '') AS text
  FROM lines l LEFT JOIN hot h ON l.host = h.host AND trim(l.line, ' ') = h.key GROUP BY l.rid)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM hosted p LEFT JOIN kept k USING (rid)
"""
