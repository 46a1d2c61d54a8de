"""Term dictionaries: sections of a text to terms and definitions. All work on a table of texts (one row a file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _filled, _text, collapse, strip, sub

HYPHEN = r"(?U)\s*-\s*"


def _once(rows: DataFrame) -> DataFrame:
    """The first row of each term (whatever its case) and section."""
    w = Window.partitionBy("file", F.lower("term"), F.coalesce("section", F.lit(""))).orderBy("pos")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def terms_plain(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, pos, section, term, definition): a section number on its own line, then the term's line, then the definition."""
    t = F.replace(F.replace(_text(text_col), F.lit("﻿"), F.lit("")), F.lit("\f"), F.lit("\n"))
    t = sub(sub(t, r"(?m)^\s*[0-9]+\s*$"), r"(?m)^\s*정보통신단체표준\(국문표준\)\s*$")
    t = strip(sub(sub(t, r"[ \t]+", " "), r"\n{2,}", "\n\n"))
    entry = r"^(?:\n)*\s*([0-9]{1,2}\.[0-9]{1,3})\s*\n+([^\n]+?)\s*(?:\n+|$)"
    parts = F.split(t, r"(?:^|(?<=\n))(?=[ \t]*[0-9]{1,2}\.[0-9]{1,3}[ \t]*\n)")
    rows = files.select(F.col(file_col).alias("file"), F.posexplode(parts).alias("pos", "part")).where(F.col("part").rlike(entry))
    rest = strip(sub(strip(F.regexp_replace("part", entry, "")), r"\n{2,}", "\n"))
    rest = sub(strip(sub(rest, r"(?m)^\s*[0-9]{1,2}\.[0-9]{1,3}\s*$")), r"[ \t]+", " ")
    term = strip(F.replace(strip(F.regexp_extract("part", entry, 2), " :\\-​"), F.lit("  "), F.lit(" ")))
    rows = rows.select("file", "pos", F.regexp_extract("part", entry, 1).alias("section"), term.alias("term"), rest.alias("definition"))
    return rows.where((F.length("term") >= 2) & (F.length("definition") >= 3))


def terms_tagged(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """As terms_plain for texts with lines of junk before terms; definitions of ten characters or more, without page numbers at the end."""
    sections = F.split(sub(_text(text_col), r"\n\s*([0-9]{1,2}\.[0-9]{1,3})\s*\n", "\n\u0001 $1\n"), "\u0001")
    rows = files.select(F.col(file_col).alias("file"), F.posexplode(sections).alias("pos", "part"))
    rows = rows.select("file", "pos", F.filter(F.transform(F.split("part", "\n|\f"), lambda x: strip(x)), lambda x: x != "").alias("l")).where(F.size("l") > 0)
    numbered = F.get("l", F.lit(0)).rlike(r"^[0-9]{1,2}\.[0-9]{1,3}$")
    rows = rows.select("file", "pos", F.when(numbered, F.get("l", F.lit(0))).alias("section"), F.when(numbered, F.slice("l", F.lit(2), F.size("l"))).otherwise(F.col("l")).alias("l")).where(F.size("l") > 0)
    junk = F.get("l", F.lit(0)).rlike(r"^(?:정보통신단체표준.*|국문표준.*|[0-9]+)$")
    rows = rows.withColumn("_skip", F.when(junk, 1).otherwise(0)).where(F.size("l") > F.col("_skip"))
    body = collapse(F.array_join(F.slice("l", F.col("_skip") + 2, F.size("l")), " "))
    body = sub(body, r"(?U)\s*(?:\(?[0-9]{1,3}\)?\s*)+$")
    term = strip(sub(F.element_at("l", F.col("_skip") + 1), HYPHEN, "-"), " \\-–—:•·")
    rows = rows.select("file", "pos", "section", term.alias("term"), body.alias("definition")).where(F.length("definition") >= 10)
    return _once(rows)


def terms_two_lines(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """As terms_tagged, where a short or unclosed term goes on to the next line."""
    t = F.regexp_replace(_text(text_col), F.lit("\r\n|\r|\f"), F.lit("\n"))
    header = r"(?m)^\s*([0-9]{1,3}\.[0-9]{1,4})[ \t]*$"
    ids = F.regexp_extract_all(t, F.lit(header), F.lit(1))
    blocks = F.split(F.regexp_replace(t, F.lit(header), F.lit("\u0001")), "\u0001")
    rows = files.select(F.col(file_col).alias("file"), ids.alias("_ids"), F.posexplode(blocks).alias("pos", "part")).where("pos > 0")
    rows = rows.select("file", "pos", F.element_at("_ids", F.col("pos")).alias("section"), _filled(F.transform(F.split("part", "\n"), lambda x: strip(x))).alias("l")).where(F.size("l") > 0)
    first, second = F.get("l", F.lit(0)), F.try_element_at("l", F.lit(2))
    short = (F.length(first) < 6) | first.rlike("[(\\-–—]$") | (~F.contains(first, F.lit(")")) & (F.length(first) < 30) & (F.length(second) < 60))
    two = F.coalesce(second.isNotNull() & short, F.lit(False))
    term = strip(sub(sub(F.when(two, F.concat(first, F.lit(" "), second)).otherwise(first), HYPHEN, "-"), r"(?U)\s+", " "), " \\-–—:•·")
    body = F.array_join(F.slice("l", F.when(two, 3).otherwise(2), F.size("l")), " ")
    body = collapse(sub(sub(body, r"(?U)\s*(?:\(?[0-9]{1,3}\)?\s*)+$"), HYPHEN, "-"))
    rows = rows.select("file", "pos", "section", term.alias("term"), body.alias("definition")).where(F.length("definition") >= 10)
    return _once(rows)
