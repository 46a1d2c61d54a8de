"""URL lists with dates: every capture is judged by the list entries that were active when it was fetched.

A list is a log of dated entries: a pattern is added to it or removed from it. Per list and pattern the
entries are ordered in time and each addition becomes an interval [from, until) that the next removal
closes. A capture is looked up by the patterns that can cover it: its host and the host's parent domains, each
alone and, where the lists name it with a path, with the prefixes of the capture's path. So the join is an
equi-join on the pattern with the fetch time inside the interval, never a scan of all entries. Where a pattern
has a long history, its intervals are cut by periods, and a capture meets those of its own period only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Periods into which the fetch times are cut, and intervals of a pattern from which they are.
PERIODS, LONG_HISTORY = 64, 16


def _pattern(c: Column) -> Column:
    """An entry's pattern as host, or host and path: scheme, user, port and fragment go, the host is lower-case; null if none."""
    bare = F.regexp_replace(F.trim(c), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    found = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1), r"[.]+$", "")
    rest = F.regexp_extract(bare, "^[^/?#]*([^#]*)", 1)
    rest = F.concat(F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+", "/"), F.regexp_extract(rest, "^[^?]*(.*)$", 1))
    return F.when(found != "", F.concat(F.lower(found), F.when(rest == "/", "").otherwise(rest)))


def intervals(entries: DataFrame) -> DataFrame:
    """Turn (list, pattern, action, at) entries into (list, pattern, valid_from, valid_until), until null if still open.

    action is 'add' or 'remove', any other or a null in any column voids the entry, as does a pattern without a
    host. Repeated additions do not open a second interval; a removal without an addition does nothing; of an
    addition and a removal at one time the removal holds. A pattern is a host ("x.com", which covers its
    subdomains too) or a host with a path: "x.com/a/" covers what is below, "x.com/a" that page and what is below,
    "x.com/a?b=1" that page with that query. Hosts are lower-cased, paths kept as they are.
    """
    clean = entries.select(F.col("list").alias("_l"), _pattern(F.col("pattern")).alias("_p"), F.col("action").alias("_a"), F.col("at").alias("_t"))
    clean = clean.where(F.col("_a").isin("add", "remove")).dropna()
    state = clean.groupBy("_l", "_p", "_t").agg(F.max("_a").alias("_a"))  # 'remove' sorts last
    w = Window.partitionBy("_l", "_p").orderBy("_t")
    turns = state.withColumn("_was", F.lag("_a").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("_a")))
    spans = turns.withColumn("_until", F.lead("_t").over(w)).where(F.col("_a") == "add")
    return spans.select(F.col("_l").alias("list"), F.col("_p").alias("pattern"), F.col("_t").alias("valid_from"), F.col("_until").alias("valid_until"))


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def _parents(name: Column) -> Column:
    """The host and its parent domains; of an address only itself."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(name.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), F.array(name)).otherwise(domains)


def _paths(url: Column) -> Column:
    """The prefixes of a URL's path by whole segments, each with and without a final slash, and the path with its query."""
    rest = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    path, query = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+", "/"), F.regexp_extract(rest, "^[^?]*(.*)$", 1)
    cuts = F.filter(F.split(path, "/"), lambda x: x != "")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(cuts, F.lit(1), k), "/")))
    below = F.when(F.size(cuts) > 0, below).otherwise(F.array().cast("array<string>"))
    inner = F.filter(F.transform(below, lambda x: F.concat(x, F.lit("/"))), lambda x: path.startswith(x))
    return F.array_distinct(F.concat(F.array(F.lit("")), below, inner, F.array(F.concat(path, query))))


def _number(c: Column, kind: str) -> Column:
    return (c.cast("timestamp") if kind == "date" else c).cast("double")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Return id_col, url_col, at_col, host, lists (those active, sorted, comma-joined), n_lists and blocked, one row per capture.

    An entry is active from its time on and until, but not at, the time of its removal. A null or malformed
    URL, or a null fetch time, matches nothing and is not blocked; a null id is kept. Repeated captures are
    judged alike, each its own row. Times are numbers, dates or timestamps; where captures and entries differ in
    this, both count as timestamps, a date as its first moment, and at_col comes back as one. Other columns are ignored; without
    entries nothing is blocked.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((captures, at_col), (entries, "at"))]
    if kinds[0] != kinds[1] and set(kinds) <= {"date", "timestamp", "timestamp_ntz"}:
        captures, entries = captures.withColumn(at_col, F.col(at_col).cast("timestamp")), entries.withColumn("at", F.col("at").cast("timestamp"))
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(at_col).alias("_at"), host(F.col(url_col)).alias("_host"))
    kind = captures.schema[at_col].dataType.simpleString()
    spans = intervals(entries).withColumn("_domain", F.regexp_extract("pattern", r"^(\[[^\]]*\]|[^/?]*)", 1))
    spans = spans.withColumn("_path", F.expr("substring(pattern, length(_domain) + 1)"))
    spans = written(spans, "intervals")
    many = spans.groupBy("_domain", "_path").agg(F.count("*").alias("_n")).groupBy("_domain").agg((F.max("_n") >= LONG_HISTORY).alias("_long"), F.max(F.col("_path") != "").alias("_with_path"))

    # each distinct URL and time is judged once; a hot host has many of them, so the join can split it
    asked = rows.where(F.col("_host").isNotNull() & F.col("_at").isNotNull()).select("_url", "_at", "_host").distinct()
    low, high = rows.where("_host IS NOT NULL").agg(F.min(_number(F.col("_at"), kind)), F.max(_number(F.col("_at"), kind))).first()
    period = lambda c: F.floor((_number(c, kind) - F.lit(low or 0.0)) / F.lit(max((high or 0.0) - (low or 0.0), 1e-9)) * PERIODS).cast("long")
    within = lambda c: F.greatest(F.lit(0), F.least(F.lit(PERIODS), period(c)))

    # the domains of a host that the lists name
    named = asked.select("_host").distinct().select("_host", F.explode(_parents(F.col("_host"))).alias("_d"))
    named = named.join(many, F.col("_d") == F.col("_domain")).select(F.col("_host").alias("_h"), "_domain", "_long", "_with_path")
    named = written(named, "named-hosts")
    asked = asked.join(named, F.col("_host") == F.col("_h")).withColumn("_p", F.explode(F.when(F.col("_with_path"), _paths(F.col("_url"))).otherwise(F.array(F.lit("")))))
    asked = asked.select("_url", "_at", F.col("_domain").alias("_d"), "_p", F.when(F.col("_long"), within(F.col("_at"))).otherwise(F.lit(-1)).alias("_period"))

    cut = spans.join(many.select(F.col("_domain").alias("_d"), "_long"), F.col("_domain") == F.col("_d")).drop("_d")
    periods = F.sequence(within(F.col("valid_from")), F.when(F.col("valid_until").isNull(), F.lit(PERIODS)).otherwise(within(F.col("valid_until"))))
    cut = cut.withColumn("_cut", F.explode(F.when(F.col("_long"), periods).otherwise(F.array(F.lit(-1).cast("long")))))
    inside = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_until").isNull() | (F.col("_at") < F.col("valid_until")))
    found = asked.join(cut, (F.col("_d") == F.col("_domain")) & (F.col("_p") == F.col("_path")) & (F.col("_period") == F.col("_cut")) & inside)
    found = found.groupBy("_url", "_at").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("_lists"), F.countDistinct("list").alias("_n"))
    found = found.select(F.col("_url").alias("_u"), F.col("_at").alias("_t"), "_lists", "_n")
    out = rows.join(found, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_t")), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(at_col), F.col("_host").alias("host"),
        F.coalesce("_lists", F.lit("")).alias("lists"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_lists"), F.col("_lists").isNotNull().alias("blocked"),
    )
