"""The corpus operators over their whole tables, and SQL that states the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import decontaminate, embeddings, jaccard, langid, line_dedup, packing, pii, runs, sharding, snapshots, suffixes, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), host="source")
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with each tag on a line of its own, cleaned of the lines that a host repeats."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<"), F.lit("\n<")).alias("html"))
    out = line_dedup.dedup_lines(pages, url_filter.host(F.col("url")), "page_id", "html")
    return out.select("page_id", F.md5(F.col("html").cast("binary")).alias("html_md5"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_read(spark, sf_dir, "documents"), with_text=False)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that plain patterns decide."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_read(spark, sf_dir, "pages"))
    records = warc.read_warc(manifest, with_payload=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of op3 with every fiftieth record's compressed bytes damaged: what comes back, and that gaps are logged."""
    manifest = warc.read_warc(warc.damaged(warc.write_warc(_read(spark, sf_dir, "pages")), lambda page: page is not None and page % 50 == 7), with_payload=False)
    gaps = manifest.where("kind = 'gap' AND `end` > start").select("kind", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("payload_digest")).distinct()
    return manifest.where("kind = 'record'").select("kind", "page_id", "payload_digest").unionByName(gaps)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


#: Dated entries made of the hosts that the captures show, since no table holds any: day numbers of 2024.
_HOST = r"regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)"


def url_entries(captures: DataFrame) -> DataFrame:
    """A made-up list history over the hosts, and some of the pages, of captures: (list, pattern, action, at), at in seconds."""
    hosts = captures.select(F.expr(_HOST).alias("h")).where("h <> ''").distinct()
    hosts = hosts.withColumn("k", F.expr("cast(conv(substring(md5(h), 1, 4), 16, 10) AS BIGINT)"))
    day = lambda e: f"1704067200L + 86400L * ({e})"
    events = [
        ("spam", "h", "add", "k % 200", "k % 3 <> 0"), ("spam", "h", "remove", "k % 200 + 60", "k % 3 <> 0"), ("spam", "h", "add", "k % 200 + 120", "k % 3 = 1"),
        ("adult", "concat(h, '/de/')", "add", "k % 150", "true"), ("adult", "concat(h, '/de/')", "remove", "k % 150 + 30 + k % 100", "k % 2 = 0"),
        ("mirror", "concat(h, '/fr')", "add", "k % 250", "k % 4 = 1"),
        ("malware", "regexp_extract(h, '[^.]+[.][^.]+[.][^.]+$', 0)", "add", "k % 300", "k % 5 < 2"),
    ]
    parts = [hosts.where(cond).select(F.lit(name).alias("list"), F.expr(pattern).alias("pattern"), F.lit(act).alias("action"), F.expr(day(at)).alias("at")) for name, pattern, act, at, cond in events]
    page = F.regexp_replace("url", "^https?://|[?#].*$", "")
    out = captures.where("page_id % 10 = 3").select(F.lit("phish").alias("list"), page.alias("pattern"), F.lit("add").alias("action"), F.expr(day("page_id % 300")).alias("at"))
    for p in parts:
        out = out.unionByName(p)
    return out.where("pattern <> ''")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch times are made up from page_id, spread over 2024."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.expr("1704067200L + (page_id * 7919L) % 366L * 86400L + page_id % 86400L").alias("fetched_at"))
    return url_filter.filter_urls(pages, url_entries(pages))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"), 40)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), packing.default_tokenizer())


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.drop_repeated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """The contract's texts: of a tenth of the documents, chosen by the CRC-32 of the id, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    docs = docs.withColumn("a", F.expr("IF(size(w) > 0, g % size(w), NULL)"))
    docs = docs.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    return docs.withColumn("text", F.expr("IF(a IS NULL, text, array_join(transform(w, (v, i) -> IF(i < a, v, w[int(a + (i - a) % p)])), ' '))")).select("doc_id", "text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periodic_ends(_read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The contract's later snapshot of (doc_id, text, lang, source): the CRC-32 of the id, modulo 25, says what becomes of a row."""
    docs = docs.select("doc_id", "text", "lang", "source", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25).alias("r")).where("r IS NULL OR r <> 0")
    moved = -1 - F.col("doc_id")
    keys = F.when(F.col("r") == 5, F.array("doc_id", moved)).when(F.col("r").isin(3, 4), F.array(moved)).otherwise(F.array("doc_id"))
    return docs.select(
        F.explode(keys).alias("doc_id"), F.when(F.col("r") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("r") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"), F.when(F.col("r") == 2, F.col("lang")).when((F.col("r") == 4), F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    row = F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in ("text", "lang", "source"))).cast("binary"), 256)
    found = snapshots.difference(docs, later_snapshot(docs).withColumn("row_sha256", row), "doc_id", ["text", "lang", "source"], ["text", "lang"], carry=("row_sha256",))
    return found.withColumn("changed", F.array_join("changed", ","))


QUERIES = {f.__name__: f for f in (op1_line_dedup, page_lines, op2_pii, pii_base, op3_warc, warc_salvage, op4_decontaminate, op5_url_filter, op6_jaccard_join, op7_pivot_index, op8_sharding, op9_language_id, op10_packing, op11_suffix_dedup, op12_periodic_runs, op13_snapshot_diff)}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL.format(min_pages=2, max_ratio=0.1),
    "page_lines": "WITH documents AS (SELECT page_id AS doc_id, nullif(rtrim(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]+)', 1), '.'), '') AS source, replace(html, '<', chr(10) || '<') AS text FROM pages),\n"
    + line_dedup.SQL.format(min_pages=2, max_ratio=0.1).replace("WITH hosted", "hosted").replace("SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text", "SELECT p.doc_id AS page_id, CASE WHEN p.text IS NULL THEN NULL ELSE md5(k.text) END AS html_md5"),
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m > page_id THEN m END AS refers_to FROM g
""",
    "pii_base": pii.SQL,
    "warc_salvage": """
SELECT 'record' AS kind, page_id, sha1(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id % 50 <> 7 UNION ALL SELECT DISTINCT 'gap', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM pages WHERE page_id % 50 = 7
""",
    "op4_decontaminate": decontaminate.SQL,
    "op5_url_filter": r"""
WITH caps AS (SELECT page_id, url, 1704067200 + (page_id * 7919) % 366 * 86400 + page_id % 86400 AS fetched_at,
  regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS h FROM pages),
hosts AS (SELECT h, CAST('0x' || substring(md5(h), 1, 4) AS BIGINT) AS k FROM (SELECT DISTINCT h FROM caps WHERE h <> '') x),
log AS (
  SELECT 'spam' AS list, h AS pattern, 'add' AS action, k % 200 AS day FROM hosts WHERE k % 3 <> 0
  UNION ALL SELECT 'spam', h, 'remove', k % 200 + 60 FROM hosts WHERE k % 3 <> 0
  UNION ALL SELECT 'spam', h, 'add', k % 200 + 120 FROM hosts WHERE k % 3 = 1
  UNION ALL SELECT 'adult', h || '/de/', 'add', k % 150 FROM hosts
  UNION ALL SELECT 'adult', h || '/de/', 'remove', k % 150 + 30 + k % 100 FROM hosts WHERE k % 2 = 0
  UNION ALL SELECT 'mirror', h || '/fr', 'add', k % 250 FROM hosts WHERE k % 4 = 1
  UNION ALL SELECT 'phish', regexp_replace(url, '^https?://|[?#].*$', '', 'g'), 'add', page_id % 300 FROM caps WHERE page_id % 10 = 3
  UNION ALL SELECT 'malware', regexp_extract(h, '[^.]+[.][^.]+[.][^.]+$', 0), 'add', k % 300 FROM hosts WHERE k % 5 < 2),
entries AS (SELECT list, pattern, split_part(pattern, '/', 1) AS ph, substr(pattern, length(split_part(pattern, '/', 1)) + 1) AS pp, action, 1704067200 + 86400 * day AS at_ FROM log WHERE pattern <> ''),
judged AS (
  SELECT c.page_id, e.list,
    max(e.at_) FILTER (WHERE e.action = 'add') AS added, max(e.at_) FILTER (WHERE e.action = 'remove') AS removed
  FROM (SELECT *, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://[^/]*', '') AS path FROM caps) c
  JOIN entries e ON e.at_ <= c.fetched_at AND (c.h = e.ph OR ends_with(c.h, '.' || e.ph))
    AND (e.pp = '' OR c.path = e.pp OR starts_with(c.path, CASE WHEN ends_with(e.pp, '/') THEN e.pp ELSE e.pp || '/' END))
  GROUP BY c.page_id, e.list, e.pattern),
active AS (SELECT page_id, list FROM judged WHERE added IS NOT NULL AND (removed IS NULL OR added > removed) GROUP BY page_id, list),
lists AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, count(*) AS n FROM active GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, c.h AS host, coalesce(l.lists, '') AS lists, coalesce(l.n, 0) AS n_lists, l.n IS NOT NULL AS blocked
FROM caps c LEFT JOIN lists l USING (page_id)
""",
    "op8_sharding": sharding.SQL.format(seed=17, shards=40),
    "op7_pivot_index": embeddings.SQL.format(limit=0.95),
    "op13_snapshot_diff": """
WITH crc_table AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
e AS (SELECT doc_id AS key, text, lang, source, xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 25 AS r FROM documents, crc_table),
l AS (
  SELECT CASE WHEN r IN (3, 4) THEN -1 - key ELSE key END AS key, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE WHEN r = 2 THEN lang WHEN r = 4 THEN NULL ELSE source END AS source FROM e WHERE r IS DISTINCT FROM 0
  UNION ALL SELECT -1 - key, text, lang, source FROM e WHERE r = 5),
eu AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY key) AS i FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.key = e.key)),
lu AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY key DESC) AS i FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE l.key = e.key)),
p AS (
  SELECT l.key, e.key AS old_key, 'k' AS how, e.text AS t0, e.lang AS l0, e.source AS s0, l.text, l.lang, l.source FROM e JOIN l ON e.key = l.key
  UNION ALL SELECT coalesce(lu.key, eu.key), eu.key, CASE WHEN eu.i IS NULL THEN 'insert' WHEN lu.i IS NULL THEN 'delete' ELSE 'rekey' END, eu.text, eu.lang, eu.source, lu.text, lu.lang, lu.source
    FROM eu FULL JOIN lu ON eu.text IS NOT DISTINCT FROM lu.text AND eu.lang IS NOT DISTINCT FROM lu.lang AND eu.i = lu.i),
c AS (SELECT *, CASE WHEN how IN ('k', 'rekey') THEN concat_ws(',', CASE WHEN t0 IS DISTINCT FROM text THEN 'text' END, CASE WHEN l0 IS DISTINCT FROM lang THEN 'lang' END, CASE WHEN s0 IS DISTINCT FROM source THEN 'source' END) ELSE '' END AS changed FROM p)
SELECT key, old_key, CASE WHEN how <> 'k' THEN how WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
  CASE WHEN how <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256 FROM c
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 5 >= (x.n + y.n - c) * 4),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(deg.n, 0) AS n_links, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN low ON low.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id
""",
}
