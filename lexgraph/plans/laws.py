"""Law queries: on literal Korean texts, and at scale on articles made of the documents, which hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import law, names
from .registry import literal, query, table, values

REFS = [
    (1, "제2조 (정의) 제5조의2 및 제7조에 따른다. 개인정보보호법 제28조의2에 의한다. 제10조부터 제12조까지의 규정을 준용한다.", "10,11,12,2,28의2,5의2,7"), (2, "제9조부터 제7조까지", "7,8,9"), (3, "", ""), (4, "없음", ""), (5, "제3조 제1항 및 제3조", "3"),
    (6, "제 5 조 의 3과 제4조 이상 제6조 이하", "4,5,5의3,6"),
]


TREE = [("A", "머리글\n제1장 총칙\n제1조(목적) 목적을 정한다.\n제2조 정의\n① 첫째 항은 제1조를 따른다.\n1. 첫 호\n가. 첫 목\n이어진 글\n제3조 삭제\n제1절 세칙\n제4조의2 벌칙\n1. 호만 있다"), ("B", "제1조 하나")]
_NODES = [
    ("A", 0, None, "법률", "", "머리글", "false"), ("A", 2, 0, "장", "제1장 총칙", "", "false"), ("A", 3, 2, "조", "제1조 목적", "목적을 정한다.", "false"), ("A", 4, 2, "조", "제2조", "정의", "false"), ("A", 5, 4, "항", "①", "첫째 항은 제1조를 따른다.", "false"),
    ("A", 6, 5, "호", "1", "첫 호", "false"), ("A", 7, 6, "목", "가", "첫 목\n이어진 글", "false"), ("A", 9, 2, "조", "제3조", "", "true"), ("A", 10, 2, "절", "제1절 세칙", "", "false"), ("A", 11, 10, "조", "제4조의2", "벌칙", "false"), ("A", 12, 11, "호", "1", "호만 있다", "false"),
    ("B", 0, None, "법률", "", "", "false"), ("B", 1, 0, "조", "제1조", "하나", "false"),
]


@query("WITH " + values(_NODES, "n", "law, node_id, parent_id, label, title, text, deleted") + """, t AS (SELECT * FROM n UNION ALL
  SELECT 'L' || doc_id, node_id, parent_id, label, title, CASE node_id WHEN 0 THEN 'w' || doc_id || chr(10) || text ELSE text END, deleted FROM documents, n WHERE law = 'A')
SELECT law, CAST(node_id AS BIGINT) + CASE WHEN law LIKE 'L%' AND node_id > 0 THEN 1 ELSE 0 END AS node_id, CAST(parent_id AS BIGINT) + CASE WHEN law LIKE 'L%' AND parent_id > 0 THEN 1 ELSE 0 END AS parent_id, label, title, text, CAST(deleted AS BOOLEAN) AS deleted FROM t""".replace("|| text ELSE text", "|| n.text ELSE n.text"))
def law_tree_nodes(spark, d):
    """Literal laws, and one made of every document with a line of its own before all others."""
    more = table(spark, d, "documents").select(F.concat(F.lit("L"), "doc_id"), F.concat(F.lit("w"), "doc_id", F.lit("\n" + TREE[0][1])))
    return law.parse_laws(literal(spark, TREE, "law string, text string").union(more)).select("law", "node_id", "parent_id", "label", "title", "text", "deleted")


_MADE = """
SELECT source || '_제' || doc_id || '조' AS aid, '제' || doc_id || '조' AS title, source AS law, doc_id AS ord, doc_id * 7 % 1000 AS a, doc_id * 13 % 1000 AS b, 'src' || (doc_id % 7) AS named, doc_id % 5 AS kind, text FROM documents"""


def articles(spark, d):
    """An article per document: its source is the law, its id the number; two citations and a cue stand before the text."""
    docs = table(spark, d, "documents")
    cue = F.when(F.col("doc_id") % 5 == 0, "벌금에 처한다. ").when(F.col("doc_id") % 5 == 1, "다만, ").when(F.col("doc_id") % 5 == 2, "준용 ").otherwise("")
    article = lambda n: F.concat(F.lit("제"), n.cast("string"), F.lit("조"))
    text = F.concat(cue, article(F.col("doc_id") * 7 % 1000), F.lit("를 본다. src"), (F.col("doc_id") % 7).cast("string"), F.lit(" "), article(F.col("doc_id") * 13 % 1000), F.lit("를 본다.\n"), "text")
    return docs.select(F.concat("source", F.lit("_"), article(F.col("doc_id"))).alias("aid"), article(F.col("doc_id")).alias("title"), text.alias("text"), F.col("source").alias("law"), F.col("doc_id").alias("ord"))


@query("WITH " + values([(a, c) for a, _, c in REFS], "t", "id, keys") + """ SELECT 'fixture' AS kind, id, keys FROM t
UNION ALL SELECT 'document', doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct([CAST(doc_id * 7 % 1000 AS VARCHAR), CAST(doc_id * 13 % 1000 AS VARCHAR)])), ',') END FROM documents""")
def ref_keys(spark, d):
    """Literal citations, and those in the whole text of every article."""
    rows = literal(spark, [r[:2] for r in REFS], "id long, s string").select(F.lit("fixture").alias("kind"), "id", "s")
    rows = rows.union(articles(spark, d).select(F.lit("document"), "ord", "text"))
    return rows.select("kind", "id", F.array_join(law.reference_keys("s"), ",").alias("keys"))


_EDGES = f"""
WITH RECURSIVE m AS ({_MADE}),
e AS (SELECT DISTINCT x.aid AS src, y.aid AS dst, CASE x.kind WHEN 0 THEN '벌칙' WHEN 1 THEN '예외' WHEN 2 THEN '적용' ELSE '참조' END AS relation
  FROM m x JOIN m y ON y.ord IN (x.a, x.b) WHERE x.aid <> y.aid)"""


@query(_EDGES + " SELECT src, dst, relation FROM e")
def citation_edges(spark, d):
    """Every number is that of one document, so each citation finds it."""
    return law.citation_edges(articles(spark, d))


@query(f"""
WITH m AS ({_MADE}) SELECT DISTINCT x.aid AS src, y.aid AS dst, CASE x.kind WHEN 0 THEN '벌칙' WHEN 1 THEN '예외' WHEN 2 THEN '적용' ELSE '참조' END AS relation
FROM m x JOIN m y ON y.ord IN (x.a, x.b) AND contains(y.aid, x.law) WHERE x.aid <> y.aid""")
def citation_edges_by_id(spark, d):
    return law.citation_edges_by_id(articles(spark, d))


@query(f"WITH m AS ({_MADE}) SELECT aid, named AS law, CAST(b AS VARCHAR) AS article FROM m")
def cross_law_refs(spark, d):
    rows = articles(spark, d).select("aid", F.explode(law.cross_law_refs("text")).alias("r")).select("aid", F.regexp_extract("r.law", "(src[0-9]+)$", 1).alias("law"), F.col("r.article").alias("article"))
    return rows.where("law <> ''")


_HOPS = ", b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT ord AS query_id, aid AS id, 0 AS hop FROM m WHERE ord % 20 = 0), h1 AS (SELECT DISTINCT query_id, b.b AS id FROM h0 JOIN b ON h0.id = b.a), h2 AS (SELECT DISTINCT query_id, b.b AS id FROM h1 JOIN b ON h1.id = b.a), a AS (SELECT * FROM h0 UNION ALL SELECT query_id, id, 1 FROM h1 UNION ALL SELECT query_id, id, 2 FROM h2)"


@query(_EDGES + _HOPS + " SELECT query_id, id, CAST(min(hop) AS BIGINT) AS hop FROM a GROUP BY query_id, id")
def khop_expand(spark, d):
    made = articles(spark, d)
    seeds = made.where(F.col("ord") % 20 == 0).select(F.col("ord").alias("query_id"), F.col("aid").alias("id"))
    return law.expand(law.citation_edges(made), seeds, 2)


@query(_EDGES + " SELECT count(*) AS edges, count(*) FILTER (WHERE x.law <> y.law) AS cross, round(coalesce(count(*) FILTER (WHERE x.law <> y.law) * 100.0 / nullif(count(*), 0), 0), 2) AS ratio FROM e JOIN m x ON x.aid = src JOIN m y ON y.aid = dst".replace(" AS cross", ' AS "cross"'))
def cross_law_ratio(spark, d):
    made = articles(spark, d)
    return law.cross_law_ratio(law.citation_edges(made), made.select(F.col("aid").alias("id"), "law"))


@query("""
SELECT source || '_제' || (doc_id % 10) || '조' AS aid, '제' || (doc_id % 10) || '조' AS title, source AS law, min(doc_id) AS ord, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS text FROM documents GROUP BY ALL""")
def merge_articles(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("제"), F.col("doc_id") % 10, F.lit(" 조 제목")).alias("title"), "text", F.col("source").alias("law"), F.col("doc_id").alias("ord"))
    return law.merge_articles(docs).withColumn("text", F.md5(F.col("text").cast("binary")))


SPLIT = [("제1조 목적 가 제2조의3 정의 나", "제1조|제2조의3", "목적 가|정의 나"), ("앞 글 제 7 조 끝", "제 7 조", "끝"), ("없음", "", "")]


@query("WITH " + values(SPLIT, "t", "s, titles, bodies") + """ SELECT s, titles, bodies FROM t
UNION ALL SELECT '제1조 목적 w' || doc_id || ' 제2조의3 정의 v' || doc_id % 97, '제1조|제2조의3', '목적 w' || doc_id || '|정의 v' || doc_id % 97 FROM documents""")
def article_split(spark, d):
    """Literal texts, and one made of every document."""
    parts = law.split_articles("s")
    rows = literal(spark, [(r[0],) for r in SPLIT], "s string").union(table(spark, d, "documents").selectExpr("'제1조 목적 w' || doc_id || ' 제2조의3 정의 v' || doc_id % 97"))
    return rows.select("s", F.array_join(F.transform(parts, lambda x: x["title"]), "|").alias("titles"), F.array_join(F.transform(parts, lambda x: x["body"]), "|").alias("bodies"))


_NAMES = "names AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS name FROM benchmark UNION SELECT source FROM documents WHERE source <> '' UNION SELECT name FROM vendors WHERE name <> '' UNION SELECT brand FROM items WHERE brand <> '')"


def _names(spark, d):
    """Names of several tables: sources, vendors, brands and the first three words of the benchmark's items."""
    found = table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    for t, c in (("documents", "source"), ("vendors", "name"), ("items", "brand")):
        found = found.union(table(spark, d, t).select(c))
    return found.where("name <> ''").distinct()


@query("WITH " + _NAMES + """,
hits AS (SELECT DISTINCT doc_id, name, length(name) AS n, unnest(list_filter(range(1, length(text) - length(name) + 2), lambda i: text[i:i + length(name) - 1] = name)) AS s FROM (SELECT DISTINCT doc_id, text FROM documents) x JOIN names ON contains(text, name))
SELECT doc_id, name, count(*) AS n, min(s) - 1 AS first FROM hits GROUP BY doc_id, name""")
def name_mentions(spark, d):
    """Every occurrence of every name, also within others."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    return names.mentions(docs, _names(spark, d), longest=False).groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min("start").alias("first"))
