"""Queries on what is made of hits: contexts, routes, best answers, diversified lists, choice questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.predicates import domain_meta
from ..operators import bm25, context, dense, law, records, retrieve
from ..providers import hashed_encoder, reranked
from .laws import _EDGES, articles
from .registry import _sql, query, table
from .retrieval import _DENSE, _LEX, _TOP, _asked, _vectors

_POSITIVE = _LEX + """scored AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id), """ + _TOP.rstrip()
_TWO = r"trim(array_to_string(list_filter(string_split(regexp_replace(trim(text, chr(32) || chr(10)), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], lambda x: x <> ''), ' '), chr(32) || chr(10))"


@query(_POSITIVE + rf""",
h AS (SELECT query_id, rank, doc_id, source, text, {_TWO} AS two FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 AND score > 0),
l AS (SELECT query_id, rank, unnest([
  struct_pack(kind := 'snippets', line := '(#' || rank || ') [' || source || ':0-' || length(text) || ']' || chr(10) || replace(text, chr(10), ' ')), struct_pack(kind := 'titled', line := '(#' || rank || ') [' || source || '] ' || text),
  struct_pack(kind := 'headed', line := '[REF]' || chr(10) || replace(substring(text, 1, 400), chr(10), ' ')), struct_pack(kind := 'bulleted', line := CASE WHEN two = '' THEN '' WHEN length(two) <= 220 THEN '- ' || two ELSE '- ' || regexp_replace(substring(two, 1, 220), '\s+$', '') || '…' END),
  struct_pack(kind := 'chunked', line := '[' || rank || '] (' || source || ' #' || doc_id || ')' || chr(10) || text), struct_pack(kind := 'numbered', line := rank || ') ' || source || chr(10) || text)]) AS l FROM h),
ctx AS (SELECT query_id, l.kind AS kind, CASE l.kind WHEN 'bulleted' THEN array_to_string(list(l.line ORDER BY rank), chr(10)) ELSE array_to_string(list(l.line ORDER BY rank), chr(10) || chr(10)) END AS c FROM l WHERE l.line <> '' GROUP BY query_id, l.kind)
SELECT query_id, kind, md5(CASE kind WHEN 'snippets' THEN {_sql(fixed.GUIDE_REFERENCE)} || chr(10) || chr(10) || c WHEN 'titled' THEN {_sql(fixed.GUIDE_TERMS)} || chr(10) || chr(10) || c WHEN 'headed' THEN {_sql(fixed.GUIDE_ATTACK)} || chr(10) || chr(10) || c
  WHEN 'chunked' THEN CASE WHEN length(c) <= 2000 THEN c ELSE trim(substring(c, 1, 2000), chr(32) || chr(10)) || chr(10) || '…(생략)' END ELSE c END) AS context FROM ctx""")
def context_forms(spark, d):
    """The six further kinds of contexts, of the best three documents of every benchmark item."""
    _, terms = _asked(spark, d)
    docs = table(spark, d, "documents")
    hits = bm25.top(bm25.positive(bm25.Index.build(docs, only=terms), terms, most=3), 3)
    rows = hits.join(docs.select("doc_id", "text", "source", F.lit(0).alias("start"), F.length("text").alias("end"), F.col("source").alias("title"), F.col("source").alias("file"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("snippet"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("header")), "doc_id")
    out = None
    for kind in ("snippets", "titled", "headed", "bulleted", "chunked", "numbered"):
        part = getattr(context, kind)(rows).select("query_id", F.lit(kind).alias("kind"), F.md5(F.col("context").cast("binary")).alias("context"))
        out = part if out is None else out.unionByName(part)
    return out


_ROUTED = "CASE item_id % 3 WHEN 0 THEN '시행령 ' WHEN 1 THEN 'T1059 ' ELSE '' END || text"


@query("""
WITH q AS (SELECT item_id AS query_id, item_id % 3 AS k, item_id % 5 = 0 AS missed FROM benchmark)
SELECT 'soft' AS way, query_id, query_id * 2 AS doc_id, 'law' AS side FROM q WHERE NOT missed UNION ALL SELECT 'soft', query_id, query_id * 3, 'mitre' FROM q
UNION ALL SELECT 'hard', query_id, query_id * 2, 'law' FROM q WHERE k IN (0, 2) AND NOT missed UNION ALL SELECT 'hard', query_id, query_id * 3, 'mitre' FROM q WHERE k IN (1, 2) OR (k = 0 AND missed)""")
def dual_routes(spark, d):
    """Hits of two retrievers, both asked or the one of the question's domain; the first finds nothing for every fifth."""
    queries = table(spark, d, "benchmark").selectExpr("item_id AS query_id", f"{_ROUTED} AS query")
    first, second = (lambda q: q.where("query_id % 5 <> 0").selectExpr("query_id", "query_id * 2 AS doc_id")), (lambda q: q.selectExpr("query_id", "query_id * 3 AS doc_id"))
    soft, hard = (retrieve.dual(queries, first, second, way).select(F.lit(way).alias("way"), "query_id", "doc_id", "side") for way in ("soft", "hard"))
    return soft.unionByName(hard)


_OVERLAP = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / (sqrt(len(list_distinct(x))) * sqrt(len(list_distinct(y))) + 1e-6) END"


@query(f"""
WITH c AS (SELECT item_id AS query_id, 'law' AS side, text AS query, text AS context, 'x' || item_id AS answer, item_id % 2 = 0 AS preferred FROM benchmark UNION ALL SELECT item_id, 'mitre', text, reverse(text), text, false FROM benchmark),
t AS (SELECT *, regexp_extract_all(query, '[가-힣A-Za-z0-9]+') AS x, regexp_extract_all(context, '[가-힣A-Za-z0-9]+') AS y FROM c), o AS (SELECT *, {_OVERLAP} AS o FROM t),
s AS (SELECT *, o + 0.02 * least(length(answer), 400) + CASE WHEN preferred THEN 0.1 * o ELSE 0 END AS s FROM o),
k AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'law' ELSE 'mitre' END AS side FROM (SELECT item_id AS query_id FROM benchmark) b)
SELECT 'open' AS kind, query_id, side, answer FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, side DESC) = 1 UNION ALL SELECT 'choice', query_id, side, side FROM k""")
def best_answers(spark, d):
    """Of two candidate answers the better one: by overlap, length and preference, or by confidence and overlap."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    one = rows.select("query_id", F.lit("law").alias("side"), "query", F.col("query").alias("context"), F.concat(F.lit("x"), "query_id").alias("answer"), (F.col("query_id") % 2 == 0).alias("preferred"))
    two = rows.select("query_id", F.lit("mitre").alias("side"), "query", F.reverse("query").alias("context"), F.col("query").alias("answer"), F.lit(False).alias("preferred"))
    sure = lambda side, on: rows.select("query_id", F.lit(side).alias("side"), F.lit(side).alias("answer"), F.when(on, 0.9).otherwise(0.2).alias("confidence"), F.lit(0.5).alias("overlap"))
    choices = retrieve.best_choice(sure("law", F.col("query_id") % 3 == 0).unionByName(sure("mitre", F.col("query_id") % 3 != 0)))
    return retrieve.best_answer(one.unionByName(two)).select(F.lit("open").alias("kind"), "query_id", "side", "answer").unionByName(choices.select(F.lit("choice").alias("kind"), "query_id", "side", "answer"))


@query("""
WITH q AS (SELECT doc_id AS query_id, lang AS query FROM documents), f AS (SELECT query, min(query_id) AS first FROM q GROUP BY query)
SELECT query_id, first * 10 AS doc_id FROM q JOIN f USING (query)""")
def asked_once(spark, d):
    """Every distinct question is asked once, by its first asker, and all get the hits."""
    queries = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query"))
    return retrieve.once_per_query(queries, lambda q: q.select("query_id", (F.col("query_id") * 10).alias("doc_id")))


@query("""
WITH h AS (SELECT doc_id % 50 AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, text FROM documents),
few AS (SELECT item_id AS query_id FROM benchmark), pad AS (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 6)
SELECT 'reranked' AS kind, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank, doc_id) AS rank FROM h
UNION ALL SELECT 'fallback', query_id, CASE WHEN query_id % 2 = 0 THEN 1 ELSE 2 END, 1 FROM few
UNION ALL SELECT 'filled', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id = query_id % 2 THEN 1.0 ELSE 0.0 END DESC, doc_id) FROM few, pad QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id = query_id % 2 THEN 1.0 ELSE 0.0 END DESC, doc_id) <= 3""")
def ranked_lists(spark, d):
    """Reranked candidates, hits of a second search where the first has none, and lists filled with unmatched documents."""
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    from pyspark.sql import Window

    hits = docs.select((F.col("doc_id") % 50).alias("query_id"), "doc_id", "text", F.lit("q").alias("query")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    again = reranked(hits, lambda q, t: F.length(t)).select(F.lit("reranked").alias("kind"), "query_id", "doc_id", "rank")
    scores = lambda doc, which: queries.where(which).select("query_id", F.lit(doc).cast("long").alias("doc_id"), F.lit(1.0).alias("score"))
    fallback = bm25.top(bm25.with_fallback(scores(1, "query_id % 2 = 0"), scores(2, "true")), 1).select(F.lit("fallback").alias("kind"), "query_id", "doc_id", "rank")
    own = queries.select("query_id", (F.col("query_id") % 2).alias("doc_id"), F.lit(1.0).alias("score"))
    filled = bm25.top(bm25.zero_filled(own, queries, docs, 3), 3).select(F.lit("filled").alias("kind"), "query_id", "doc_id", "rank")
    return again.unionByName(fallback).unionByName(filled)


def _picks(candidates: str, k: int, trade: float, first: str) -> str:
    """Picks p1 to pk by maximal marginal relevance among candidates (query_id, doc_id, near, v, and what `first` orders by)."""
    parts = [f"p1 AS (SELECT query_id, doc_id, v FROM {candidates} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {first}) = 1)"]
    parts.append(f"s1 AS (SELECT c.query_id, c.doc_id, c.near, c.v, list_dot_product(c.v, p.v) AS worst FROM {candidates} c JOIN p1 p USING (query_id) WHERE c.doc_id <> p.doc_id)")
    for n in range(2, k + 1):
        parts.append(f"p{n} AS (SELECT query_id, doc_id, v FROM s{n - 1} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({trade} * near - {1 - trade} * worst, 9) DESC, doc_id) = 1)")
        parts.append(f"s{n} AS (SELECT s.query_id, s.doc_id, s.near, s.v, greatest(worst, list_dot_product(s.v, p.v)) AS worst FROM s{n - 1} s JOIN p{n} p USING (query_id) WHERE s.doc_id <> p.doc_id)")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT query_id, doc_id, {n} AS pick FROM p{n}" for n in range(1, k + 1))


@query("WITH " + _DENSE.format(which="a.vec_id % 20 = 0", k=50).strip() + """,
c AS (SELECT d.query_id, d.doc_id, d.rank, CAST(b.embedding AS DOUBLE[]) AS v, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS near FROM dense d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.doc_id),
""" + _picks("c", 5, 0.65, "rank"))
def mmr_candidates(spark, d):
    """Five diverse ones of each query's fifty."""
    rows, asked = _vectors(spark, d)
    hits = dense.search(rows, asked, 50, id_col="vec_id")
    candidates = hits.join(rows.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(asked, "query_id")
    return dense.mmr(candidates, 5)


@query("""WITH c AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CAST(b.embedding AS DOUBLE[]) AS v, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS near FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
""" + _picks("c", 4, 0.5, "round(near, 9) DESC, doc_id"))
def mmr_corpus(spark, d):
    """Four diverse ones of all vectors for every twentieth."""
    rows, asked = _vectors(spark, d)
    return dense.mmr_whole(rows, asked, 4, id_col="vec_id")


_ARTICLE_TEXT = "CASE doc_id % 5 WHEN 0 THEN '벌금에 처한다. ' WHEN 1 THEN '다만, ' WHEN 2 THEN '준용 ' ELSE '' END || '제' || (doc_id * 7 % 1000) || '조를 본다. src' || (doc_id % 7) || ' 제' || (doc_id * 13 % 1000) || '조를 본다.' || chr(10) || text"
_PLACES = """b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), ar AS (SELECT query_id, id, 0 AS hop, rank FROM seeds UNION ALL SELECT DISTINCT s.query_id, b.b, 1, 1073741824 FROM seeds s JOIN b ON b.a = s.id WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.id = b.b)),
pl AS (SELECT query_id, id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank, id) AS place FROM ar)"""
_SUMMARY = r"CASE WHEN length(trim(text, chr(32) || chr(10))) <= 120 THEN trim(text, chr(32) || chr(10)) ELSE regexp_replace(substring(trim(text, chr(32) || chr(10)), 1, 120), '\s+$', '') || '…' END"
_WORDS_A = "regexp_extract_all({}, '[0-9A-Za-z가-힣]+')"


@query(_EDGES + rf""",
n AS (SELECT source || '_제' || doc_id || '조' AS id, '제' || doc_id || '조' AS title, {_ARTICLE_TEXT} AS text FROM documents), dw AS (SELECT id, {_WORDS_A.format("title || chr(10) || text")} AS w FROM n),
p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM dw) x GROUP BY ALL), dl AS (SELECT id, len(w) AS dl FROM dw), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, c), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_WORDS_A.format("text")}) AS term FROM benchmark) x GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (id), c GROUP BY query_id, id),
seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)) AS rank FROM sc QUALIFY rank <= 3),
""" + _PLACES + f"""
SELECT query_id, place, id, hop, title, {_SUMMARY} AS summary FROM pl JOIN n USING (id) WHERE place <= 5""")
def graph_query(spark, d):
    """Lexical seeds among articles made of the documents, and what they cite, for the benchmark's items."""
    made = articles(spark, d)
    nodes = made.select(F.col("aid").alias("id"), "title", "text")
    return retrieve.graph_query(nodes, law.citation_edges(made), _asked(spark, d)[0], 3, 1, 5)


_BAG = """SELECT id, i, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS v FROM (
  SELECT id, CAST('0x' || substr(md5(w), 15, 2) AS BIGINT) % 64 AS i, CAST(sum(CASE WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS v
  FROM (SELECT id, unnest(regexp_extract_all(lower({}), '[가-힣A-Za-z0-9]+')) AS w FROM {}) x GROUP BY ALL) y"""


@query(_EDGES + rf""",
n AS (SELECT source || '_제' || doc_id || '조' AS id, '제' || doc_id || '조' AS title, {_ARTICLE_TEXT} AS text FROM documents),
nv AS ({_BAG.format("concat_ws(chr(10), title, text)", "n")}), qv AS ({_BAG.format("text", "(SELECT item_id AS id, text FROM benchmark) b")}),
sc AS (SELECT q.id AS query_id, n.id, round(sum(CAST(q.v AS DOUBLE) * n.v), 6) AS score FROM qv q JOIN nv n USING (i) GROUP BY ALL),
seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)) AS rank FROM sc QUALIFY rank <= 3),
""" + _PLACES + f""",
l AS (SELECT query_id, place, '[' || title || '] ' || {_SUMMARY} AS line FROM pl JOIN n USING (id) WHERE place <= 5)
SELECT query_id, md5({_sql(fixed.GUIDE_REFERENCE)} || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY place)) AS context FROM l WHERE line <> '' GROUP BY query_id""")
def graph_contexts_dense(spark, d):
    """Contexts from seeds found by vectors, of all articles and the benchmark's items, and from what the seeds cite."""
    made = articles(spark, d)
    nodes = made.select(F.col("aid").alias("id"), "title", "text")
    encoder = hashed_encoder(64, _md5_number)
    found = retrieve.graph_query(nodes, law.citation_edges(made), _asked(spark, d)[0], 3, 1, 5, encoder=encoder)
    return retrieve.graph_context(found).select("query_id", F.md5(F.col("context").cast("binary")).alias("context"))


def _md5_number(token: str) -> int:
    """64 bits of an MD5, which SQL can state too."""
    return int(hashlib.md5(token.encode()).hexdigest()[:16], 16)


# --- choice questions --------------------------------------------------------------------------------------


def _read(messages):
    """Options and the number answered of a choice question's messages."""
    lines = F.split(F.regexp_replace(messages[1]["content"], "\n정답:$", ""), "\n")
    options = F.transform(F.filter(lines, lambda x: x.rlike("^[0-9]+\\) ")), lambda x: F.regexp_replace(x, "^[0-9]+\\) ", ""))
    return options, messages[2]["content"].cast("int")


@query("""
SELECT source AS law, '제' || doc_id || '조' AS article, 4 AS n, CAST('0x' || substr(md5('5|' || source || '|제' || doc_id || '조'), 1, 15) AS BIGINT) % 4 + 1 AS answer, 3 AS own, false AS answer_is_own FROM documents""")
def law_choices(spark, d):
    """Questions on what an article does not hold: three items of its own, and another's where the answer says."""
    rows = table(spark, d, "documents").select(F.col("source").alias("law"), F.concat(F.lit("제"), "doc_id", F.lit("조")).alias("article"), F.concat_ws("\n", *(F.concat(F.lit(f"{k}. 항목 {k} 의 "), "doc_id") for k in (1, 2, 3, 4))).alias("body"), F.concat(F.lit(" "), "doc_id").alias("_mark"))
    out = records.law_choice_records(rows.drop("_mark"))
    options, answer = _read(F.col("messages"))
    mark = F.concat(F.lit(" "), F.regexp_extract("article", "제([0-9]+)조", 1))
    own = lambda x: F.endswith(x, mark)
    return out.select("law", "article", F.size(options).alias("n"), answer.alias("answer"), F.size(F.filter(options, own)).alias("own"), own(F.element_at(options, answer)).alias("answer_is_own"))


@query("""
SELECT 'w' || doc_id AS term, 4 AS n, CAST('0x' || substr(md5('5|w' || doc_id || chr(1) || '뜻은 ' || doc_id), 1, 15) AS BIGINT) % 4 + 1 AS answer, 1 AS own, '뜻은 ' || doc_id AS right FROM documents""".replace("AS right", 'AS "right"'))
def term_choices(spark, d):
    """Questions on which definition is a term's."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("w"), "doc_id").alias("term"), F.concat(F.lit("뜻은 "), "doc_id").alias("definition"))
    out = records.term_choice_records(rows)
    options, answer = _read(F.col("messages"))
    right = F.concat(F.lit("뜻은 "), F.substring("term", 2, 20))
    return out.select("term", F.size(options).alias("n"), answer.alias("answer"), F.size(F.filter(options, lambda x: x == right)).alias("own"), F.element_at(options, answer).alias("right"))


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 + 1 AS answer FROM documents), k AS (SELECT unnest(['term', 'definition', 'term_negative', 'definition_negative']) AS kind)
SELECT doc_id, kind, 4 AS n, answer, 1 AS own, kind IN ('term', 'definition') AS answer_is_own, CASE WHEN doc_id % 10 = 0 OR kind IN ('term', 'definition') THEN NULL ELSE CASE kind WHEN 'term_negative' THEN 'w' ELSE '뜻은 ' END || ((doc_id + 1) % n) END AS nearest FROM r, k, n""")
def augmented_questions(spark, d):
    """Four questions a term: its near ones are those with the next ids; every tenth has none and takes others."""
    docs = table(spark, d, "documents")
    total = docs.count()
    rows = docs.select("doc_id", F.concat(F.lit("w"), "doc_id").alias("term"), F.concat(F.lit("뜻은 "), "doc_id").alias("definition"))
    near = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("rank"))
    near = near.select("query_id", F.pmod(F.col("query_id") + F.col("rank"), F.lit(total)).alias("doc_id"), "rank")
    out = records.augmented_choices(rows, near, noise=0.0)
    options, answer = _read(F.col("messages"))
    out = out.select("doc_id", "kind", options.alias("_options"), answer.alias("_answer"))
    options, answer = F.col("_options"), F.col("_answer")
    own = F.when(F.col("kind").startswith("term"), F.concat(F.lit("w"), "doc_id")).otherwise(F.concat(F.lit("뜻은 "), "doc_id"))
    chosen = F.element_at(options, answer)
    return out.select("doc_id", "kind", F.size(options).alias("n"), answer.alias("answer"), F.size(F.filter(options, lambda x: x == own)).alias("own"), (chosen == own).alias("answer_is_own"), F.when((F.col("doc_id") % 10 != 0) & F.col("kind").endswith("negative"), chosen).alias("nearest"))


@query("""
WITH r AS (SELECT doc_id // 50 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS rank FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank <= 7 ORDER BY md5('6|' || query_id || '|' || doc_id), doc_id) AS k FROM r WHERE rank <= 16)
SELECT query_id, doc_id, rank FROM p WHERE rank <= 7 OR k <= 3""")
def mixed_negatives(spark, d):
    """Seven of ten from the top of a ranked list, three dealt from what follows."""
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("query_id"), "doc_id")
    return records.mix_negatives(rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))), 10)


_ZEROS = "list_transform(range(0, 64), lambda x: 0.0::DOUBLE)"
_DOMAIN = "CASE WHEN regexp_matches(lower({t}), 'attack.mitre.org|enterprise-attack|ics-attack|mobile-attack|mitre att&ck|mitre attack|mitre-attack|att&ck|technique') OR regexp_matches({t}, '\\bTA?[0-9]{{4}}') THEN 'mitre' WHEN regexp_matches({t}, '법|시행령|시행규칙|대통령령|총리령|부령') THEN 'law' ELSE 'other' END"


@query(r"""
WITH d AS (SELECT d.doc_id, d.text, d.source, CAST(e.embedding AS DOUBLE[]) AS e, regexp_extract_all(coalesce(d.text, ''), '[^\s]+') AS w, """ + _DOMAIN.format(t="d.text") + r""" AS domain FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
qs AS (SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS qe, CASE WHEN regexp_matches(b.text, '(?i)\b(?:TA[0-9]{4}|T[0-9]{4}(?:\.[0-9]{3})?|ATT&CK)\b') THEN 'mitre' WHEN regexp_matches(b.text, '법|시행령|시행규칙|제\s?[0-9]+\s?조|대통령령|총리령|부령') THEN 'law' ELSE 'auto' END AS route FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x GROUP BY ALL), dl AS (SELECT doc_id, len(w) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(query, '[^\s]+')) AS term FROM qs) x GROUP BY ALL),
ls AS (SELECT query_id, doc_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM qt JOIN idf USING (term) JOIN p USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id),
lex AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
den AS (SELECT query_id, doc_id, round(list_dot_product(qe, e), 6) AS score, route, domain FROM qs, d WHERE qe IS NOT NULL AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qe, e), 6) DESC, doc_id) <= 50),
f AS (SELECT query_id, doc_id, round(0.7 * coalesce(den.score, 0) + CASE WHEN den.score IS NOT NULL AND route IN ('law', 'mitre') AND route = domain THEN 0.05 ELSE 0 END + 0.3 * coalesce(lex.score / (lex.score + 10), 0), 9) AS score FROM den FULL JOIN lex USING (query_id, doc_id)),
h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 50),
g AS (SELECT h.query_id, coalesce(list_dot_product(qe, e), 0) AS raw FROM h JOIN qs USING (query_id) JOIN d USING (doc_id) WHERE rank = 1),
c AS (SELECT h.query_id, h.doc_id, h.rank, coalesce(e, """ + _ZEROS + r""") AS v, list_dot_product(qe, coalesce(e, """ + _ZEROS + r""")) AS near FROM h JOIN g USING (query_id) JOIN qs USING (query_id) JOIN d USING (doc_id) WHERE raw >= 0.25),
""" + _picks("c", 3, 0.65, "rank").replace("\nSELECT", ",\npicks AS (SELECT", 1) + r"""),
t AS (SELECT query_id, pick, text, CASE domain WHEN 'other' THEN '[REF]' WHEN 'law' THEN '[LAW]' ELSE '[ATT&CK]' END || ' | ' || source AS header, trim(array_to_string(string_split(replace(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))[1:3], ' '), chr(32) || chr(10) || chr(9)) AS summary FROM picks JOIN d USING (doc_id)),
x AS (SELECT query_id, string_agg(header || chr(10) || replace(CASE WHEN summary = '' THEN substring(text, 1, 400) ELSE summary END, chr(10), ' '), chr(10) || chr(10) ORDER BY pick) AS x FROM t GROUP BY query_id)
SELECT query_id, route, coalesce(raw >= 0.25, false) AS ok, CASE WHEN raw IS NULL THEN 'no-candidate' WHEN raw < 0.25 THEN 'low-dense=' || printf('%.3f', raw) END AS reason, CASE WHEN raw >= 0.25 THEN md5(""" + _sql(fixed.GUIDE_ATTACK) + r""" || chr(10) || chr(10) || x) END AS context FROM qs LEFT JOIN g USING (query_id) LEFT JOIN x USING (query_id)""")
def retrieve_routed(spark, d):
    """Route, hybrid search, gate, diversification and context for the benchmark's items over all documents, those without a vector lexically."""
    rows, asked = _vectors(spark, d, None)
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    chunks = docs.join(rows.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").withColumns({"id": F.col("doc_id").cast("string"), "extra": domain_meta("text")})
    queries = _asked(spark, d)[0].join(asked, "query_id", "left")
    out = retrieve.retrieve(chunks, queries)
    return out.select("query_id", "route", "ok", "reason", F.md5(F.col("context").cast("binary")).alias("context"))
