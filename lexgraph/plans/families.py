"""Queries over columns that are made from every document by one SQL text, which Spark and the oracle both run.

The tables hold no Hangul, so Korean articles, questions and term lists are put together around each document's id
and text; what a function should make of them follows from how they were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import fixed
from ..functions import predicates as P
from ..functions import structs
from ..functions import text as T
from ..functions import vectors as V
from ..operators import context, corpus, evaluate, law, names, records, terms
from .registry import _sql, query, table


def made(spark, d, **columns: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", *(f"{e} AS {n}" for n, e in columns.items()))


def made_sql(**columns: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM documents"


def joined(*parts: str) -> str:
    return " || ".join(parts)


NL = "chr(10)"
W, V97, N, A, B = "'w' || doc_id", "'v' || (doc_id % 97)", "(doc_id % 30 + 1)", "(doc_id % 7 + 1)", "(doc_id % 3 + 2)"
FIRST = joined("'제'", N, "'조 (목적) 이 법은 '", W, "'을 정한다.'")
SECOND = joined("'① 첫째 항은 제'", A, "'조의'", B, "'를 따른다.'")
TAIL = f"CASE doc_id % 3 WHEN 0 THEN '다만, ' || {V97} || '은 제외한다. 위반하면 벌금에 처한다.' WHEN 1 THEN '신고하여야 한다. 예: ' || {W} || ' 사례. 끝.' ELSE '유사하지만 다르다. 끝.' END"
ITEMS = [joined(W, "' 신고 항목'"), joined("'둘째 '", V97, "' 항목입니다'"), joined(W, "' 보호 조치를 제공한다'")]
BODY = joined(FIRST, "' '", SECOND, NL, "'1. '", ITEMS[0], "';'", NL, "'가. '", ITEMS[1], NL, "'- '", ITEMS[2], NL, f"({TAIL})")
FLAGS = "CASE doc_id % 3 WHEN 0 THEN '벌칙/제재 포함 · 예외 규정 존재 · 목적 규정' WHEN 1 THEN '의무/금지 규정 · 목적 규정' ELSE '목적 규정' END"
_ONE_LINE = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"
_SENTENCES = rf"string_split(regexp_replace({_ONE_LINE}, '([.?！!])\s+', '\1' || chr(1), 'g'), chr(1))"
ARTICLE_SQL = f"WITH m AS ({made_sql(body=BODY, i1=ITEMS[0], i2=ITEMS[1], i3=ITEMS[2], first=FIRST, flags=FLAGS, w=W, kind='doc_id % 3')})"


@query(ARTICLE_SQL + f"""
SELECT doc_id, i1 || '|' || i2 || '|' || i3 AS enumerated, i1 || ';|' || i2 || '|' || i3 AS bullets, i1 || '|' || i2 || '|' || i3 AS bullets_three, array_to_string({_SENTENCES}[1:5], ' ') AS summary,
  substring(array_to_string({_SENTENCES}[1:3], ' '), 1, 300) AS definition, CASE WHEN kind = 1 THEN w || ' 사례' ELSE '' END AS examples, CASE WHEN kind = 2 THEN first END AS contrast, flags FROM m""")
def item_forms(spark, d):
    """Items, points, summaries, definitions, examples, contrasts and clause flags of articles."""
    rows, bar = made(spark, d, body=BODY), lambda a: F.array_join(a, "|")
    return rows.select("doc_id", bar(T.enumerated("body")).alias("enumerated"), bar(T.bullets("body")).alias("bullets"), bar(T.bullets_three("body")).alias("bullets_three"), T.summary("body").alias("summary"), T.definition("body").alias("definition"), bar(T.examples("body")).alias("examples"), T.contrast("body").alias("contrast"), F.array_join(P.clause_flags("body"), " · ").alias("flags"))


_STRIPPED = "trim(text, chr(32) || chr(10))"
_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CLEANED = r"regexp_replace(trim(regexp_replace(translate(text, '〈〉<>', ''), '\s+', ' ', 'g')), '\.{2,}', '…', 'g')"


@query(rf"""
SELECT doc_id, CASE WHEN length({_STRIPPED}) <= 220 THEN {_STRIPPED} ELSE regexp_replace(substring({_STRIPPED}, 1, 220), '\s+$', '') || '…' END AS truncated,
  CASE WHEN length({_COLLAPSED}) <= 180 THEN {_COLLAPSED} ELSE regexp_replace(substring({_COLLAPSED}, 1, 179), '\s+$', '') || '…' END AS shortened,
  regexp_replace(substring(trim(array_to_string(string_split(regexp_replace({_CLEANED}, '([.!?。…])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')), 1, 120), '\s+$', '') AS compressed, md5({_CLEANED}) AS cleaned
FROM documents""")
def text_shortenings(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate("text").alias("truncated"), T.shorten("text").alias("shortened"), T.compress_answer("text").alias("compressed"), F.md5(T.clean_answer("text").cast("binary")).alias("cleaned"))


_QUESTION = "'질문 ' || doc_id || ' 은 무엇인가'"
ANSWERS = {
    "twice": joined("'a'", "doc_id", "' b. a'", "doc_id", "' b. c d.'"), "question": _QUESTION, "echo": joined("'Assistant: '", _QUESTION, "' 설명이다. 둘째다. 셋째다.'"),
    "options": joined("'Q'", NL, "'1 가) x'", "doc_id", NL, "'2 ③ y'"), "marked": joined("'<p>A '", "doc_id", "'</p>!'"), "number": "CASE WHEN doc_id % 2 = 0 THEN ' ' || (doc_id % 99 + 1) || ' ' ELSE 'n ' || doc_id END",
    "noisy": "CASE doc_id % 3 WHEN 0 THEN '한국어 답변 ' || doc_id WHEN 1 THEN '답 ****** ' || doc_id ELSE 'mostly latin letters ' || doc_id END",
}


@query(f"""
WITH m AS ({made_sql(**ANSWERS)})
SELECT doc_id, 'a' || doc_id || ' b. c d.' AS squashed, ltrim(substring(question || ' 설명이다. 둘째다.', length(question) // 2 + 1)) AS opened, '가) x' || doc_id || '|③ y' AS leads, 'a' || doc_id AS compared,
  doc_id % 2 = 0 AS is_number, doc_id % 3 <> 0 AS noisy FROM m""")
def answer_forms(spark, d):
    """Answers without repetition, echo or marks; numbers and noise."""
    rows = made(spark, d, **ANSWERS)
    return rows.select("doc_id", T.squash_repetition("twice").alias("squashed"), T.clean_open_answer("echo", "question").alias("opened"), F.array_join(T.strip_leads(T.options_of("options")), "|").alias("leads"), T.normalize_compared("marked", True).alias("compared"), P.is_number_answer("number").alias("is_number"), T.noisy_output("noisy").alias("noisy"))


_TOKENS = "regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')"
_BLANK = r"regexp_extract_all(text, '[^\s]+')"


@query(rf"""
WITH t AS (SELECT doc_id, n_chars, {_TOKENS} AS x, {_TOKENS}[1:len({_TOKENS}) // 2] AS y, {_BLANK} AS w, ['o0', 'o1', 'o2', 'o3'] AS o, 'o' || (doc_id % 4) AS v, least(doc_id % 6 + 1, 4) AS p, length(text) AS n FROM documents),
s AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / (sqrt(len(list_distinct(x))) * sqrt(len(list_distinct(y))) + 1e-6) END AS overlap FROM t)
SELECT doc_id, round(overlap, 6) AS overlap, round(overlap + 0.02 * least(n, 400) + CASE WHEN doc_id % 2 = 0 THEN 0.1 * overlap ELSE 0 END, 6) AS score, greatest(1, CAST(round_even(n_chars * 0.9, 0) AS BIGINT)) AS part, doc_id % 4 + 1 AS position,
  array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i + 1 = p THEN v WHEN i + 1 = doc_id % 4 + 1 THEN o[p] ELSE o[i + 1] END), '|') AS placed,
  md5(array_to_string(list_transform(range(0, len(w), 40), lambda i: array_to_string(w[i + 1:i + 40], ' ')), '|')) AS lines FROM s""")
def array_forms(spark, d):
    """Overlap and score of answers, places of options, parts and lines of words."""
    x, v, options = T.tokens_lower("text"), F.concat(F.lit("o"), F.col("doc_id") % 4), F.array(*map(F.lit, ("o0", "o1", "o2", "o3")))
    rows = table(spark, d, "documents").withColumn("x", x).withColumn("o", V.token_overlap(F.col("x"), F.slice("x", F.lit(1), F.floor(F.size("x") / 2).cast("int"))))
    score = V.answer_score(F.col("o"), F.length("text"), F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", F.round("o", 6).alias("overlap"), F.round(score, 6).alias("score"), V.split_size(F.col("n_chars"), 0.9).alias("part"), V.position_of(options, v).alias("position"), F.array_join(V.place_at(options, v, (F.col("doc_id") % 6 + 1).cast("int")), "|").alias("placed"), F.md5(F.array_join(V.grouped(T.tokens_blank("text"), 40), "|").cast("binary")).alias("lines"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT vec_id, round(list_dot_product(list_transform(e, lambda x: x / n), e), 5) AS unit_dot, round(list_sum(list_transform(e, lambda x: 1.5 * x)), 5) AS pooled, round(e[1] / n, 6) AS first FROM u WHERE n > 0""")
def vector_forms(spark, d):
    """Unit vectors, and means of token vectors under a mask."""
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pooled = V.mean_pool(F.array("e", F.transform("e", lambda x: x * 2), F.transform("e", lambda x: x * 7)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    rows = rows.withColumns({"u": V.unit(F.col("e")), "p": pooled}).where("u IS NOT NULL")
    return rows.select("vec_id", F.round(V.dot(F.col("u"), F.col("e")), 5).alias("unit_dot"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 5).alias("pooled"), F.round(F.col("u")[0], 6).alias("first"))


PHRASES = ["시행령 ' || doc_id || ' 의 T1059", "제 ' || doc_id || ' 조 T1059", "hello ' || doc_id || '", "공부 방법 제' || doc_id || '조", "개인정보보호법 위반 ' || doc_id || '", "한글 ' || doc_id || ' !"]
_PHRASE = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"


@query(f"""
WITH m AS ({made_sql(s=_PHRASE, k="doc_id % 6")})
SELECT doc_id, CASE k WHEN 0 THEN 'mitre' WHEN 1 THEN 'law' WHEN 3 THEN 'law' WHEN 4 THEN 'law' ELSE 'unknown' END AS domain, k IN (0, 1, 4) AS law_asked, k = 4 AS title_asked, k IN (3, 4, 5) AS korean FROM m""")
def question_domains(spark, d):
    """Domains, triggers and scripts of questions."""
    rows = made(spark, d, s=_PHRASE).withColumn("normal", T.normalize_query("s"))
    titles = F.array(F.lit("개인정보보호법"), F.lit("공부"))
    return rows.select("doc_id", P.detect_domain("s").alias("domain"), P.triggers_law("s").alias("law_asked"), P.triggers_title(F.col("normal"), titles).alias("title_asked"), P.mostly_korean("s").alias("korean"))


@query(f"""
WITH m AS ({made_sql(s=_PHRASE, k="doc_id % 6")}) SELECT doc_id, k = 4 AS title_asked FROM m""")
def title_triggers(spark, d):
    """Questions that name a title, sought among the sources of all documents and two laws at once."""
    rows = made(spark, d, s=_PHRASE).withColumn("normal", T.normalize_query("s"))
    titles = table(spark, d, "documents").select(F.concat(F.lit("법령 "), "source").alias("title")).union(spark.sql("SELECT explode(array('개인정보보호법', '공부'))"))
    return names.asked_titles(rows, titles)


LAWS = {
    "ragged": joined("'a　b  '", "chr(13)", NL, "'c'", "doc_id"), "corpus": joined("'제'", N, "'조 「법'", "doc_id", "'」 (이하 \"갑\"라 한다) 12'"), "asked": joined("'「법'", "doc_id", "'」, (가)·나'"),
    "english": joined("'Initial Access by RAT '", "doc_id", "' and c2'"), "korean": joined("'가 '", NL, "' 나   '", "doc_id"), "title": joined("'제 '", N, "' 조의 '", B, "' 제목'"), "body": BODY, "n": N, "b": B,
}


@query(f"""
WITH m AS ({made_sql(**LAWS)})
SELECT doc_id, 'a b' || chr(10) || 'c' || doc_id AS lines, '법' || doc_id || ' 갑 12' AS corpus, '법' || doc_id || ' 가 나' AS asked, '초기 침투 by RAT ' || doc_id || ' and C2' AS translated, '가 나 ' || doc_id AS korean,
  'L_' || n || '의' || b AS article, '제' || n || '조의' || b AS base, '제' || n || '조' AS base_only FROM m""")
def law_text_forms(spark, d):
    """Normal forms of law texts, questions and titles."""
    rows = made(spark, d, **LAWS)
    return rows.select("doc_id", T.normalize_lines("ragged").alias("lines"), T.collapse(T.normalize_corpus("corpus")).alias("corpus"), T.normalize_query("asked").alias("asked"), T.apply_glossary("english").alias("translated"), T.normalize_korean("korean").alias("korean"), law.article_id(F.col("title"), F.lit("L")).alias("article"), law.base_title(F.col("title")).alias("base"), law.base_title(F.col("title"), False).alias("base_only"))


@query(rf"""
WITH m AS ({made_sql(body=BODY, n=N, a=A)}), p AS (SELECT *, position('제' || a || '조의' IN body) AS cut FROM m),
s AS (SELECT doc_id, '제' || n || '조' AS article, trim(substring(body, length('제' || n || '조') + 1, cut - 1 - length('제' || n || '조'))) AS body FROM p UNION ALL SELECT doc_id, '제' || a || '조', trim(substring(body, cut + length('제' || a || '조'))) FROM p)
SELECT doc_id, article, body FROM s WHERE length(body) >= 30""")
def law_text_split(spark, d):
    """Articles of a text, the citation within it taken for a heading too."""
    return made(spark, d, body=BODY).select("doc_id", F.explode(law.split_law_text("body")).alias("p")).select("doc_id", "p.article", "p.body")


LAW_FILE = joined("'제1조(목적) '", W, "'을 정한다.'", NL, "'제2조(정의) 뜻을 정한다.'", NL, "'① 첫째 항.'", NL, "'1. 첫 호 '", "doc_id", NL, "'가. 첫 목.'", NL, "'제3조 삭제'")


@query(f"""
WITH m AS ({made_sql(w=W)}), r AS (
  SELECT 'L' || doc_id AS law, 0 AS node_id, NULL AS parent_id, '법률' AS label, '' AS title, '' AS text, false AS deleted FROM m UNION ALL SELECT 'L' || doc_id, 1, 0, '조', '제1조 목적', w || '을 정한다.', false FROM m
  UNION ALL SELECT 'L' || doc_id, 2, 0, '조', '제2조 정의', '뜻을 정한다.', false FROM m UNION ALL SELECT 'L' || doc_id, 3, 2, '항', '①', '첫째 항.', false FROM m UNION ALL SELECT 'L' || doc_id, 4, 3, '호', '1', '첫 호 ' || doc_id, false FROM m
  UNION ALL SELECT 'L' || doc_id, 5, 4, '목', '가', '첫 목.', false FROM m UNION ALL SELECT 'L' || doc_id, 6, 0, '조', '제3조', '', true FROM m)
SELECT law, CAST(dense_rank() OVER (PARTITION BY law ORDER BY node_id) - 1 AS BIGINT) AS node, label, title, text, deleted FROM r""")
def law_trees(spark, d):
    """The tree of a law made of every document; nodes are numbered in order."""
    nodes = law.parse_laws(made(spark, d, file=LAW_FILE).select(F.concat(F.lit("L"), "doc_id").alias("law"), F.col("file").alias("text")))
    return nodes.select("law", (F.dense_rank().over(Window.partitionBy("law").orderBy("node_id")) - 1).cast("long").alias("node"), "label", "title", "text", "deleted")


@query(f"""
WITH m AS ({made_sql(w=W)})
SELECT 'L' || doc_id || '_제1조목적' AS aid, '제1조 목적' AS title, w || '을 정한다.' AS text FROM m UNION ALL SELECT 'L' || doc_id || '_제2조정의', '제2조 정의', '뜻을 정한다.' || chr(10) || '첫째 항.' || chr(10) || '첫 호 ' || doc_id FROM m UNION ALL SELECT 'L' || doc_id || '_제3조', '제3조', '' FROM m""")
def law_articles(spark, d):
    """Articles with the texts of two levels below."""
    nodes = law.parse_laws(made(spark, d, file=LAW_FILE).select(F.concat(F.lit("L"), "doc_id").alias("law"), F.col("file").alias("text")))
    return law.collect_articles(nodes).select("aid", "title", "text")


@query("SELECT DISTINCT k AS keyword FROM (SELECT source || '법' AS k FROM documents UNION ALL SELECT '목적 ' || (doc_id % 30 + 1) FROM documents) t WHERE length(k) >= 2")
def law_keyword_list(spark, d):
    nodes = made(spark, d, law="source || ' 법'", title=joined("'제1조('", "'목적 '", N, "')'"))
    return law.law_keywords(nodes)


@query("""
WITH m AS (SELECT source || '_' || doc_id AS id, source || ' 제' || doc_id || '조' AS label, substring(text, 1, 400) AS tooltip, doc_id % 6 AS k FROM documents)
SELECT id, label, tooltip, CASE k WHEN 0 THEN 'red' WHEN 1 THEN 'orange' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' ELSE 'gray' END AS colour FROM m""")
def graph_drawing(spark, d):
    """Nodes of a drawing, each with the colour of an edge from it."""
    kind = "CASE doc_id % 6 WHEN 0 THEN '벌칙' WHEN 1 THEN '예외' WHEN 2 THEN '면제' WHEN 3 THEN '적용' WHEN 4 THEN '참조' END"
    rows = made(spark, d, id="source || '_' || doc_id", law="source", title="'제' || doc_id || '조'", text="text", relation=kind)
    nodes, edges = law.viz_tables(rows, rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), "relation"))
    return nodes.join(edges.select(F.col("src").alias("id"), "colour"), "id")


# --- term dictionaries -------------------------------------------------------------------------------------

TERMS = {
    "plain": joined("'1.1'", NL, "'용어'", "doc_id", NL, "'뜻풀이 '", W, "'이다'", NL, "'12'", NL, "'1.2'", NL, "'둘째말'", NL, "'다른 풀이이다'", NL),
    "tagged": joined(NL, "'1.1'", NL, "'정보통신단체표준 x'", NL, "'용어'", "doc_id", "' - 가'", NL, "'뜻풀이가 열 글자를 넘는다 '", W, "'이다  12'", NL, "'1.2'", NL, "'짧음'", NL, "'짧다'", NL),
    "two": joined(NL, "'1.1'", NL, "'긴 용어 '", "doc_id", "' (가나'", NL, "'다라)'", NL, "'정의가 열 글자를 넘는다 '", W, "'이다'", NL),
}


@query("""
SELECT 'plain' AS form, doc_id AS file, '1.1' AS section, '용어' || doc_id AS term, '뜻풀이 w' || doc_id || '이다' AS definition FROM documents
UNION ALL SELECT 'plain', doc_id, '1.2', '둘째말', '다른 풀이이다' FROM documents
UNION ALL SELECT 'tagged', doc_id, '1.1', '용어' || doc_id || '-가', '뜻풀이가 열 글자를 넘는다 w' || doc_id || '이다' FROM documents
UNION ALL SELECT 'two', doc_id, '1.1', '긴 용어 ' || doc_id || ' (가나 다라)', '정의가 열 글자를 넘는다 w' || doc_id || '이다' FROM documents""")
def term_dictionaries(spark, d):
    """Sections, terms and definitions of three kinds of files, one of each made of every document."""
    rows, out = made(spark, d, **TERMS), None
    for form, parse in (("plain", terms.terms_plain), ("tagged", terms.terms_tagged), ("two", terms.terms_two_lines)):
        part = parse(rows.select("doc_id", F.col(form).alias("text")), "doc_id").select(F.lit(form).alias("form"), "file", "section", "term", "definition")
        out = part if out is None else out.unionByName(part)
    return out


# --- records -----------------------------------------------------------------------------------------------

_NO = _sql(fixed.NO_FLAGS)


@query(ARTICLE_SQL + f""", s AS (SELECT *, {_SENTENCES} AS s FROM m)
SELECT doc_id, 'law' AS kind, md5('[요약] ' || array_to_string(s[1:5], ' ') || chr(10) || chr(10) || '[핵심포인트]' || chr(10) || '- ' || i1 || ';' || chr(10) || '- ' || i2 || chr(10) || '- ' || i3 || chr(10) || chr(10) || '[예외·벌칙] ' || flags || chr(10) || '[근거] L 제' || doc_id || '조') AS answer FROM s
UNION ALL SELECT doc_id, 'law_summary', md5(array_to_string(s[1:3], ' ')) FROM s UNION ALL SELECT doc_id, 'term', md5(array_to_string(s[1:2], ' ')) FROM s
UNION ALL SELECT doc_id, 'term_answer', md5('[정의] ' || substring(array_to_string(s[1:3], ' '), 1, 300) || chr(10) || chr(10) || '[핵심포인트]' || chr(10) || '- ' || i1 || chr(10) || '- ' || i2 || chr(10) || '- ' || i3 || chr(10) || chr(10) || '[예시] '
  || CASE WHEN kind = 1 THEN '- ' || w || ' 사례' ELSE {_NO} END || chr(10) || '[주의/대비개념] ' || CASE WHEN kind = 2 THEN first ELSE {_NO} END || chr(10) || '[근거] TTA 표준' || CASE WHEN kind = 0 THEN '' ELSE '(1.1)' END) FROM s""")
def law_term_records(spark, d):
    """Answers of the records made of an article or a term."""
    rows = made(spark, d, body=BODY, article="'제' || doc_id || '조'", term=W, section="CASE WHEN doc_id % 3 = 0 THEN '' ELSE '1.1' END")
    answers = {
        "law": records.law_record(F.lit("L"), F.col("article"), F.col("body"))[2]["content"], "law_summary": records.law_summary_record(F.lit("L"), F.col("article"), F.col("body"))[2]["content"],
        "term": records.term_record(F.col("term"), F.col("body"))[2]["content"], "term_answer": records.term_answer(F.col("body"), F.col("section")),
    }
    return rows.select("doc_id", F.explode(F.create_map(*(x for k, a in answers.items() for x in (F.lit(k), F.md5(a.cast("binary")))))).alias("kind", "answer"))


_FORMS = {"messages": "messages", "conversations": "conversations", "alpaca": "output", "prompt_completion": "completion"}


@query(f"""
WITH m AS ({made_sql(term=W, definition="'뜻은 ' || doc_id || '이다.'")}), u AS (SELECT doc_id, '용어: ' || term || chr(10) || chr(10) || '원문:' || chr(10) || definition AS u, 'S' || chr(10) || '용어: ' || term || chr(10) || '원문:' || chr(10) || definition || chr(10) AS p FROM m WHERE doc_id % 5 <> 0)
SELECT doc_id, 'messages' AS form, md5(u) AS asked FROM u UNION ALL SELECT doc_id, 'conversations', md5(u) FROM u UNION ALL SELECT doc_id, 'alpaca', md5(u) FROM u UNION ALL SELECT doc_id, 'prompt_completion', md5(p) FROM u""")
def term_record_forms(spark, d):
    """Terms as records of four forms; every fifth definition is broken and left out."""
    rows = made(spark, d, term=W, definition="'뜻은 ' || doc_id || '이다.' || CASE WHEN doc_id % 5 = 0 THEN '<|endoftext|>' ELSE '' END", section="'' || doc_id")
    out = None
    for form in _FORMS:
        made_rows = records.term_records(rows, form, "S")
        ask = {"messages": "messages[1].content", "conversations": "conversations[1].content", "alpaca": "input", "prompt_completion": "prompt"}[form]
        part = made_rows.selectExpr("CAST(meta.section AS BIGINT) AS doc_id", f"'{form}' AS form", f"md5(CAST({ask} AS BINARY)) AS asked")
        out = part if out is None else out.unionByName(part)
    return out


def _bucket(n: int, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 15) AS BIGINT) % {n})"


_TEMPLATES = "[" + ", ".join(_sql(t) for t in fixed.DEFINE_TEMPLATES) + "]"


@query(f"""
WITH m AS (SELECT 'w' || doc_id AS term, text, unnest([1, 2]) AS n FROM documents)
SELECT {_TEMPLATES}[{_bucket(len(fixed.DEFINE_TEMPLATES), 'term', 'n', "'pick'")} + 1] || term AS instruction, md5(text) AS output FROM m""")
def definition_pairs(spark, d):
    """Two records a term, each with a template that a hash picks."""
    rows = made(spark, d, term=W, definition="text")
    return records.define_records(rows, 2).select("instruction", F.md5(F.col("output").cast("binary")).alias("output"))


@query(r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?！!])\s+', '\1' || chr(1), 'g'), chr(1)) AS s0, text FROM documents),
p AS (SELECT doc_id, list_filter(s0, lambda x: x <> '') AS s FROM s), c AS (SELECT doc_id, s, len(s) AS n, """ + _bucket(3, "doc_id", "'mode'") + " AS mode, " + _bucket(2, "doc_id", "'many'") + " + 1 AS k, CAST('0x' || substr(md5(doc_id || '|start'), 1, 15) AS BIGINT) % greatest(len(s) - 2, 1) + 2 AS st FROM p),"
r"""
j AS (SELECT doc_id, array_to_string(CASE WHEN mode = 0 THEN s[1:k] WHEN mode = 1 THEN CASE WHEN n <= 2 THEN s ELSE s[st:st + k - 1] END ELSE s[greatest(n - k + 1, 1):n] END, ' ') AS t FROM c)
SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE regexp_replace(substring(t, 1, 179), '\s+$', '') || '…' END AS crop FROM j""")
def cropped_definitions(spark, d):
    """One or two sentences of every text, chosen by a hash of the id."""
    return table(spark, d, "documents").select("doc_id", T.crop("text", F.col("doc_id")).alias("crop"))


_PREFIXES = "[" + ", ".join("replace(" + _sql(p) + ", '{term}', 'w' || doc_id)" for p in fixed.EXPAND_PREFIXES) + "]"
_SUFFIXES = "[" + ", ".join(_sql(p) for p in fixed.EXPAND_SUFFIXES) + "]"


@query(rf"""
WITH m AS (SELECT doc_id, {_PREFIXES}[{_bucket(3, "doc_id", "'prefix'")} + 1] AS p, {_SUFFIXES}[{_bucket(4, "doc_id", "'suffix'")} + 1] AS s, {_COLLAPSED} AS t FROM documents),
b AS (SELECT doc_id, trim(p || CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substring(t, 1, 219), '\s+$', '') || '…' END || s) AS b FROM m)
SELECT doc_id, CASE WHEN length(b) <= 240 THEN b ELSE regexp_replace(substring(b, 1, 239), '\s+$', '') || '…' END AS expanded FROM b""")
def expanded_definitions(spark, d):
    return table(spark, d, "documents").select("doc_id", T.expand("text", F.concat(F.lit("w"), "doc_id"), F.col("doc_id")).alias("expanded"))


_NOISY = "'가 및 나 또는 ' || doc_id || ' 등 을 를'"
_SWAPS = " ".join("WHEN " + _sql(k) + " THEN [" + ", ".join(map(_sql, v)) + "][" + f"(CAST('0x' || substr(md5(doc_id || '|' || i || '|which'), 1, 15) AS BIGINT) % {len(v)}) + 1]" for k, v in fixed.NOISE.items())


@query(f"""
WITH m AS (SELECT doc_id, string_split({_NOISY}, ' ') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM m)
SELECT doc_id, string_agg(CASE WHEN CAST('0x' || substr(md5(doc_id || '|' || i || '|hit'), 1, 15) AS BIGINT) % 10000 < 5000 THEN CASE x {_SWAPS} ELSE x END ELSE x END, ' ' ORDER BY i) AS noisy FROM e GROUP BY doc_id""")
def surface_noise(spark, d):
    """Half of the particles and conjunctions swapped, by a hash of id and place."""
    return made(spark, d, s=_NOISY).select("doc_id", T.surface_noise("s", F.col("doc_id"), 0.5).alias("noisy"))


@query(f"""
WITH m AS (SELECT doc_id, 'Q' || doc_id AS q, '1 a|2 b' AS o, doc_id % 2 = 0 AS mcq, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'c' || doc_id END AS c, 'a' || doc_id AS a, text, source, lang FROM documents),
s AS (SELECT *, CASE WHEN mcq THEN q || chr(10) || o ELSE q END AS asked FROM m)
SELECT doc_id, asked AS seeded, 'Q' || doc_id || chr(10) || '1 x' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '2 c' || doc_id END AS full_question,
  CASE WHEN c = '' THEN '' ELSE '<|system|>' || chr(10) || c || chr(10) END || '<|user|>' || chr(10) || asked || chr(10) || '<|assistant|>' || chr(10) || a AS injected, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(c) END AS filled, CASE WHEN doc_id % 3 = 0 THEN source ELSE c END AS picked FROM s""")
def record_pieces(spark, d):
    """Seeds, questions, injected contexts, the first filled column, the picked one."""
    rows = made(spark, d, q="'Q' || doc_id", o="'1 a|2 b'", kind="CASE WHEN doc_id % 2 = 0 THEN 'mcq ' ELSE 'open' END", passage="CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'c' || doc_id END", a="'a' || doc_id", content="text", source="source")
    seed = records.seed_messages(F.col("kind"), F.col("q"), F.col("o"), F.col("a"))
    return rows.select(
        "doc_id", seed[0]["content"].alias("seeded"), records.full_question(F.col("q"), [F.lit("x"), F.col("passage")]).alias("full_question"), records.rendered(context.inject(seed, F.col("passage"))).alias("injected"),
        F.md5(corpus.first_filled(rows, ["text", "passage", "content"]).cast("binary")).alias("filled"), corpus.picked(rows, ["title", "passage", "source"]).alias("picked"),
    )


@query("""
SELECT 's:::' || doc_id AS id, md5(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(CASE WHEN doc_id % 4 = 0 THEN lang ELSE text END, chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9)), '^$', '')) AS text, source, CAST(n_chars AS VARCHAR) AS n_chars, 'mitre' AS domain FROM documents WHERE doc_id % 7 <> 0""".replace("regexp_replace(trim(", "(trim(", 1).replace(", '^$', ''))", "))", 1))
def record_chunk_rows(spark, d):
    """Records as chunks: text or passage, the rest as a map of strings; every seventh has neither."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("lang")).alias("passage"), "source", "n_chars")
    out = corpus.record_chunks(rows, "s", "doc_id", "mitre")
    return out.select("id", F.md5(F.col("text").cast("binary")).alias("text"), F.col("extra")["source"].alias("source"), F.col("extra")["n_chars"].alias("n_chars"), F.col("extra")["domain"].alias("domain"))


@query("""
SELECT conv_id, turn, '{"role":"' || upper(role) || '","tags":["A","B' || turn || '"],"inner":{"x":"' || upper(role) || '","n":' || turn || '}}' AS mapped FROM conversations""")
def mapped_strings(spark, d):
    """Every string of a nested row in upper case, as JSON."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array(F.lit("a"), F.concat(F.lit("b"), "turn")).alias("tags"), F.struct(F.col("role").alias("x"), F.col("turn").alias("n")).alias("inner"))
    out = structs.map_strings(rows, F.upper)
    return out.select("conv_id", "turn", T.to_text(F.struct("role", "tags", "inner"), "struct<>").alias("mapped"))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 4 = 0) AS with_messages, count(*) FILTER (WHERE doc_id % 4 IN (1, 2)) AS from_instruction, count(*) FILTER (WHERE doc_id % 4 = 3) AS "empty", count(*) FILTER (WHERE doc_id % 4 = 2) AS with_input FROM documents""")
def conversion_counters(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, records.messages(("user", F.col("text")))).alias("messages"), F.when(F.col("doc_id") % 4 == 1, "do").alias("instruction"), F.when(F.col("doc_id") % 4 == 2, "with").alias("input"), F.lit(None).cast("string").alias("output"))
    return records.conversion_counts(rows)


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS uid FROM documents")
def running_numbers(spark, d):
    """A number over the whole table in order of source and id."""
    return corpus.numbered(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "uid")


@query("SELECT round(avg(n_chars / 1000.0), 6) AS loss, round(exp(avg(n_chars / 1000.0)), 4) AS perplexity, round(sum(n_chars) / sum(0.5), 4) AS tokens_per_second FROM documents")
def perplexity_of_losses(spark, d):
    out = evaluate.perplexity(table(spark, d, "documents").select((F.col("n_chars") / 1000.0).alias("loss"), F.col("n_chars").cast("int").alias("tokens"), F.lit(0.5).alias("seconds")))
    return out.select(F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


# --- what surrounds a model --------------------------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END AS first_token, '가' || doc_id || ' !' AS korean, 'x' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 7 END AS until_number, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS best, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS best_sum,
  array_to_string(w[greatest(len(w) - 27, 1):], ' ') AS budgeted, 'run-' || greatest(doc_id, 100) AS latest FROM (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS w FROM documents) t""")
def model_surroundings(spark, d):
    """Allowed first tokens, allowed letters, stops, options by log-probability, input budgets, the latest run."""
    rows = table(spark, d, "documents")
    second = F.when(F.col("doc_id") % 3 == 0, -0.5).otherwise(-3.0)
    scores = F.create_map(F.lit("1"), F.lit(-1.0), F.lit("2"), second, F.lit("x"), F.lit(-0.1))
    tokens = F.array(F.concat(F.lit("가"), "doc_id"), F.lit("abc"), F.lit(" "), F.lit("!"), F.lit("漢"))
    options = F.array(F.struct(F.lit("a").alias("option"), F.array(F.lit(-1.0), F.lit(-1.0)).alias("logprobs")), F.struct(F.lit("b").alias("option"), F.array(F.when(F.col("doc_id") % 2 == 0, -0.2).otherwise(-4.0)).alias("logprobs")))
    runs = F.array(F.lit("run-99"), F.lit("run-100"), F.lit("final"), F.concat(F.lit("run-"), "doc_id"))
    said = F.concat(F.lit("x"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.lit(7)), F.lit(" 그리고 8"))
    return rows.select(
        "doc_id", providers.constrained_first(scores, T.option_numbers(F.array(F.lit("1 a"), F.lit("2 b")))).alias("first_token"), F.array_join(providers.korean_tokens(tokens), "").alias("korean"), providers.until_number(said).alias("until_number"),
        providers.best_option(options).alias("best"), providers.best_option(options, mean=False).alias("best_sum"), F.array_join(providers.budgeted(T.tokens_blank("text"), 60, 32), " ").alias("budgeted"), providers.latest_run(runs).alias("latest"),
    )


def _stand_in(prompts: list[str]) -> list[str]:
    return [("정답은 " + str(len(p) % 2 + 1)) if p.endswith("정답 번호:") else "풀이" for p in prompts]


@query("""
WITH m AS (SELECT doc_id, text || chr(10) || '1 a' || chr(10) || '2 b' AS q FROM documents)
SELECT doc_id, '풀이' AS rationale, CAST((length(q) + length(chr(10) || chr(10) || '풀이: ') + 2 + length(chr(10) || chr(10) || '정답 번호:')) % 2 + 1 AS VARCHAR) AS answer, md5(q) AS translated FROM m""")
def two_stage_answers(spark, d):
    """A rationale, then a number, by a stand-in for a model; a translator that fails passes the source through."""

    def failing(texts: list[str]) -> list[str]:
        raise ValueError("no model")

    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n1 a\n2 b")).alias("q"))
    out = providers.two_stage(rows, "q", _stand_in)
    return out.select("doc_id", "rationale", "answer", F.md5(providers.translated(F.col("q"), failing).cast("binary")).alias("translated"))


@query(r"""
WITH l AS (SELECT 'f' || doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id % 5 <> 0)
SELECT file, line_no, text FROM l WHERE trim(text) <> ''""")
def line_corpus_rows(spark, d):
    """The lines of files whose name doesn't exclude them."""
    files = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 5 == 0, "TTA_").otherwise("f"), "doc_id").alias("file"), "text")
    return corpus.line_corpus(files)


@query(r"""
WITH c AS (SELECT 'f' || doc_id AS f, trim(regexp_replace(regexp_replace(replace(replace(text, chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9)) AS t FROM documents),
s AS (SELECT f, t, unnest(range(0, greatest(length(t) - 200, 1), 1600)) AS b FROM c WHERE length(t) > 0)
SELECT f || ':::' || (b // 1600) AS id, f AS source, b AS start, least(b + 1800, length(t)) AS "end", 'law' AS domain, md5(trim(regexp_replace(regexp_replace(substring(t, b + 1, 1800), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9))) AS text FROM s""")
def file_chunks_1800(spark, d):
    """Spans of 1,800 characters with their file's id and domain."""
    files = table(spark, d, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file"), "text")
    out = corpus.text_chunks(files, size=1800, overlap=200, domain="law")
    return out.select("id", "source", "start", "end", F.col("extra.domain").alias("domain"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("""
WITH t AS (SELECT doc_id, lang AS prompt, list_transform(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+'), lambda x: length(x)) AS a FROM documents), s AS (SELECT doc_id, list_concat([1, 1], list_concat(a, [2]))[1:2048] AS i, list_concat([-100, -100], list_concat(a, [2]))[1:2048] AS l FROM t)
SELECT doc_id, len(i) AS n, md5(array_to_string(i, ',')) AS ids, md5(array_to_string(l, ',')) AS labels FROM s""")
def supervised_rows(spark, d):
    """Prompt and answer ids as input, with the prompt's labels masked."""
    rows = table(spark, d, "documents").select("doc_id", F.array(F.lit(1), F.lit(1)).alias("prompt_ids"), F.transform(T.tokens_lower("text"), lambda w: F.length(w)).alias("answer_ids"))
    text = lambda a: F.md5(F.array_join(F.transform(a, lambda x: x.cast("string")), ",").cast("binary"))
    out = records.supervised(rows)
    return out.select("doc_id", F.size("attention_mask").alias("n"), text("input_ids").alias("ids"), text("labels").alias("labels"))

