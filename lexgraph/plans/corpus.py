"""Queries over whole texts: cleaners, tokenizers, chunks, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import bm25, corpus
from ..operators.records import exact_dedup
from .registry import literal, query, table, values

WORDS = "regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')"


@query(f"""
SELECT token, count(*) AS count FROM (
  SELECT doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM documents) t
GROUP BY token ORDER BY count(*) DESC, min(struct_pack(a := doc_id, b := pos)) LIMIT 2000""")
def token_freq_top(spark, d):
    return bm25.token_frequency(table(spark, d, "documents"), T.tokens_lower("text"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) t GROUP BY term")
def doc_freq(spark, d):
    return bm25.Index.build(table(spark, d, "documents")).term_stats


@query(f"SELECT doc_id, len({WORDS}) AS dl, round(avg(len({WORDS})) OVER (), 6) AS avgdl, count(*) OVER () AS n FROM documents")
def doc_len_stats(spark, d):
    index = bm25.Index.build(table(spark, d, "documents"))
    return index.doc_stats.crossJoin(F.broadcast(index.corpus)).select("doc_id", "dl", F.round("avgdl", 6).alias("avgdl"), "n")


_CLEAN = r"trim(regexp_replace(regexp_replace(replace(replace(text, chr(12288), ' '), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9))"


@query(rf"""
SELECT doc_id, md5({_CLEAN}) AS clean, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\[[^\]]*\]', '', 'g'), '[ \t]+', ' ', 'g'), chr(32) || chr(10))) AS law,
  md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed,
  md5(replace(trim(regexp_replace(lower(text), '[^0-9a-z가-힣]+', ' ', 'g')), ' ', '|')) AS plain_words,
  CASE WHEN length(text) <= 1400 THEN length(text) ELSE length(trim(substring(text, 1, 1400), chr(32) || chr(10))) END AS cut
FROM documents""")
def text_cleaners(spark, d):
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z가-힣]+"), F.lit(0)), "|")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.clean("text").cast("binary")).alias("clean"), F.md5(T.clean_law("text").cast("binary")).alias("law"), F.md5(T.collapse(F.col("text")).cast("binary")).alias("collapsed"),
        F.md5(words.cast("binary")).alias("plain_words"), F.length(T.cut("text")).alias("cut"),
    )


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS kept_case, md5(array_to_string(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), '|')) AS kept_case_md5,
  len(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS lower, len(regexp_extract_all(text, '[^\s]+')) AS blank, md5(array_to_string(regexp_extract_all(text, '[^\s]+'), '|')) AS blank_md5
FROM documents""")
def tokenizer_counts(spark, d):
    joined = lambda a: F.md5(F.array_join(a, "|").cast("binary"))
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens_kept_case("text")).alias("kept_case"), joined(T.tokens_kept_case("text")).alias("kept_case_md5"), F.size(T.tokens_lower("text")).alias("lower"), F.size(T.tokens_blank("text")).alias("blank"), joined(T.tokens_blank("text")).alias("blank_md5"))


@query(r"""
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[^\s]+'), lambda x: regexp_replace(regexp_replace(x, '^[^\pL\pN_]+', ''), '[^\pL\pN_]+$', '')),
    lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND regexp_matches(x, '[가-힣A-Za-z]') AND x NOT IN ('the', 'of', 'and', 'der', 'die', 'que')) AS w FROM documents) t""")
def corpus_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.corpus_tokens("text", ["the", "of", "and", "der", "die", "que"]).alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


def _chunk_sql(size: int, overlap: int, body: str, piece: str, keep: str = "true") -> str:
    return f"""
WITH t AS (SELECT doc_id, {body} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(length(t) - {overlap}, 1), {size - overlap})) AS b FROM t WHERE length(t) > 0)
SELECT doc_id, b AS start, least(b + {size}, length(t)) AS "end", md5({piece}) AS chunk FROM s WHERE {keep}"""


@query(_chunk_sql(900, 200, _CLEAN, "substring(t, b + 1, 900)"))
def chunk_900_200(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.chunks(T.clean("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").alias("end"), F.md5(F.col("c.text").cast("binary")).alias("chunk"))


@query(_chunk_sql(1200, 200, "text", "trim(substring(t, b + 1, 1200), chr(32) || chr(10))", "trim(substring(t, b + 1, 1200), chr(32) || chr(10)) <> ''"))
def chunk_trim_1200_200(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.chunks_trimmed("text")).alias("c"))
    return rows.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.md5(F.col("c.text").cast("binary")).alias("chunk"))


@query(r"""
SELECT doc_id, trim(array_to_string(list_filter(p[1:2], lambda x: x <> ''), ' '), chr(32) || chr(10)) AS first_two, len(list_filter(p, lambda x: x <> '')) AS n
FROM (SELECT doc_id, string_split(regexp_replace(trim(text, chr(32) || chr(10)), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents) t""")
def sentence_first_n(spark, d):
    n = F.size(T._filled(F.split(T.strip(F.col("text")), r"(?U)(?<=[.!?。！？])\s+")))
    return table(spark, d, "documents").select("doc_id", T.first_sentences("text", 2).alias("first_two"), n.alias("n"))


@query(r"""
SELECT doc_id, CASE WHEN hit IS NULL THEN substring(text, 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END
  ELSE CASE WHEN hit - 61 > 0 THEN '…' ELSE '' END || substring(text, greatest(hit - 61, 0) + 1, least(hit - 1 + n + 60, length(text)) - greatest(hit - 61, 0)) || CASE WHEN hit - 1 + n + 60 < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, coalesce(nullif(position('thanti' IN lower(text)), 0), nullif(position('schein' IN lower(text)), 0), nullif(position('les ' IN lower(text)), 0)) AS hit,
  CASE WHEN position('thanti' IN lower(text)) > 0 THEN 6 WHEN position('schein' IN lower(text)) > 0 THEN 6 ELSE 4 END AS n FROM documents) t""")
def snippet_window(spark, d):
    words = F.array(F.lit("Thanti"), F.lit("schein"), F.lit("LES "))
    return table(spark, d, "documents").select("doc_id", T.snippet("text", words, 60, 120).alias("snippet"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def exact_dedup_first(spark, d):
    docs = table(spark, d, "documents")
    return exact_dedup(docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "text"), F.col("text"), ["doc_id"]).select("doc_id", "text_md5", "source")


@query("""
WITH u AS (SELECT 0 AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 1, conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 2, item_id, text FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY corpus, id) AS k FROM u)
SELECT corpus, id, md5(text) AS text_md5 FROM r WHERE k = 1""")
def corpus_union_dedup(spark, d):
    parts = [
        table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
    ]
    return corpus.merged(parts).select("corpus", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


TEXTS = [
    (1, "제5조에 따라 벌금에 처한다"), (2, "다만, 그러하지 아니하다"), (3, "제3조를 준용한다"), (4, "T1059.001 and TA0002 are used"), (5, "시행령 제 7 조 제2항"), (6, "see https://attack.mitre.org/x T1003"), (7, "a technique of old"), (8, "nothing here"),
    (9, "옳지 않은 것은?"), (10, ""), (11, "자본시장 T1059 의 법"), (12, "면제 대상이다"), (13, "bad <|endoftext|> text"), (14, "개인정보보호법 위반"), (15, "공부 방법"),
]
_TEXTS = values(TEXTS, "t", "id, s")


@query(f"""
WITH {_TEXTS}, u AS (SELECT 'fixture' AS kind, id, s FROM t UNION ALL SELECT 'document', doc_id, s || ' ' || coalesce(text, '') FROM documents JOIN t ON t.id = doc_id % 15 + 1)
SELECT kind, id,
  CASE WHEN regexp_matches(s, '벌칙|형|과태료|처벌|징역|벌금') THEN '벌칙' WHEN regexp_matches(s, '예외로|다만|예외|제외한다') THEN '예외' WHEN regexp_matches(s, '면제') THEN '면제' WHEN regexp_matches(s, '적용한다|적용받|따른다|준용') THEN '적용' ELSE '참조' END AS relation,
  CASE WHEN regexp_matches(s, '(?i)(TA[0-9]{{4}}|T[0-9]{{4}}|ATT&CK)') THEN 'mitre' WHEN regexp_matches(s, '법|시행령|시행규칙|제[ ]?[0-9]+[ ]?조|대통령령|총리령|부령') THEN 'law' ELSE 'auto' END AS route,
  CASE WHEN regexp_matches(lower(s), 'attack.mitre.org|att&ck|technique') OR regexp_matches(s, 'TA?[0-9]{{4}}') THEN 'mitre' WHEN regexp_matches(s, '법|시행령|시행규칙|대통령령|총리령|부령') THEN 'law' ELSE 'other' END AS domain,
  regexp_matches(s, '옳지 않은|해당하지 않는|일치하지 않는|부적절한|부합하지 않는') AS negative, contains(s, '<|endoftext|>') AS broken, regexp_matches(s, '법|조문|시행령|시행규칙|전자문서|전자거래|금융실명') AS about_law
FROM u""")
def text_labels(spark, d):
    """Labels of literal texts that hold Hangul, of which the tables have none, and of every document with one of them before it."""
    texts = literal(spark, TEXTS, "id long, s string")
    docs = table(spark, d, "documents").select("doc_id", "text").join(texts, F.col("doc_id") % 15 + 1 == F.col("id"))
    df = texts.select(F.lit("fixture").alias("kind"), "id", "s").union(docs.select(F.lit("document"), "doc_id", F.concat("s", F.lit(" "), F.coalesce("text", F.lit("")))))
    return df.select("kind", "id", P.relation("s").alias("relation"), P.route("s").alias("route"), P.domain_meta("s")["domain"].alias("domain"), P.is_negative("s").alias("negative"), P.is_broken("s").alias("broken"), P.asks_about_law("s").alias("about_law"))


@query(f"""
WITH {_TEXTS}, u AS (SELECT 'fixture' AS kind, id, s FROM t UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'T[0-9]{{4}}(?:[.][0-9]{{3}})?'))), ','), '') AS techniques, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'TA[0-9]{{4}}'))), ','), '') AS tactics
FROM u""")
def domain_ids(spark, d):
    rows = literal(spark, TEXTS, "id long, s string").select(F.lit("fixture").alias("kind"), "id", "s").union(table(spark, d, "documents").select(F.lit("document"), "doc_id", "text"))
    meta = P.domain_meta("s")
    return rows.select("kind", "id", F.coalesce(F.array_join(meta["techniques"], ","), F.lit("")).alias("techniques"), F.coalesce(F.array_join(meta["tactics"], ","), F.lit("")).alias("tactics"))
