"""Queries on questions, records, packing and answer quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions import vectors as V
from ..operators import blocks, evaluate, records
from .registry import _sql, literal, query, table, values

MCQ = [(1, "Q?\n1 a\n2 b"), (2, "Q?\n1 a"), (3, "Q?\n1 a|2 b"), (4, "Q one\nQ two\n ① x\n10 y\n 2 z"), (5, "")]
_MCQ = values(MCQ, "t", "id, s")


@query(f"""
WITH {_MCQ}, u AS (SELECT 'fixture' AS kind, id, s FROM t UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'document', doc_id, text FROM documents),
l AS (SELECT kind, id, list_filter(string_split(trim(s, chr(32) || chr(10)), chr(10)), lambda x: regexp_matches(x, '^[ \t]*[1-9][0-9]?[ \t]')) AS o, list_filter(string_split(trim(s, chr(32) || chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*[1-9][0-9]?[ \t]')) AS q FROM u)
SELECT kind, id, len(o) >= 2 AS multiple, len(o) AS n_options, md5(array_to_string(list_transform(q, lambda x: trim(x)), ' ')) AS question FROM l""")
def is_mcq(spark, d):
    rows = literal(spark, MCQ, "id long, s string").select(F.lit("fixture").alias("kind"), "id", "s")
    rows = rows.union(table(spark, d, "conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), "text")).union(table(spark, d, "documents").select(F.lit("document"), "doc_id", "text"))
    return rows.select("kind", "id", T.is_multiple_choice("s").alias("multiple"), F.size(T.options_of("s")).alias("n_options"), F.md5(T.question_of("s").cast("binary")).alias("question"))


@query("WITH " + values([(1, "1,2", "Q?"), (2, "1", "Q?"), (3, "1", "Q?"), (4, "10,2", "Q one Q two ① x"), (5, "1,2,3,4,5,6,7,8,9,10", "")], "t", "id, numbers, question") + """ SELECT 'fixture' AS kind, id, numbers, question FROM t
UNION ALL SELECT 'document', doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter([doc_id % 30 + 3, 2], lambda x: x <= 10), lambda x: CAST(x AS VARCHAR)))), ','), 'Q' || doc_id || ' one Q two' FROM documents""")
def question_choices(spark, d):
    """Literal questions, and one made of every document, with one option whose number may be too large."""
    asked = table(spark, d, "documents").selectExpr("'document' AS kind", "doc_id AS id", "'Q' || doc_id || ' one' || chr(10) || 'Q two' || chr(10) || (doc_id % 30 + 3) || ' y' || chr(10) || ' 2 z' AS s")
    rows = literal(spark, MCQ, "id long, s string").select(F.lit("fixture").alias("kind"), "id", "s").union(asked)
    return rows.select("kind", "id", F.array_join(T.option_numbers(T.options_of("s"), 10), ",").alias("numbers"), T.question_of("s").alias("question"))


ANSWERS = [(1, "x 답변: 12번", "Q\n1 a\n2 b"), (2, "답변: 없음", "Q\n1 a\n2 b"), (3, "답변: ", "Q"), (4, "a <b> c...", "Q"), (5, "말 답변: 하나 답변: 둘", "Q")]


@query("WITH " + values([(1, "12"), (2, "0"), (3, "미응답"), (4, "a b c…"), (5, "둘")], "t", "id, answer") + """ SELECT 'fixture' AS kind, id, answer FROM t
UNION ALL SELECT 'document', doc_id, (doc_id % 30 + 1) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '번' END FROM documents""")
def extract_answers(spark, d):
    """Literal answers, and the whole text of every document with an answer at its end, to a question with options or without."""
    said = table(spark, d, "documents").selectExpr("'document' AS kind", "doc_id AS id", "coalesce(text, '') || ' 답변: ' || (doc_id % 30 + 1) || '번' AS s", "CASE WHEN doc_id % 2 = 0 THEN 'Q' || chr(10) || '1 a' || chr(10) || '2 b' ELSE 'Q' END AS q")
    rows = literal(spark, ANSWERS, "id long, s string, q string").select(F.lit("fixture").alias("kind"), "id", "s", "q").union(said)
    return rows.select("kind", "id", T.extract_answer("s", "q").alias("answer"))


@query(f"SELECT conv_id, turn, {_sql(fixed.SYSTEM_OPEN)} AS system, {_sql(fixed.USER_OPEN + '질문: ')} || text || {_sql(chr(10) + chr(10) + '답변:')} AS user_text FROM conversations WHERE role = 'user'")
def messages_build(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", records.prompt("text").alias("m"))
    return rows.select("conv_id", "turn", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user_text"))


@query(f"""
SELECT conv_id, turn, md5({_sql(fixed.SYSTEM_CONVERT)} || '|' || trim(text, chr(32) || chr(10)) || '|' || coalesce(trim(reply, chr(32) || chr(10)), '')) AS messages
FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS reply FROM conversations) t""")
def schema_convert(spark, d):
    """Every turn of a conversation and the one after it as an instruction record, turned into messages."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("instruction"), F.lead("text").over(w).alias("output"))
    return records.convert(rows).select("conv_id", "turn", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|").cast("binary")).alias("messages"))


@query("SELECT doc_id, CAST(n_chars % 3 + 3 AS BIGINT) AS n_options, CAST((row_number() OVER (PARTITION BY n_chars % 3 ORDER BY doc_id) - 1) % (n_chars % 3 + 3) + 1 AS BIGINT) AS position FROM documents")
def label_balance(spark, d):
    return records.balanced_position(table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 3 + 3).alias("n_options")), "n_options", "doc_id")


@query("""
WITH t AS (SELECT doc_id // 50 AS batch, doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS v FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+'), lambda x: length(x)) AS w FROM documents) x),
p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id, k) - 1 AS place FROM t),
b AS (SELECT batch, place // 2048 AS block, count(*) AS n, sum(v) AS total, md5(string_agg(v, ',' ORDER BY place)) AS ids FROM p GROUP BY ALL)
SELECT batch, block, n, CAST(total AS BIGINT) AS total, ids FROM b QUALIFY block < max(block) OVER (PARTITION BY batch) OR n >= 1024""")
def token_block_pack(spark, d):
    """Word lengths stand for token ids, fifty documents to a batch."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("batch"), F.col("doc_id").alias("ord"), F.transform(T.tokens_lower("text"), lambda w: F.length(w)).alias("input_ids")).withColumn("labels", F.col("input_ids"))
    out = blocks.token_blocks(rows)
    return out.select("batch", "block", F.size("input_ids").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").cast("binary")).alias("ids"))


@query("""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+'), lambda x: length(x)) AS w FROM documents),
l AS (SELECT doc_id, list_concat(list_transform(w[1:5], lambda x: -100), w[6:])[1:2048] AS l FROM w)
SELECT doc_id, len(l) AS n, least(len(l), len(list_filter(l, lambda x: x = -100))) AS masked, (8 - len(l) % 8) % 8 AS padding, md5(array_to_string(l, ',')) AS labels FROM l""")
def label_mask(spark, d):
    """The first five word lengths stand for a prompt's ids, the rest for its answer's, cut at the operator's length."""
    w = F.transform(T.tokens_lower("text"), lambda x: F.length(x))
    rows = table(spark, d, "documents").select("doc_id", F.slice(w, 1, 5).alias("p"), F.slice(w, 6, 100_000_000).alias("a"))
    labels = V.masked_labels(F.col("p"), F.col("a"))
    return rows.select("doc_id", F.size(labels).alias("n"), F.size(F.filter(labels, lambda x: x == -100)).alias("masked"), (F.size(V.pad_to_multiple(labels)) - F.size(labels)).alias("padding"), F.md5(F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").cast("binary")).alias("labels"))


_NORMAL = "trim(regexp_replace(regexp_replace(lower(regexp_replace({}, '[''\"《》<>〈〉()‘’]', ' ', 'g')), '[!#$%&*+,./:;=?@\\\\^_`{{|}}~\\[\\]-]', '', 'g'), '\\s+', ' ', 'g'), chr(32) || chr(10))"


@query("""
WITH t AS (SELECT doc_id AS id, """ + _NORMAL.format("text") + " AS a, " + _NORMAL.format("reverse(text) || doc_id") + """ AS b FROM documents),
c AS (SELECT id, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y, a = b AS em FROM t),
m AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(x, '')) AS ch FROM c) z WHERE ch <> '' GROUP BY ALL),
k AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(y, '')) AS ch FROM c) z WHERE ch <> '' GROUP BY ALL),
s AS (SELECT id, sum(least(m.n, k.n)) AS same FROM m JOIN k USING (id, ch) GROUP BY id)
SELECT c.id, CAST(em AS DOUBLE) AS exact_match, CASE WHEN coalesce(same, 0) = 0 THEN 0.0 ELSE round(2.0 * same / (length(x) + length(y)), 6) END AS f1 FROM c LEFT JOIN s USING (id)""")
def squad_f1(spark, d):
    """A text reversed, and its id, stands for the right answer of which the text is the prediction."""
    docs = table(spark, d, "documents")
    rows = evaluate.scores(docs.select(F.col("doc_id").alias("id"), F.array(F.concat(F.reverse("text"), "doc_id")).alias("answers")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction")))
    return rows.select("id", "exact_match", F.round("f1", 6).alias("f1"))


@query("SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE doc_id % 3 <> 0 AND (doc_id % 2 = 0 OR n_chars < 50)) / count(*), 6) AS exact_match FROM documents")
def squad_evaluate(spark, d):
    """Every third question has no prediction; of the others the even ones, and the short ones, are right."""
    docs = table(spark, d, "documents")
    questions = docs.select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("x"), "doc_id"), F.concat(F.lit("y "), "doc_id")).alias("answers"))
    right = F.when((F.col("doc_id") % 2 == 0) | (F.col("n_chars") < 50), F.concat(F.lit("(Y) "), "doc_id", F.lit("!"))).otherwise("z")
    predictions = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), right.alias("prediction"))
    return evaluate.evaluate(questions, predictions).select("n", F.round("exact_match", 6).alias("exact_match"))


@query("SELECT 'TEST_' || d.doc_id AS \"ID\", CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS VARCHAR) END AS \"Answer\" FROM documents d LEFT JOIN labels l USING (doc_id)")
def submission_merge(spark, d):
    sample = table(spark, d, "documents").select(F.concat(F.lit("TEST_"), "doc_id").alias("ID"))
    return records.submission(sample, table(spark, d, "labels").select(F.concat(F.lit("TEST_"), "doc_id").alias("ID"), F.col("quality").cast("string").alias("Answer")))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def done_id_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT count(*) AS n, count(l.doc_id) AS answered, round(100.0 * (count(*) - count(l.doc_id)) / count(*), 6) AS unanswered FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_of_unanswered(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("hit").alias("answered"), F.round(100.0 * (F.count("*") - F.count("hit")) / F.count("*"), 6).alias("unanswered"))


OBJECTS = [
    ("attack-pattern", "Phishing ", "<b>Sends</b> `mail` [x](https://a.b/c) **now** https://u.v\n\n end", [("mitre-attack", "initial-access"), ("other", "zz"), ("mitre-attack", "execution"), ("mitre-attack", "execution")]),
    ("attack-pattern", "", "no name", None), ("malware", "M", "d", None), ("attack-pattern", "Plain", "text", None),
]


@query("WITH " + values([("Phishing", "Phishing — Sends mail x now\nend", "execution,initial-access"), ("Plain", "Plain — text", "")], "t", "name, text, tactic") + """ SELECT name, text, tactic FROM t
UNION ALL SELECT 'D' || doc_id, 'D' || doc_id || ' — Sends w' || doc_id || ' now', coalesce(source, '') FROM documents WHERE doc_id % 2 = 0""")
def mitre_rows(spark, d):
    """Literal objects, and one made of every document, every other one of another type."""
    df = literal(spark, OBJECTS, "type string, name string, description string, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>")
    more = table(spark, d, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'attack-pattern' ELSE 'malware' END", "' D' || doc_id", "'<b>Sends</b> `w' || doc_id || '` **now**'", "array(named_struct('kill_chain_name', 'mitre-attack', 'phase_name', source), named_struct('kill_chain_name', 'other', 'phase_name', lang))")
    return records.attack_rows(df.union(more)).select("name", F.regexp_replace("text", "(?U)[ ]+", " ").alias("text"), "tactic")


RATIONALE = [("옳지 않은 것은?\n선택지:\n1 가\n2 나", "2"), ("맞는 것은?\n선택지:\n1 가\n2 나", " 1 "), ("맞는 것은?\n선택지:\n1 가\n나", "1"), ("Q", "1"), ("맞는 것은?\n선택지:\n1 가\n2 나", "둘")]


_CHOICES = "CASE WHEN doc_id % 3 = 0 THEN '옳지 않은' ELSE '맞는' END || ' 것은?' || chr(10) || '선택지:' || chr(10) || '1 w' || doc_id || chr(10) || '2 v ' || doc_id % 97"


@query("WITH " + values([(RATIONALE[0][0], fixed.EXPLAIN_NEGATIVE.replace("{number}", "2").replace("{text}", "나") + "\n정답: 2"), (RATIONALE[1][0], fixed.EXPLAIN_NORMAL.replace("{number}", "1").replace("{text}", "가") + "\n정답: 1")], "t", "instruction, output") + f""" SELECT instruction, output FROM t
UNION ALL SELECT {_CHOICES}, replace(replace(CASE WHEN doc_id % 3 = 0 THEN {_sql(fixed.EXPLAIN_NEGATIVE)} ELSE {_sql(fixed.EXPLAIN_NORMAL)} END, '{{number}}', CAST(doc_id % 2 + 1 AS VARCHAR)), '{{text}}', CASE doc_id % 2 WHEN 0 THEN 'w' || doc_id ELSE 'v ' || doc_id % 97 END) || chr(10) || '정답: ' || (doc_id % 2 + 1) FROM documents""")
def mcq_rationale(spark, d):
    """Literal records, and one made of every document."""
    rows = literal(spark, RATIONALE, "instruction string, output string")
    return records.rationale(rows.union(table(spark, d, "documents").selectExpr(_CHOICES, "CAST(doc_id % 2 + 1 AS STRING)")))


@query(r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
s(doc_id, k, block, held, n) AS (
  SELECT doc_id, 1, 0, l[1], length(l[1]) + 1 FROM l WHERE len(l) > 0
  UNION ALL
  SELECT doc_id, k + 1, block + full_::INT, CASE WHEN full_ THEN x ELSE held || ' ' || x END, CASE WHEN full_ THEN length(x) ELSE n + length(x) + 1 END
  FROM (SELECT s.*, l.l[k + 1] AS x, n + length(l.l[k + 1]) + 1 > 1800 AS full_ FROM s JOIN l USING (doc_id) WHERE k < len(l.l)) t)
SELECT doc_id, block, arg_max(held, k) AS text FROM s GROUP BY doc_id, block""")
def line_pack_1800(spark, d):
    packed = blocks.pack_lines(T._stripped_lines("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(packed).alias("block", "text"))


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, trim(text, chr(32) || chr(10)) AS t FROM documents),
l AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM t WHERE length(t) > 900),
s(doc_id, k, part, held) AS (
  SELECT doc_id, 1, 0, trim(l[1]) FROM l
  UNION ALL
  SELECT doc_id, k + 1, part + full_::INT, CASE WHEN full_ THEN x ELSE trim(held || ' ' || x, chr(32) || chr(10)) END
  FROM (SELECT s.*, l.l[k + 1] AS x, length(held) + length(l.l[k + 1]) + 1 > 900 AND held <> '' AS full_ FROM s JOIN l USING (doc_id) WHERE k < len(l.l)) t)
SELECT doc_id, part, trim(arg_max(held, k), chr(32) || chr(10)) AS text FROM s GROUP BY doc_id, part
UNION ALL SELECT doc_id, 0, t FROM t WHERE t <> '' AND length(t) <= 900""")
def sentence_pack_900(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(blocks.pack_sentences("text")).alias("part", "text"))


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.9, 0)) THEN 'train' ELSE 'val' END AS part FROM documents""")
def train_val_split(spark, d):
    return records.split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""
WITH v AS (SELECT v, row_number() OVER (ORDER BY md5('5|' || v), v) - 1 AS at_, count(*) OVER () AS n FROM (SELECT DISTINCT md5(text) AS v FROM documents) x),
a AS (SELECT doc_id, md5(text) AS own, (CAST('0x' || substr(md5('5|' || doc_id), 1, 15) AS BIGINT) % 1073741824) % (SELECT max(n) FROM v) AS start FROM documents),
s AS (SELECT doc_id, own, step, (start + step) % (SELECT max(n) FROM v) AS place FROM a, (SELECT unnest(range(0, 4)) AS step) z),
k AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM s JOIN v ON v.at_ = s.place WHERE v <> own)
SELECT doc_id, count(*) AS n, list(v ORDER BY k) AS others FROM k WHERE k <= 3 GROUP BY doc_id""")
def mcq_distractors(spark, d):
    """Digests of whole texts stand for options."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return records.distractors(docs, "doc_id", "digest").select("doc_id", F.size("others").alias("n"), "others")
