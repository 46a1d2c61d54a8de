"""Tables written by the sinks to the shared folder and read back by the sources; the rows are those of the tables."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, law
from ..sources import readers, writers
from ..storage import new_path, written
from ..streaming import ingest
from .families import LAW_FILE
from .registry import query, table

_MD5 = lambda c: F.md5(F.col(c).cast("binary"))


@query("SELECT doc_id, md5(text) AS text, lang FROM documents")
def json_lines_exchange(spark, d):
    """JSON lines: written, and read strictly."""
    path = new_path(spark, "jsonl")
    writers.json_lines(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.json_lines(spark, path, "doc_id long, text string, lang string", "strict").select("doc_id", _MD5("text").alias("text"), "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def damaged_json_lines(spark, d):
    """Every third line is cut short and left out, blank ones too; a path without files has no rows."""
    path = new_path(spark, "jsonl")
    line = F.concat(F.lit('{"doc_id": '), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(', "lang')).otherwise(F.concat(F.lit(', "lang": "'), "lang", F.lit('"}'))))
    rows = table(spark, d, "documents").select(F.explode(F.array(line, F.lit("  "))).alias("value"))
    rows.write.text(path)
    found = readers.json_lines(spark, [path, f"{path}-none"], "doc_id long, lang string", "tolerant", missing_ok=True)
    return found.where("doc_id IS NOT NULL")


def _files(rows: DataFrame, path: str, name: str, content: str) -> None:
    """A file per row below path, as one task's plain writes would make it, through the session's file system."""
    from pyarrow import fs as pafs

    def run(batches):
        system, folder = pafs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{folder}/{file}", compression=None) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    written(rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "n long"), "files")


_SOURCE = "SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source"


def _by_source(spark, d) -> DataFrame:
    """The texts of a source as one, a row a source."""
    lists = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("l"))
    return lists.select("source", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


@query(f"WITH s AS ({_SOURCE}) SELECT kind, source || '.txt' AS file, md5(t || chr(10) || 'é' || CASE kind WHEN 'fallback' THEN '가' ELSE '' END) AS text FROM s, (SELECT unnest(['ignore', 'bom', 'strict', 'fallback']) AS kind) k")
def text_files_exchange(spark, d):
    """Whole files: with bytes that are no UTF-8, with a byte-order mark, strictly, and in a Korean encoding."""
    rows, out = _by_source(spark, d), None
    endings = {"ignore": b"\xff", "bom": b"", "strict": b"", "fallback": "가".encode()}
    for kind, end in endings.items():
        path = new_path(spark, f"txt-{kind}")
        body = F.concat(F.lit(b"\xef\xbb\xbf" if kind == "bom" else b""), F.regexp_replace("text", "\n", "\r\n" if kind != "strict" else "\n").cast("binary"), F.lit("\né".encode()), F.lit(end))
        _files(rows.select(F.concat("source", F.lit(".txt")).alias("f"), body.alias("b")), path, "f", "b")
        part = readers.text_files(spark, path, encoding=kind).select(F.lit(kind).alias("kind"), "file", _MD5("text").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source || '.txt' AS file, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'x.jsonl', 1")
def mixed_file_list(spark, d):
    """Text and JSON files of a folder, each once, in order; others are passed over."""
    path = new_path(spark, "mixed")
    names = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select(F.concat("source", F.lit(".txt")).alias("f"), F.col("n").cast("string").alias("b"))
    more = spark.createDataFrame([("x.jsonl", "1"), ("y.csv", "1")], "f string, b string")
    _files(names.unionByName(more), path, "f", "b")
    found = readers.mixed_sources(spark, path)
    return found.join(names.unionByName(more), F.col("file") == F.col("f")).select("file", F.col("b").cast("long").alias("n"))


@query("SELECT count(*) FILTER (WHERE text <> '') AS n, 0 AS missing, count(*) AS first FROM documents".replace("count(*) AS first", "1 AS first"))
def line_counts(spark, d):
    """Lines that are not blank of a written file; a missing one has none; the first record is one."""
    path = new_path(spark, "lines")
    writers.json_lines(table(spark, d, "documents").where("text <> ''").select("doc_id"), path)
    first = readers.first_record(spark, path, "doc_id long").count()
    return spark.range(1).select(F.lit(readers.count_lines(spark, path)).alias("n"), F.lit(readers.count_lines(spark, f"{path}-none")).alias("missing"), F.lit(first).alias("first"))


@query("SELECT line, count(*) AS n FROM (SELECT 'd' || doc_id AS line FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark) t GROUP BY line")
def joined_lines(spark, d):
    """The lines of two files as one, without blank ones; a missing source is passed over."""
    paths = [new_path(spark, n) for n in ("a", "b", "none", "out")]
    table(spark, d, "documents").select(F.explode(F.array(F.concat(F.lit("d"), "doc_id"), F.lit(" "))).alias("v")).write.text(paths[0])
    table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("v")).write.text(paths[1])
    writers.concat_lines(spark, paths[:3], paths[3])
    return spark.read.text(paths[3]).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""
WITH t(node_id, parent_id, depth, label, title, deleted) AS (VALUES (0, NULL, 0, '법률', '', false), (1, 0, 1, '조', '제1조 목적', false), (2, 0, 1, '조', '제2조 정의', false), (3, 2, 2, '항', '①', false), (4, 3, 3, '호', '1', false), (5, 4, 4, '목', '가', false), (6, 0, 1, '조', '제3조', true))
SELECT 'L' || doc_id AS law, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, CAST(depth AS BIGINT) AS depth, label, title, deleted,
  md5(CASE node_id WHEN 0 THEN '' WHEN 1 THEN coalesce(text, '') WHEN 2 THEN '뜻을 정한다.' WHEN 3 THEN '첫째 항.' WHEN 4 THEN '첫 호 ' || doc_id WHEN 5 THEN '첫 목.' ELSE '' END) AS text_md5 FROM (SELECT DISTINCT doc_id, text FROM documents) d, t""")
def law_tree_exchange(spark, d):
    """Laws made of every document, its whole text as that of the first article: written as nested JSON and read again."""
    docs, name = table(spark, d, "documents").select("doc_id", "text"), F.concat(F.lit("L"), "doc_id").alias("law")
    source = docs.select("doc_id").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id").distinct().select(name, F.expr(LAW_FILE).alias("text"))
    whole = docs.select(name, F.coalesce("text", F.lit("")).alias("whole")).repartition("law").distinct().withColumn("node_id", F.lit(1))  # texts move once, to where the tree is made
    nodes = law.parse_laws(source).join(whole, ["law", "node_id"], "left")
    path = new_path(spark, "trees")
    writers.trees(nodes.withColumn("text", F.coalesce("whole", "text")).drop("whole"), path, levels=list(law.LEVELS.values()))
    return readers.trees(spark, path).select("law", "node_id", "parent_id", "depth", "label", "title", "deleted", _MD5("text").alias("text_md5"))


@query("SELECT 'node' AS kind, source || '_' || doc_id AS a, md5(text) AS b, lang AS relation FROM documents UNION ALL SELECT 'edge', source || '_' || doc_id, 'x' || doc_id, CASE WHEN doc_id % 2 = 0 THEN '벌칙' ELSE '참조' END FROM documents")
def graph_exchange(spark, d):
    """A graph as JSON, read as nodes and edges (a missing relation is the default one), written and read as tables."""
    source, out = new_path(spark, "graph-json"), new_path(spark, "graph")
    docs = table(spark, d, "documents").withColumn("id", F.concat_ws("_", "source", "doc_id"))
    nodes = docs.select(F.struct("id", F.lit("t").alias("title"), F.col("lang").alias("law"), "text").alias("n"), F.struct(F.col("id").alias("src"), F.concat(F.lit("x"), "doc_id").alias("dst"), F.when(F.col("doc_id") % 2 == 0, "벌칙").alias("relation")).alias("e"), "source")
    nodes.groupBy("source").agg(F.collect_list("n").alias("nodes"), F.collect_list("e").alias("edges")).drop("source").write.json(source)
    found = spark.read.schema("nodes array<struct<id:string,title:string,law:string,text:string>>, edges array<struct<src:string,dst:string,relation:string>>").json(source)
    one = new_path(spark, "graph-one")
    _files(found.select(F.expr("uuid()").alias("f"), F.to_json(F.struct("nodes", "edges")).alias("b")), one, "f", "b")
    n, e = readers.graph(spark, one)
    writers.graph(n, e, out)
    n, e = spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), _MD5("text").alias("b"), F.col("law").alias("relation")).union(e.select(F.lit("edge"), "src", "dst", "relation"))


@query("SELECT 'T' || doc_id AS name, 'tactic-' || (doc_id % 5) AS tactic FROM documents WHERE trim(text, chr(32) || chr(10)) <> '' AND doc_id % 4 <> 0")
def attack_bundle(spark, d):
    """A threat catalogue's bundle per source, read as objects and turned into rows; every fourth object is of another type."""
    path = new_path(spark, "bundle")
    phase = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.concat(F.lit("tactic-"), F.col("doc_id") % 5).alias("phase_name")))
    o = F.struct(F.when(F.col("doc_id") % 4 == 0, "malware").otherwise("attack-pattern").alias("type"), F.concat(F.lit("id"), "doc_id").alias("id"), F.concat(F.lit("T"), "doc_id").alias("name"), F.col("text").alias("description"), phase.alias("kill_chain_phases"))
    bundles = table(spark, d, "documents").groupBy("source").agg(F.collect_list(o).alias("objects")).select(F.concat("source", F.lit(".json")).alias("f"), F.to_json(F.struct("objects")).alias("b"))
    _files(bundles, path, "f", "b")
    from ..operators.records import attack_rows

    return attack_rows(readers.attack_objects(spark, path)).select("name", "tactic")


@query("SELECT 'TEST_' || doc_id AS \"ID\", md5(text) AS \"Question\" FROM documents")
def question_file(spark, d):
    """A CSV of questions with line breaks and quotes; the question's column by its name."""
    path = new_path(spark, "questions")
    table(spark, d, "documents").select(F.concat(F.lit("TEST_"), "doc_id").alias("ID"), F.col("text").alias("Question")).write.csv(path, header=True, quoteAll=True, escape='"')
    rows = readers.questions(spark, path)
    column = readers.question_column(rows.columns)
    body, options = readers.question_and_options([*rows.columns, "보기 2", "선택 1"])
    if (column, body, options) != ("Question", "Question", ["선택 1", "보기 2"]):
        raise ValueError("columns of questions not told apart")
    return rows.select("ID", _MD5(column).alias("Question"))


def _docx(text: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    from xml.sax.saxutils import escape

    clean = lambda x: "".join(c for c in x if c >= " ")
    body = "".join(f"<w:p><w:r><w:t>{escape(clean(x))}</w:t></w:r></w:p>" for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query(r"""
WITH l AS (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark)
SELECT item_id || '.docx' AS file, md5(array_to_string(l, chr(10))) AS text FROM l""")
def docx_exchange(spark, d):
    """A document file per benchmark item: its paragraphs that are not blank."""
    path = new_path(spark, "docx")

    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_docx(t) for t in batch.column(1).to_pylist()], pa.binary())], ["f", "b"])

    rows = table(spark, d, "benchmark").select(F.concat("item_id", F.lit(".docx")).alias("f"), F.coalesce("text", F.lit("")).alias("t")).mapInArrow(made, "f string, b binary")
    _files(rows, path, "f", "b")
    return readers.docx_files(spark, path).select("file", _MD5("text").alias("text"))


@query("""
SELECT 'array' AS form, row_number() OVER (ORDER BY item_id) - 1 AS ord, 't' || item_id AS title, md5(text) AS text FROM benchmark UNION ALL SELECT 'wrapped', row_number() OVER (ORDER BY item_id) - 1, 't' || item_id, md5(text) FROM benchmark
UNION ALL SELECT 'lines', row_number() OVER (ORDER BY item_id) - 1, 't' || item_id, md5(text) FROM benchmark UNION ALL SELECT 'plain', row_number() OVER (ORDER BY item_id) - 1, NULL, md5('line ' || item_id) FROM benchmark""")
def meta_forms(spark, d):
    """An index's meta as an array, an object around one, lines of JSON and plain lines."""
    item = F.to_json(F.struct(F.concat(F.lit("t"), "item_id").alias("title"), F.col("text").alias("content")))
    rows = table(spark, d, "benchmark").select("item_id", item.alias("j"))
    items = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "j"))), lambda x: x["j"]).alias("l"), F.transform(F.array_sort(F.collect_list("item_id")), lambda x: F.concat(F.lit("line "), x.cast("string"))).alias("p"))
    whole = F.concat(F.lit("["), F.array_join("l", ","), F.lit("]"))
    forms = {"array": whole, "wrapped": F.concat(F.lit('{"data": '), whole, F.lit("}")), "lines": F.array_join("l", "\n"), "plain": F.array_join("p", "\n")}
    out = None
    for form, body in forms.items():
        path = new_path(spark, f"meta-{form}")
        _files(items.select(F.lit("meta.json").alias("f"), body.alias("b")), path, "f", "b")
        part = readers.meta_rows(spark, path).select(F.lit(form).alias("form"), "ord", "title", _MD5("text").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id ELSE 'a' || doc_id || '|b' END AS answers FROM documents")
def nested_questions(spark, d):
    """Question sets nested in paragraphs, or with a single answer."""
    path = new_path(spark, "squad")
    answer = lambda s: F.struct(s.alias("text"))
    own = F.concat(F.lit("a"), "doc_id")
    qa = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.when(F.col("doc_id") % 3 != 0, F.array(answer(own), answer(F.lit("b")))).alias("answers"), F.when(F.col("doc_id") % 3 == 0, answer(own)).alias("answer"))
    sets = table(spark, d, "documents").groupBy("source").agg(F.collect_list(qa).alias("qas"))
    data = F.struct(F.array(F.struct(F.array(F.struct(F.col("qas").alias("qas"))).alias("paragraphs"))).alias("data"))
    _files(sets.select(F.concat("source", F.lit(".json")).alias("f"), F.to_json(data).alias("b")), path, "f", "b")
    return readers.squad(spark, path).select("id", F.array_join("answers", "|").alias("answers"))


@query("""
SELECT 'chunk' AS kind, CAST(vec_id AS VARCHAR) AS id, CAST(round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS DOUBLE) AS value FROM embeddings
UNION ALL SELECT 'manifest', 'm', count(*) FROM embeddings UNION ALL SELECT 'manifest', 'dim', max(len(embedding)) FROM embeddings UNION ALL SELECT 'stats', 'n', count(*) FROM documents UNION ALL SELECT 'stats', 'dl', sum(len(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+'))) FROM documents
UNION ALL SELECT 'again', CAST(count(*) AS VARCHAR), 0 FROM embeddings""")
def index_exchange(spark, d):
    """A vector index with its lexical index and manifest, written and read; what is written already is not made again."""
    path, once = new_path(spark, "index"), new_path(spark, "once")
    chunks = table(spark, d, "embeddings").select("vec_id", "embedding")
    manifest = writers.vector_index(chunks, path, "m", 900, 200, bm25.Index.build(table(spark, d, "documents")))
    index, rows = bm25.Index.read(spark, f"{path}/bm25"), readers.vector_index(spark, f"{path}/chunks", 64)
    writers.build_once(spark, once, lambda: chunks)
    again = writers.build_once(spark, once, lambda: chunks.limit(0))
    value = lambda df, kind, name, v: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("id"), v.cast("double").alias("value"))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    parts = [
        value(rows, "chunk", F.col("vec_id"), F.round(total, 4)), value(manifest, "manifest", F.col("embedding_model"), F.col("count")), value(manifest, "manifest", F.lit("dim"), F.col("embed_dim")), value(index.corpus, "stats", F.lit("n"), F.col("n")),
        value(index.doc_stats.agg(F.sum("dl").alias("s")), "stats", F.lit("dl"), F.col("s")), value(again.agg(F.count("*").alias("n")), "again", F.col("n"), F.lit(0.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
SELECT 'csv' AS form, 'w' || doc_id AS term, md5(text) AS definition FROM documents UNION ALL SELECT 'jsonl', 'w' || doc_id, md5(text) FROM documents""")
def term_files(spark, d):
    """Terms and definitions as CSV and JSON lines."""
    path = new_path(spark, "terms")
    writers.terms(table(spark, d, "documents").select(F.concat(F.lit("w"), "doc_id").alias("term"), F.col("text").alias("definition")), path)
    csv = spark.read.csv(f"{path}/csv", header=True, multiLine=True, escape='"')
    both = csv.select(F.lit("csv").alias("form"), "term", "definition").unionByName(spark.read.json(f"{path}/jsonl").select(F.lit("jsonl").alias("form"), "term", "definition"))
    return both.select("form", "term", _MD5("definition").alias("definition"))


@query("SELECT 'TEST_' || doc_id AS \"ID\", CAST(quality AS VARCHAR) AS \"Answer\" FROM labels")
def submission_file(spark, d):
    path = new_path(spark, "submission")
    writers.submission(table(spark, d, "labels").select(F.concat(F.lit("TEST_"), "doc_id").alias("ID"), F.col("quality").cast("string").alias("Answer")), path)
    return readers.questions(spark, path)


@query(r"""
WITH w AS (SELECT regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+') AS w FROM documents), l AS (SELECT array_to_string(w[i + 1:i + 40], ' ') AS l FROM (SELECT w, unnest(range(0, len(w), 40)) AS i FROM w) t)
SELECT md5(l) AS line, count(*) AS n FROM l GROUP BY 1""")
def token_line_files(spark, d):
    """Texts as lines of forty tokens each."""
    from ..functions.text import tokens_lower

    path = new_path(spark, "tokens")
    writers.token_lines(table(spark, d, "documents"), tokens_lower("text"), path)
    return spark.read.text(path).groupBy(_MD5("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, lang FROM documents")
def appended_rows(spark, d):
    """Halves that overlap, appended one after the other: each id once."""
    path = new_path(spark, "appended")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    for part in (rows.where("id % 3 < 2"), rows.where("id % 3 > 0"), rows):
        writers.append_new(part, path)
    return spark.read.parquet(path)


def _compressed_rows(part, first: int) -> bytes:
    """A file of rows r and their entries (col, tf), its first row being `first`, so that its length is that of the part alone."""
    part = part.sort_values("r")
    at = part["r"].to_numpy() - first
    counts = np.zeros(int(at.max()) + 1, np.int64)
    counts[at] = [len(e) for e in part["e"]]
    out = io.BytesIO()
    np.savez_compressed(out, data=np.array([x["tf"] for e in part["e"] for x in e], np.float64), indices=np.array([x["col"] for e in part["e"] for x in e], np.int64), indptr=np.concatenate([[0], np.cumsum(counts)]))
    return out.getvalue()


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS x FROM t) u GROUP BY ALL), v AS (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS col FROM (SELECT DISTINCT x FROM p) y)
SELECT doc_id AS row, CAST(sum(col) AS BIGINT) AS cols, CAST(sum(tf) AS DOUBLE) AS total FROM p JOIN v USING (x) GROUP BY doc_id""")
def sparse_matrix_files(spark, d):
    """Term counts as compressed rows in a file per source, and one dense matrix that adds nothing; read as entries."""
    path = new_path(spark, "npz")
    index = bm25.Index.build(table(spark, d, "documents"))
    from ..operators.corpus import numbered

    terms = numbered(index.term_stats.select("term"), ["term"], "col").withColumnRenamed("term", "_t")
    entries = index.postings.join(terms, F.col("term") == F.col("_t")).select(F.col("doc_id").alias("r"), "col", "tf")
    rows = entries.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("col", "tf"))).alias("e"))
    rows = rows.withColumn("_part", F.floor(F.col("r") / 200))

    def packed(key, part):
        import pandas as pd

        return pd.DataFrame({"f": [f"part-{key[0]}.npz"], "b": [_compressed_rows(part, 200 * int(key[0]))]})

    files = rows.groupBy("_part").applyInPandas(packed, "f string, b binary")
    dense, nothing = io.BytesIO(), io.BytesIO()
    np.savez(dense, matrix=np.zeros((2, 2)))
    np.savez(nothing, other=np.zeros(1))
    _files(files.unionByName(spark.createDataFrame([("dense.npz", bytearray(dense.getvalue())), ("none.npz", bytearray(nothing.getvalue()))], "f string, b binary")), path, "f", "b")
    found = readers.csr_matrix(spark, path)
    first = 200 * F.regexp_extract("file", "part-(-?[0-9]+)", 1).try_cast("long")  # a file's rows count from its own first one
    return found.withColumn("row", F.col("row") + first).groupBy("row").agg(F.sum("col").alias("cols"), F.sum("value").alias("total"))


@query("SELECT DISTINCT lang AS word FROM documents UNION SELECT DISTINCT source FROM documents")
def stopword_file(spark, d):
    """A list of words in a file, one a line, added to a base list."""
    path = new_path(spark, "stopwords")
    docs = table(spark, d, "documents")
    docs.select(F.explode(F.array("lang", F.concat(F.lit(" "), "source"), F.lit(""))).alias("value")).where("value IS NOT NULL").write.text(path)
    base = [r[0] for r in docs.select("lang").distinct().limit(2).collect()]
    return spark.createDataFrame([(w,) for w in readers.stopwords(spark, path, base)], "word string")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS words, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def registered_functions(spark, d):
    """Functions under their SQL names."""
    from ..register import register

    names = register(spark)
    if not {"lex_words", "lex_collapse", "lex_normalize"} <= set(names):
        raise ValueError("functions not registered")
    return table(spark, d, "documents").select("doc_id", F.expr("size(lex_words(text))").alias("words"), F.md5(F.expr("lex_collapse(text)").cast("binary")).alias("collapsed"))




@query("""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS lang, CASE WHEN doc_id * 2 <= (SELECT max(doc_id) FROM documents) THEN coalesce(source, '') END AS source FROM documents""")
def zipped_files(spark, d):
    """Three files written from one table, the third about half as long, joined by the number of the line."""
    path = new_path(spark, "zipped")
    rows = written(table(spark, d, "documents").select("doc_id", "lang", "source"), "rows-to-zip").orderBy("doc_id")
    most = rows.agg(F.max("doc_id")).first()[0] or 0
    parts = {"id": F.col("doc_id").cast("string"), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    for name, c in parts.items():
        (rows.where(F.col("doc_id") * 2 <= most) if name == "source" else rows).select(c.alias("value")).write.text(f"{path}/{name}")
    return readers.zipped_lines(spark, {name: f"{path}/{name}" for name in parts}, "pad")


@query("SELECT DISTINCT click_id FROM clicks")
def clicks_once(spark, d):
    """Clicks that arrive in overlapping parts, through a stream that is started anew for each: each id once."""
    path = new_path(spark, "clicks-once")
    rows = table(spark, d, "clicks").select("click_id")
    for n, part in enumerate(("click_id IS NULL OR click_id % 3 < 2", "click_id % 3 > 0", "true")):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        ingest.once_by_key(stream, f"{path}/out", f"{path}/state", "click_id").awaitTermination()
    return spark.read.parquet(f"{path}/out")


_STREAMED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9]+') AS w FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x GROUP BY term, doc_id), s AS (SELECT doc_id, len(w) AS dl FROM d),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5 AND score > 0"""


@query(_STREAMED)
def streamed_answers(spark, d):
    """The benchmark's items as questions that arrive in two files, each after a new start, joined with a written index."""
    path = new_path(spark, "questions")
    bm25.Index.build(table(spark, d, "documents")).write(f"{path}/index")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    for odd in (0, 1):
        asked.where(F.col("query_id") % 2 == odd).write.mode("append").json(f"{path}/in")
        ingest.answered(spark, f"{path}/in", f"{path}/index", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query_id", "doc_id", "score", "rank")


@query("""
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 700)) AS b FROM documents WHERE length(text) > 0)
SELECT doc_id, b // 700 AS n, b AS start, least(b + 900, length(text)) AS "end", md5(substring(text, b + 1, 900)) AS chunk FROM s""")
def sql_chunks(spark, d):
    """Chunks of whole documents by the table function, in SQL."""
    from ..register import register

    register(spark)
    return spark.sql("SELECT doc_id, c.n, c.`start`, c.`end`, md5(CAST(c.text AS BINARY)) AS chunk FROM {docs}, LATERAL lex_chunks(text) c", docs=table(spark, d, "documents").select("doc_id", "text"))


@query("""
SELECT doc_id, unnest(list_distinct(list_concat([CAST(doc_id * 7 % 1000 AS VARCHAR), (doc_id % 9 + 1) || '의2'], list_transform(range(doc_id % 20 + 1, doc_id % 20 + 5), lambda x: CAST(x AS VARCHAR))))) AS article FROM documents WHERE text IS NOT NULL""")
def sql_citations(spark, d):
    """Articles cited at the end of whole documents, one number, one with a part and a range, by the table function, in SQL."""
    from ..register import register

    register(spark)
    docs = table(spark, d, "documents").selectExpr("doc_id", "text || ' 제' || (doc_id * 7 % 1000) || '조, 제' || (doc_id % 9 + 1) || '조의2와 제' || (doc_id % 20 + 4) || '조부터 제' || (doc_id % 20 + 1) || '조까지' AS t")
    return spark.sql("SELECT doc_id, c.article FROM {docs}, LATERAL lex_citations(t) c", docs=docs)
