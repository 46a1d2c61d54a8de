"""Sources: text files, JSON lines in their strict and tolerant forms, indexes, CSV, catalogues, DOCX."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql import types as T

from ..functions import fixed

CHUNK = "id string, text string, source string, start int, end int, extra map<string,string>"
STIX = "objects array<struct<type:string,id:string,name:string,description:string,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"


def _name(c: str = "_metadata.file_path") -> Column:
    return F.url_decode(F.regexp_extract(F.replace(F.col(c), F.lit("+"), F.lit("%2B")), "([^/]+)$", 1))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@F.pandas_udf(StringType())
def decoded(blobs: pd.Series) -> pd.Series:
    """UTF-8, else CP949, else EUC-KR, else UTF-8 without what cannot be read."""

    def one(b: bytes) -> str:
        for name in ("utf-8", "cp949", "euc-kr"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "ignore")

    return blobs.map(one, na_action="ignore")


def text_files(spark: SparkSession, paths: str | list[str], glob: str = "*.txt", encoding: str = "ignore") -> DataFrame:
    """(file, path, text) of whole files, CRLF as LF.

    encoding 'ignore' leaves out bytes that are no UTF-8, 'strict' fails on them, 'fallback' tries the Korean
    encodings, 'bom' is 'ignore' without a byte-order mark.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    text = {"strict": F.validate_utf8(F.col("content").cast("string")), "fallback": decoded("content")}.get(encoding, F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))
    text = F.regexp_replace(text, "^﻿", "") if encoding == "bom" else text
    return raw.select(_name("path").alias("file"), F.col("path"), F.replace(text, F.lit("\r\n"), F.lit("\n")).alias("text"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, mode: str = "tolerant", missing_ok: bool = False) -> DataFrame:
    """Records of JSON lines; blank lines are passed over.

    mode 'tolerant' leaves out malformed lines, 'strict' fails on them. missing_ok gives no rows where there is no file.
    """
    if missing_ok:
        paths = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], T._parse_datatype_string(schema))
    reader = spark.read.schema(schema).option("mode", {"tolerant": "DROPMALFORMED", "strict": "FAILFAST"}[mode])
    return reader.json(paths)


def first_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_lines(spark, path, schema).limit(1)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, 0 without a file."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, or of a folder's files by name: line counts from 0, over all splits of all files.

    A split's lines stay in order and are numbered in it; the counts of the splits before it, a row for each split, lead them.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), "value")
    splits = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_f").alias("_sf"), F.col("_b").alias("_sb"), (before - F.col("_first")).alias("_shift"))
    return rows.join(splits, (F.col("_f") == F.col("_sf")) & (F.col("_b") == F.col("_sb"))).select((F.col("_m") + F.col("_shift")).alias("line"), "value")


def zipped_lines(spark: SparkSession, paths: dict[str, str], lengths: str = "fail") -> DataFrame:
    """line and a column per name in paths: the lines of equal number of several files, joined by that number.

    lengths says what happens where files differ in their number of lines: 'fail' raises an error that names the numbers,
    'pad' has nulls after the end of the shorter ones.
    """
    if lengths not in ("fail", "pad"):
        raise ValueError("lengths must be 'fail' or 'pad'")
    files = {name: numbered_lines(spark, path).withColumnRenamed("value", name) for name, path in paths.items()}
    if lengths == "fail":
        counts = {name: spark.read.text(path).count() for name, path in paths.items()}
        if len(set(counts.values())) > 1:
            raise ValueError(f"files differ in their number of lines: {counts}")
    return reduce(lambda a, b: a.join(b, "line", "full_outer" if lengths == "pad" else "inner"), files.values())


def mixed_sources(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, path) of .txt and .jsonl files, each once, in order of path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,jsonl}").load(paths)
    return raw.select(_name("path").alias("file"), "path").distinct().orderBy("path")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, title, law, text) and edges (src, dst, relation) of a graph's JSON."""
    schema = "nodes array<struct<id:string,title:string,law:string,text:string>>, edges array<struct<src:string,dst:string,relation:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    edges = raw.select(F.explode("edges").alias("e")).select("e.src", "e.dst", F.coalesce("e.relation", F.lit(fixed.DEFAULT_RELATION)).alias("relation"))
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), edges


def trees(spark: SparkSession, path: str, key: str = "law", fields: str | None = None) -> DataFrame:
    """Nodes (key, node_id, parent_id, the fields, depth) of JSON lines {key, tree} with children inside their parents, to whatever depth."""
    from ..operators import trees as made

    fields = fields or made.FIELDS
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"`{key}` string, tree {made.parsed_type(fields)}", {"mode": "FAILFAST"}).alias("x"))
    return made.flat(lines.select("x.*"), key, fields)


def attack_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a STIX bundle."""
    return spark.read.schema(STIX).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of questions; a field may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def question_column(columns: list[str]) -> str:
    """The column that holds the question: by usual names, else the first."""
    return next((c for c in fixed.QUESTION_COLUMNS if c in columns), columns[0])


def question_and_options(columns: list[str]) -> tuple[str, list[str]]:
    """The question's column by a part of its name, and the option columns by the number in theirs (999 without one)."""
    question = next((c for c in columns if any(w in c.lower() for w in ("question", "질문", "문제", "prompt"))), columns[0])
    number = lambda c: int(m[0]) if (m := re.search("[0-9]+", c)) else 999
    options = [c for c in columns if c != question and any(w in c.lower() for w in ("option", "choice", "선택", "보기"))]
    return question, sorted(options, key=number)


@F.pandas_udf(StringType())
def docx_text(blobs: pd.Series) -> pd.Series:
    """Paragraphs of DOCX files that are not blank, a line each; null for what is no DOCX file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(b: bytes) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(b)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
        return "\n".join(x.strip() for x in lines if x.strip())

    return blobs.map(one, na_action="ignore")


def docx_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(paths)
    return raw.select(_name("path").alias("file"), docx_text("content").alias("text"))


def meta_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, title, text) of an index's meta in any of its forms, gzipped or not.

    A JSON array, an object that wraps one or is a single record, JSON lines, or plain lines. A record's text
    and title are under the first of the usual keys that has one; a record of another type is its own text.
    """
    whole = spark.read.text(path, wholetext=True).select(_name("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("v"))
    array = F.from_json("v", "array<string>")
    wrapped = F.coalesce(*(F.from_json(F.get_json_object("v", f"$.{k}"), "array<string>") for k in fixed.WRAPPER_KEYS))
    single = F.array("v")
    lines = F.filter(F.split("v", "\r?\n"), lambda x: F.trim(x) != "")
    start = F.substring(F.ltrim("v"), 1, 1)
    is_lines = (F.size(lines) > 1) & F.get_json_object(lines[0], "$").isNotNull()
    items = F.when(start == "[", F.coalesce(array, lines)).when((start == "{") & ~is_lines, F.coalesce(wrapped, single)).otherwise(lines)
    rows = whole.select("file", F.posexplode(items).alias("ord", "r")).where(F.trim("r") != "")
    key = lambda names: F.coalesce(*(F.nullif(F.get_json_object("r", f"$.{k}"), F.lit("")) for k in names))
    is_object = F.substring(F.ltrim("r"), 1, 1) == "{"
    text = F.when(is_object, F.coalesce(key(fixed.TEXT_KEYS), F.col("r"))).otherwise(F.col("r"))
    return rows.select("file", "ord", F.when(is_object, key(fixed.TITLE_KEYS)).alias("title"), text.alias("text"))


def squad(spark: SparkSession, path: str) -> DataFrame:
    """(id, answers) of a directory or file of nested question sets; single answers too."""
    qa = "id:string,question:string,answers:array<struct<text:string>>,answer:struct<text:string>"
    raw = spark.read.schema(f"data array<struct<paragraphs:array<struct<qas:array<struct<{qa}>>>>,qas:array<struct<{qa}>>>>").json(path, multiLine=True)
    docs = raw.select(F.explode("data").alias("d"))
    qas = F.concat(F.coalesce("d.qas", F.array().cast(f"array<struct<{qa}>>")), F.coalesce(F.flatten(F.transform("d.paragraphs", lambda p: p["qas"])), F.array().cast(f"array<struct<{qa}>>")))
    rows = docs.select(F.explode(qas).alias("q"))
    return rows.select("q.id", F.coalesce(F.transform("q.answers", lambda a: a["text"]), F.array("q.answer.text")).alias("answers"))


def csr_matrix(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, row, col, value) of sparse matrices in .npz files: the arrays of the compressed rows, or a dense array `matrix`.

    A file without them has no rows. Nothing pickled is read.
    """
    def entries(parts):
        for files in parts:
            for name, data in zip(files["file"], files["content"], strict=True):
                with np.load(io.BytesIO(data), allow_pickle=False) as found:
                    if {"data", "indices", "indptr"} <= set(found.files):
                        rows = np.repeat(np.arange(len(found["indptr"]) - 1), np.diff(found["indptr"]))
                        cols, values = found["indices"], found["data"]
                    elif "matrix" in found.files and found["matrix"].ndim == 2:
                        rows, cols = np.nonzero(found["matrix"])
                        values = found["matrix"][rows, cols]
                    else:
                        continue
                yield pd.DataFrame({"file": name, "row": rows.astype(np.int64), "col": cols.astype(np.int64), "value": values.astype(np.float64)})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(paths).select(_name("path").alias("file"), "content")
    return raw.mapInPandas(entries, "file string, row long, col long, value double")


def vector_index(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """A written index; fails if a vector has another length than stated."""
    rows = spark.read.parquet(path)
    if dimension is None:
        return rows
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, found "), F.size("embedding"))))
    return rows.withColumn("embedding", checked)


def stopwords(spark: SparkSession, path: str | None = None, base: list[str] = fixed.STOPWORDS, most: int = 100_000) -> list[str]:
    """The base list and the words of a file, one a line, if there is one; fails on more than `most` of them."""
    found = set(base)
    if path and exists(spark, path):
        rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{path} has more than {most} words")
        found |= {r.w for r in rows}
    return sorted(found)
