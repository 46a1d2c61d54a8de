"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import text
from .operators.law import LONGEST_RANGE
from .sources.readers import docx_text

#: Functions that are SQL expressions of one text, as SQL functions of a session.
SQL_FUNCTIONS = {
    "lex_collapse": r"trim(regexp_replace(coalesce(t, ''), '(?U)\\s+', ' '))",
    "lex_words": "regexp_extract_all(lower(coalesce(t, '')), '[가-힣A-Za-z0-9]+', 0)",
    "lex_words_kept_case": "regexp_extract_all(coalesce(t, ''), '[0-9A-Za-z가-힣]+', 0)",
    "lex_is_number_answer": r"coalesce(t, '') rlike '(?U)^\\s*[1-9][0-9]?\\s*$'",
}

_SINGLE = r"(?:제 ?)?([0-9]+) ?조(?: ?의 ?([0-9]+))?(?: ?제 ?[0-9]+ ?항)?"
_RANGE = r"(?:제 ?)?([0-9]+) ?조 ?(?:부터|이상) ?(?:제 ?)?([0-9]+) ?조 ?(?:까지|이하)"
_LOW, _HIGH = "least(try_cast(a AS BIGINT), try_cast(b AS BIGINT))", "greatest(try_cast(a AS BIGINT), try_cast(b AS BIGINT))"
_SHORT = f"(try_cast(a AS BIGINT) IS NOT NULL AND try_cast(b AS BIGINT) IS NOT NULL AND {_HIGH} - {_LOW} <= {LONGEST_RANGE})"
_SPELLED = f"CASE WHEN {_SHORT} THEN transform(sequence({_LOW}, CASE WHEN {_SHORT} THEN {_HIGH} ELSE {_LOW} END), k -> CAST(k AS STRING)) ELSE array(regexp_replace(a, '^0+(?=[0-9])', ''), regexp_replace(b, '^0+(?=[0-9])', '')) END"

#: Table functions, for LATERAL: parameters, columns and query. Each is a plain Generate in the plan.
TABLE_FUNCTIONS = {
    # spans of a text, as functions.text.chunks
    "lex_chunks": (
        "t STRING, size INT DEFAULT 900, overlap INT DEFAULT 200",
        "n INT, `start` INT, `end` INT, `text` STRING",
        """SELECT p, x.s, x.e, x.c FROM (SELECT posexplode(transform(CASE WHEN length(t) > 0 THEN sequence(0, greatest(length(t) - overlap - 1, 0), size - overlap) ELSE CAST(array() AS ARRAY<INT>) END,
          i -> named_struct('s', i, 'e', least(i + size, length(t)), 'c', substring(t, i + 1, size)))) AS (p, x))""",
    ),
    # articles that a normalised text cites, as operators.law.reference_keys
    "lex_citations": (
        "t STRING",
        "article STRING",
        f"""SELECT k FROM (SELECT explode(array_distinct(concat(
          zip_with(regexp_extract_all(t, r'{_SINGLE}', 1), regexp_extract_all(t, r'{_SINGLE}', 2), (a, b) -> concat(a, CASE WHEN coalesce(b, '') = '' THEN '' ELSE concat('의', b) END)),
          flatten(zip_with(regexp_extract_all(t, r'{_RANGE}', 1), regexp_extract_all(t, r'{_RANGE}', 2), (a, b) -> {_SPELLED}))))) AS k)""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Register lex_* functions for SQL: the Arrow ones that SQL lacks, some that are SQL and table functions; returns their names."""
    found = {"lex_nfkc": text.nfkc, "lex_nfkc_but_circled": text.nfkc_but_circled, "lex_normalize": text.nfkc_collapsed, "lex_html_unescape": text.html_unescape, "lex_docx_text": docx_text}
    for name, fn in found.items():
        spark.udf.register(name, fn)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURN {body}")
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return sorted([*found, *SQL_FUNCTIONS, *TABLE_FUNCTIONS])
