"""What a model would do, as interfaces, with stand-ins that need none and repeat."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from .functions.text import tokens_lower


class Encoder(Protocol):
    """Turns a column of texts into a column of unit vectors."""

    def __call__(self, texts: Column) -> Column: ...


def hashed_encoder(dimension: int = 64, hashed: Callable[[str], int] = xxhash.xxh64_intdigest) -> Encoder:
    """A bag of hashed tokens at unit length; a text without tokens is a zero vector. Of a token's 64-bit hash the top bit is its sign."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(tokens: pd.Series) -> pd.Series:
        out = np.zeros((len(tokens), dimension), np.float64)
        for row, words in zip(out, tokens, strict=True):
            for w in words:
                h = hashed(w)
                row[h % dimension] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list((out / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return lambda texts: encode(tokens_lower(texts))


def prefixed(texts: Column, kind: str) -> Column:
    """Texts as encoders of this family want them: kind is 'passage' or 'query'."""
    return F.concat(F.lit(f"{kind}: "), F.coalesce(texts, F.lit("")))


def generated(df: DataFrame, prompt: str, generate: Callable[[list[str]], list[str]], batch: int = 16, out: str = "answer") -> DataFrame:
    """df with the answers of a function of lists of prompts, called with up to `batch` of them in a task."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])

    def run(parts):
        for rows in parts:
            prompts = rows[prompt].fillna("").tolist()
            yield rows.assign(**{out: [a for k in range(0, len(prompts), batch) for a in generate(prompts[k : k + batch])]})

    return df.mapInPandas(run, schema)


def translated(texts: Column, translate: Callable[[list[str]], list[str]] | None = None, batch: int = 16) -> Column:
    """Texts through a translator in batches; as they are without one, or where it fails."""
    if translate is None:
        return texts

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        out: list = []
        for k in range(0, len(values), batch):
            part = values[k : k + batch].tolist()
            try:
                out += translate(part)
            except Exception:  # the source text goes through
                out += part
        return pd.Series(out)

    return run(texts)


def two_stage(df: DataFrame, question: str, generate: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """Adds rationale and answer: a generator explains a multiple-choice question, then is asked for the number alone.

    The answer is the first allowed number in the second output, else in the first, else '0'.
    """
    from .functions.text import option_numbers, options_of

    columns = df.columns
    rows = generated(df.withColumn("_ask", F.concat(question, F.lit("\n\n풀이:"))), "_ask", generate, batch, "rationale")
    rows = generated(rows.withColumn("_ask", F.concat(question, F.lit("\n\n풀이: "), F.coalesce("rationale", F.lit("")), F.lit("\n\n정답 번호:"))), "_ask", generate, batch, "_said")
    allowed = option_numbers(options_of(question))
    number = lambda c: F.get(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([1-9][0-9]?)"), F.lit(1)), lambda x: F.array_contains(allowed, x)), F.lit(0))
    return rows.select(*columns, "rationale", F.coalesce(number("_said"), number("rationale"), F.lit("0")).alias("answer"))


def constrained_first(scores: Column, allowed: Column) -> Column:
    """Of a map from token to score the allowed token with the best one (the lower token at equal ones); null if none is allowed."""
    kept = F.filter(F.map_entries(scores), lambda e: F.array_contains(allowed, e["key"]))
    best = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.get(best, F.lit(0))["k"]


def korean_tokens(tokens: Column) -> Column:
    """The tokens a Korean-only output may use: Hangul, digits, blanks and common punctuation, no other letter."""
    return F.filter(tokens, lambda t: ~t.rlike(r"(?U)[\p{L}&&[^가-힣ㄱ-ㅎㅏ-ㅣ]]"))


def until_number(c: Column) -> Column:
    """A generated text up to the end of its first number; as it is without one."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)^(.*?[0-9]+)", 1)
    return F.when(found == "", F.coalesce(c, F.lit(""))).otherwise(found)


def best_option(options: Column, mean: bool = True) -> Column:
    """Of options (option, logprobs) the one whose continuation has the best log-probability, per token or in sum; the first at equal ones."""
    total = lambda x: F.aggregate(x["logprobs"], F.lit(0.0), lambda s, v: s + v)
    score = lambda x: total(x) / F.greatest(F.size(x["logprobs"]), F.lit(1)) if mean else total(x)
    ranked = F.array_sort(F.transform(options, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x["option"].alias("o"))))
    return F.get(ranked, F.lit(0))["o"]


def budgeted(ids: Column, window: int, answer: int) -> Column:
    """The last ids of an input that leave room for an answer of `answer` tokens in a window; at least one."""
    n = max(1, window - answer)
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def latest_run(names: Column) -> Column:
    """Of names of runs the one with the highest number at its end (checkpoint-200 before checkpoint-90), then by name."""
    return F.array_max(F.transform(names, lambda x: F.struct(F.coalesce(F.regexp_extract(x, "([0-9]+)$", 1).try_cast("long"), F.lit(-1)).alias("n"), x.alias("x"))))["x"]


def reranked(candidates: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Candidates (query_id, doc_id, rank, query, text) in the order of a score of query and text; as they are without one."""
    from pyspark.sql import Window

    if score is None:
        return candidates
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank", "doc_id")
    return candidates.withColumn("_s", score(F.col("query"), F.col("text"))).withColumn("rank", F.row_number().over(w)).drop("_s")
