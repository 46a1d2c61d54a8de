"""Answer quality: exact match, character F1 over several right answers, perplexity and throughput."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import normalize_compared, sub


def common_characters(a: Column, b: Column) -> Column:
    """Characters that two texts share, each as often as in both: sums the lesser count of every distinct one, in one look at each text."""

    @F.pandas_udf(LongType())
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(first, second, strict=True)], dtype="Int64")

    return run(a, b)


def f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of the characters of two normalised texts without blanks; 0 if they share none."""
    same = common_characters(a, b)
    precision, recall = same / F.nullif(F.length(a), F.lit(0)), same / F.nullif(F.length(b), F.lit(0))
    return F.when(same == 0, F.lit(0.0)).otherwise(F.coalesce(2 * precision * recall / (precision + recall), F.lit(0.0)))


def scores(questions: DataFrame, predictions: DataFrame, html_text: bool = False) -> DataFrame:
    """(id, exact_match, f1) of questions (id, answers) and predictions (id, prediction): best over the answers, 0 without a prediction."""
    rows = questions.join(predictions.select("id", "prediction"), "id", "left").select("id", "prediction", F.explode_outer("answers").alias("answer"))
    texts = rows.select("id", F.array(*(F.when(F.col("prediction").isNotNull() & F.col("answer").isNotNull(), normalize_compared(c, html_text)) for c in ("prediction", "answer"))).alias("t"))
    texts = texts.select("id", F.explode(F.array("t")).alias("t"))  # normalised once, ahead of the lambdas that use it
    same = (F.col("t")[0] == F.col("t")[1]).cast("double")
    pairs = texts.select("id", same.alias("em"), F.transform("t", lambda x: sub(x, r"(?U)\s+")).alias("c"))
    pairs = pairs.select("id", "em", F.explode(F.array("c")).alias("c"))
    best = lambda c: F.max(F.coalesce(c, F.lit(0.0)))
    return pairs.groupBy("id").agg(best(F.col("em")).alias("exact_match"), best(f1(F.col("c")[0], F.col("c")[1])).alias("f1"))


def evaluate(questions: DataFrame, predictions: DataFrame, html_text: bool = False) -> DataFrame:
    """One row: n, exact_match and f1 in percent over all questions."""
    mean = lambda c: F.coalesce(F.try_divide(100 * F.sum(c), F.count("*")), F.lit(0.0)).alias(c)
    return scores(questions, predictions, html_text).agg(F.count("*").alias("n"), mean("exact_match"), mean("f1"))


def perplexity(rows: DataFrame, loss: str = "loss", tokens: str = "tokens", seconds: str = "seconds") -> DataFrame:
    """One row: loss, perplexity, tokens and tokens a second of evaluated batches."""
    return rows.agg(F.avg(loss).alias("loss"), F.exp(F.avg(loss)).alias("perplexity"), F.sum(tokens).alias("tokens"), F.try_divide(F.sum(tokens).cast("double"), F.sum(seconds)).alias("tokens_per_second"))
