"""Vector, array and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector is null."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null if there is none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    return F.when(F.size(kept) > 0, F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), kept[0]["v"], lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q), lambda s: F.transform(s, lambda x: x / F.size(kept))))


def saturate(score: Column, at: float = 10.0) -> Column:
    """score / (score + at), 0 where that is not defined."""
    return F.coalesce(F.try_divide(score, score + at), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the geometric mean of the numbers of distinct tokens."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / (F.sqrt(F.size(x)) * F.sqrt(F.size(y)) + 1e-6))


def answer_score(overlap: Column, length: Column, preferred: Column, bonus: float = 0.1) -> Column:
    """Rank of a candidate answer: overlap, length up to 400, and a share of the overlap if its source is preferred."""
    return overlap + 0.02 * F.least(length, F.lit(400)) + F.when(preferred, F.lit(bonus)).otherwise(F.lit(0.0)) * overlap


def split_size(n: Column, share: float) -> Column:
    """Rows of the first part of a split: rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("long"))


def position_of(options: Column, value: Column) -> Column:
    """1-based place of the first equal option, 0 if there is none."""
    return F.array_position(options, value)


def place_at(options: Column, value: Column, at: Column) -> Column:
    """The options with the value swapped to a 1-based place, the last one at most; as they are if it is not among them."""

    def placed(x: Column) -> Column:
        a, v = x["options"], x["value"]
        at, here = F.least(x["at"], F.size(a)), F.array_position(a, v).cast("int")
        swapped = let(F.struct(at.alias("at"), here.alias("here")), lambda p: F.transform(a, lambda o, i: F.when(i + 1 == p["at"], v).when(i + 1 == p["here"], F.element_at(a, p["at"])).otherwise(o)))
        return F.when(here > 0, swapped).otherwise(a)

    return let(F.struct(options.alias("options"), value.alias("value"), at.alias("at")), placed)


def masked_labels(prompt: Column, answer: Column, most: int = 2048) -> Column:
    """Labels of prompt and answer: -100 for the prompt's ids, cut at `most`."""
    return F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer), 1, most)


def pad_to_multiple(ids: Column, multiple: int = 8, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.pmod(-F.size(ids), F.lit(multiple))))


def grouped(words: Column, n: int = 40) -> Column:
    """Lines of n words each, joined by blanks."""

    def lines(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))

    return let(words, lines)
