"""Tests, routes and labels of texts as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _text, collapse, sub


def holds_any(t: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))


def matches_any(t: Column, patterns: list[str], flags: str = "U") -> Column:
    return t.rlike(f"(?{flags})" + "|".join(patterns))


def relation(c: Column | str) -> Column:
    """The kind of citation that the first 300 characters of a text show."""
    t = F.substring(_text(c), 1, 300)
    return reduce(lambda other, r: F.when(holds_any(t, r[1]), F.lit(r[0])).otherwise(other), reversed(fixed.RELATIONS), F.lit(fixed.DEFAULT_RELATION))


def route(c: Column | str) -> Column:
    t = _text(c)
    return F.when(t.rlike(fixed.ROUTE_MITRE), "mitre").when(t.rlike(f"(?U){fixed.ROUTE_LAW}"), "law").otherwise("auto")


def detect_domain(question: Column | str, options: Column | None = None) -> Column:
    """law, mitre or unknown; if both show, an article or capital markets decide for law."""
    t = _text(question) if options is None else F.concat(_text(question), F.lit("\n"), F.array_join(options, "\n"))
    law, mitre = matches_any(t, fixed.DETECT_LAW, "iU"), matches_any(t, fixed.DETECT_MITRE, "iU")
    return F.when(law & (~mitre | t.rlike(f"(?U){fixed.DETECT_LAW_WINS}")), "law").when(mitre, "mitre").otherwise("unknown")


def domain_meta(c: Column | str, source: Column | None = None) -> Column:
    """Struct of domain (mitre, law or other) and, null where not apt, its articles, techniques and tactics (sorted)."""
    t = _text(c)
    s = F.lower(F.concat(_text(F.lit("") if source is None else source), F.lit("\n"), t))
    ids = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?U){p}"), F.lit(0))))
    techniques, tactics = ids(fixed.TECHNIQUE), ids(fixed.TACTIC)
    articles = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(f"(?U){fixed.ARTICLE_MENTION}"), F.lit(0)), lambda a: F.replace(a, F.lit(" "), F.lit("")))))
    mitre = holds_any(s, fixed.MITRE_HINTS) | (F.size(techniques) > 0) | (F.size(tactics) > 0) | holds_any(s, fixed.MITRE_WORDS)
    domain = F.when(mitre, "mitre").when(holds_any(s, fixed.LAW_WORDS), "law").otherwise("other")
    some = lambda a, d: F.when((domain == d) & (F.size(a) > 0), a)
    return F.struct(domain.alias("domain"), some(articles, "law").alias("articles"), some(techniques, "mitre").alias("techniques"), some(tactics, "mitre").alias("tactics"))


def asks_about_law(c: Column | str) -> Column:
    """By law words alone."""
    return holds_any(_text(c), fixed.LAW_QUESTION_WORDS)


def triggers_law(c: Column | str) -> Column:
    """By law signals, unless a word such as 'method' is there."""
    t = collapse(_text(c))
    return ~matches_any(t, fixed.LAW_VETOES) & matches_any(t, fixed.LAW_TRIGGERS)


def triggers_title(normalized: Column, keywords: Column) -> Column:
    """Whether a normalised question holds one of the keywords between blanks, and no word that vetoes."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return (normalized != "") & ~normalized.rlike(fixed.TITLE_VETOES) & F.exists(keywords, lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))


def is_negative(c: Column | str) -> Column:
    return holds_any(_text(c), fixed.NEGATIVE_CUES)


def is_broken(c: Column | str) -> Column:
    return _text(c).rlike(f"(?U){fixed.BROKEN}")


def is_number_answer(c: Column | str) -> Column:
    return _text(c).rlike(r"(?U)^\s*[1-9][0-9]?\s*$")


def clause_flags(c: Column | str) -> Column:
    t = _text(c)
    return F.array_compact(F.array(*(F.when(t.rlike(f"(?U){p}"), F.lit(name)) for name, p in fixed.CLAUSE_FLAGS)))


def mostly_korean(c: Column | str) -> Column:
    """No letter of another script than Hangul."""
    return ~sub(_text(c), "[가-힣ㄱ-ㅎㅏ-ㅣ]").rlike(r"(?U)\p{L}")
