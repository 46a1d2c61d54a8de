"""Text functions as Column expressions; the few that Spark lacks (NFKC, HTML entities) are Arrow UDFs.

A null text gives the result of an empty one unless a function says otherwise. Patterns use \\s, \\w and \\b in
the Unicode sense, (?U), as the texts are mostly Korean.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

SPACES = "[\u00a0\u1680\u180e\u2000-\u200b\u202f\u205f\u3000]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
SENTENCE_END_LAW = r"(?U)(?<=다\.)\s+|(?<=[.?！!])\s+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, body) -> Column:
    """body of the value of c, which is computed once: a lambda evaluates what it takes from outside for every element."""
    return F.element_at(F.transform(F.array(c), body), 1)


def bucket(n: int | Column, *parts: Column | str) -> Column:
    """A number from 0 to n - 1 that the parts decide: the first 15 hex digits of the MD5 of their texts, joined by bars."""
    joined = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n.cast("long")).cast("int")


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column, chars: str | None = None) -> Column:
    """Without blanks, or the given characters (of a class), at either end."""
    one = rf"[{chars}]" if chars else r"\s"
    return sub(c, rf"(?U)^{one}+|{one}+$")


def collapse(c: Column) -> Column:
    """Blanks of any kind as one space each, none at the ends."""
    return strip(sub(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_but_circled(texts: pd.Series) -> pd.Series:
    """Normal form KC with the circled numbers 1 to 20 left as they are, since they mark paragraphs."""

    def one(t: str) -> str:
        return "".join(p if p and 0x2460 <= ord(p[0]) <= 0x2473 else unicodedata.normalize("NFKC", p) for p in _runs(t))

    def _runs(t: str):
        start = 0
        for k, c in enumerate(t):
            if 0x2460 <= ord(c) <= 0x2473:
                yield t[start:k]
                yield c
                start = k + 1
        yield t[start:]

    return texts.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_collapsed(texts: pd.Series) -> pd.Series:
    """NFKC without zero-width spaces, blanks of any kind as one space, trimmed; in one pass, as its result is used many times."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).replace("\u200b", "").replace("\u180e", " ").split()), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


# --- normalisers -------------------------------------------------------------------------------------------


def normalize(c: Column | str) -> Column:
    """NFKC, no zero-width space, every blank a space, runs collapsed, trimmed."""
    return nfkc_collapsed(_text(c))


def normalize_lines(c: Column | str, compat: bool = False) -> Column:
    """As normalize, but line breaks stay, and only ends of lines are trimmed. compat: circled numbers are normalised too."""
    t = (nfkc if compat else nfkc_but_circled)(_text(c))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\u200b"), F.lit(""))
    return sub(sub(t, SPACES, " "), r"(?m)[ \t]+$")


def clean(c: Column | str) -> Column:
    """Ideographic and no-break spaces as spaces, runs of blanks as one, at most one empty line, trimmed."""
    t = F.translate(_text(c), "\u3000\u00a0", "  ")
    return strip(sub(sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def circled_to_digits(c: Column, upto: int = 20) -> Column:
    """① to ⑳ (or fewer) as decimal numbers."""
    return reduce(lambda t, k: F.replace(t, F.lit(chr(0x2460 + k - 1)), F.lit(str(k))), range(upto, 0, -1), c)


def clean_law(c: Column | str) -> Column:
    """Without <...> and [...] notes, circled numbers as digits, blanks tidied."""
    t = circled_to_digits(sub(sub(_text(c), r"<[^>]*>"), r"\[[^\]]*\]"))
    return strip(sub(sub(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_catalogue(c: Column | str) -> Column:
    """Without bracket pairs that hold a colon, innermost first until none is left, then allowed characters only."""
    t = _text(c)
    pairs = [(r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), ("（", "）"), ("［", "］"), ("｛", "｝")]
    inner = "|".join(rf"{a}[^{a}{b}\n]*[:：][^{a}{b}\n]*{b}" for a, b in pairs)
    # a pass takes the innermost pairs of each line away, so no more are needed than a line has opening brackets in a row of depth
    level = lambda line: F.aggregate(  # noqa: E731  the greatest depth of open brackets
        F.split(sub(line, r"[^()\[\]{}（）［］｛｝]"), ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, x: F.struct(F.greatest(F.lit(0), s["d"] + F.when(x.rlike(r"[(\[{（［｛]"), 1).when(x == "", 0).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(x.rlike(r"[(\[{（［｛]"), 1).otherwise(0)).alias("m")), lambda s: s["m"],
    )
    depth = F.coalesce(F.array_max(F.transform(F.split(t, "\n"), level)), F.lit(0))
    t = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), t, lambda acc, _: sub(acc, inner))).otherwise(t)
    return collapse(sub(t, r"[^가-힣a-zA-Z0-9\s.,;:!?\"'()\[\]{}_/\-]"))


def clean_markup(c: Column | str, unescape: bool = False) -> Column:
    """Without tags, links but for their text, backticks, emphasis and URLs; blanks and line breaks tidied."""
    t = sub(sub(_text(c), r"<[^>]+>", " "), r"\[([^\]]+)\]\((https?://[^\)]+)\)", "$1")
    t = sub(sub(sub(t, "`+", " "), r"\*\*?|__", " "), r"(?U)https?://\S+", " ")
    t = strip(sub(sub(t, r"[ \t]+", " "), r"(?U)\s*\n\s*", "\n"))
    return html_unescape(t) if unescape else t


def cut(c: Column | str, n: int = 1400) -> Column:
    """The first n characters, trimmed if that cuts."""
    t = _text(c)
    return F.when(F.length(t) <= n, t).otherwise(strip(F.substring(t, 1, n)))


def apply_glossary(c: Column | str, glossary: list[tuple[str, str]] = fixed.GLOSSARY) -> Column:
    """Each term, whatever its case, by its translation, at word boundaries and in the glossary's order."""
    quoted = lambda s: "".join("\\" + x if x in r"\.^$|?*+()[]{}" else x for x in s)
    return reduce(lambda t, g: sub(t, rf"(?iu)\b{quoted(g[0])}\b", g[1].replace("\\", r"\\").replace("$", r"\$")), glossary, _text(c))


def normalize_korean(c: Column | str) -> Column:
    return strip(sub(sub(_text(c), r"(?U)\s*\n\s*", " "), r"(?U)\s{2,}", " "))


def normalize_corpus(c: Column | str) -> Column:
    """For token counts: quotes unified, notes, markers of articles, bullets, bare dates and numbers taken out."""
    t = F.translate(nfkc(_text(c)), "“”‘’", "\"\"''")
    t = sub(t, r"<[^>]{1,80}>", " ")
    t = sub(t, r"(?U)\(\s*이하\s*[\"“']?([^\"”')]+)[\"”']?\s*라\s*한다\s*\)", " $1 ")
    t = sub(t, r"(?U)제\s*\d+\s*(?:장|조|항|호|목)", " ")
    t = sub(t, r"(?Um)(^|\n)\s*(?:\(?[0-9]+\)?|[가-힣]\.|\([가-힣0-9]+\)|[•·\-–—○●])\s*", "$1")
    t = sub(t, r"(?U)\(\s*(?:\d{2,4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}|[0-9,.\s]+)\s*\)", " ")
    t = F.translate(sub(t, "[「」]"), "〈〉《》", "    ")
    return sub(sub(t, r"(?U)\b\d{2,4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\b", " "), r"(?U)\b제\s*\d+\b", " ")


def normalize_query(c: Column | str) -> Column:
    """NFKC, quotes, brackets and punctuation as spaces, collapsed."""
    return collapse(sub(nfkc(_text(c)), "[〈<《》〉>「」\\[\\]()\"'·•※★☆,;:]", " "))


def to_text(c: Column, kind: str) -> Column:
    """A value of any type as text: strings as they are, null as '', others as JSON."""
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    if kind.startswith(("struct", "array", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


# --- tokenizers --------------------------------------------------------------------------------------------


def _filled(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def tokens_kept_case(c: Column | str) -> Column:
    """Runs of ASCII letters and digits and Hangul, case kept."""
    return F.regexp_extract_all(_text(c), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0))


def tokens_stripped(c: Column | str) -> Column:
    """Lower-case words between blanks and signs, without signs at their ends."""
    words = F.split(sub(F.lower(_text(c)), r"(?U)[^\w\s가-힣]", " "), r"(?U)\s+")
    return _filled(F.transform(words, lambda w: sub(w, "^[^0-9a-z가-힣]+|[^0-9a-z가-힣]+$")))


def tokens_lower(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits and Hangul."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[가-힣A-Za-z0-9]+"), F.lit(0))


def tokens_circled(c: Column | str) -> Column:
    """As tokens_lower, with ① to ⑫ read as numbers."""
    return tokens_lower(circled_to_digits(_text(c), 12))


def tokens_blank(c: Column | str) -> Column:
    """What stands between blanks, case kept."""
    return _filled(F.split(_text(c), r"(?U)\s+"))


TOKENIZERS = {"a": tokens_kept_case, "b": tokens_stripped, "c": tokens_lower, "c12": tokens_circled, "d": tokens_blank}


def corpus_tokens(c: Column | str, stopwords: list[str] = fixed.STOPWORDS, least: int = 2) -> Column:
    """Lower-case words with a letter, not all digits, of `least` characters or more, and no stopword."""
    words = F.transform(F.split(F.lower(_text(c)), r"(?U)\s+"), lambda w: sub(w, r"(?U)^[^\w가-힣]+|[^\w가-힣]+$"))
    stop = F.array(*(F.lit(w) for w in stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$") & w.rlike("[가-힣A-Za-z]") & ~F.array_contains(stop, w))


# --- chunks, sentences, snippets ---------------------------------------------------------------------------


def chunks(c: Column | str, size: int = 900, overlap: int = 200) -> Column:
    """Spans (start, end, text) of `size` characters that overlap; the last one ends with the text. Empty: none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def spans(t: Column) -> Column:
        n = F.length(t)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, F.length(t)).alias("end"), F.substring(t, s + 1, F.lit(size)).alias("text")))

    return let(_text(c), spans)


def chunks_trimmed(c: Column | str, size: int = 1200, overlap: int = 200) -> Column:
    """As chunks, without zero-width space and byte-order mark; texts trimmed, and empty ones dropped."""
    t = F.translate(_text(c), "\u200b\ufeff", "")
    spans = F.transform(chunks(t, size, overlap), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), strip(x["text"]).alias("text")))
    return F.filter(spans, lambda x: x["text"] != "")


def sentences(c: Column | str, law: bool = False) -> Column:
    """Sentences of a text that has been collapsed; law: also after the usual ending of a clause."""
    return _filled(F.split(_text(c), SENTENCE_END_LAW if law else SENTENCE_END))


def first_sentences(c: Column | str, n: int = 2) -> Column:
    parts = F.slice(F.split(strip(_text(c)), r"(?U)(?<=[.!?。！？])\s+"), 1, n)
    return strip(F.array_join(_filled(parts), " "))


def truncate(c: Column | str, n: int = 220) -> Column:
    t = strip(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(sub(F.substring(t, 1, n), r"(?U)\s+$"), F.lit("…")))


def shorten(c: Column | str, n: int = 180) -> Column:
    """Collapsed, and with the ellipsis no longer than n."""
    t = collapse(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(sub(F.substring(t, 1, n - 1), r"(?U)\s+$"), F.lit("…")))


def snippet(c: Column | str, words: Column, window: int = 300, most: int = 600) -> Column:
    """The text around the first of the words that it holds, whatever the case; else its beginning."""
    t = _text(c)
    hits = let(F.lower(t), lambda low: F.filter(F.transform(words, lambda w: F.struct(F.position(F.lower(w), low).alias("at"), F.length(w).alias("n"))), lambda x: x["at"] > 0))
    at, n, size = F.try_element_at(hits, F.lit(1))["at"], F.try_element_at(hits, F.lit(1))["n"], F.length(t)
    start, end = F.greatest(at - 1 - window, F.lit(0)), F.least(at - 1 + n + window, size)
    dots = lambda cond: F.when(cond, F.lit("…")).otherwise(F.lit(""))
    around = F.concat(dots(start > 0), F.substring(t, start + 1, end - start), dots(end < size))
    return F.when(at.isNotNull(), around).otherwise(F.concat(F.substring(t, 1, most), dots(size > most)))


def squash_repetition(c: Column | str) -> Column:
    """Each sentence once, in order of its first place; phrases of 3 to 10 characters said three times or more, once."""
    lines = F.array_distinct(_filled(F.transform(F.split(_text(c), SENTENCE_END), lambda x: strip(x))))
    return sub(sub(strip(F.array_join(lines, " ")), r"(?U)(\b.{3,10}?\b)(?:\s*\1){2,}", "$1"), r"(?U)\s{2,}", " ")


def clean_answer(c: Column | str) -> Column:
    return sub(collapse(F.translate(_text(c), "〈〉<>", "")), r"\.{2,}", "…")


def compress_answer(c: Column | str, n: int = 120) -> Column:
    """Two sentences, n characters."""
    parts = F.slice(F.split(clean_answer(c), r"(?U)(?<=[.!?。…])\s+"), 1, 2)
    return sub(F.substring(strip(F.array_join(parts, " ")), 1, n), r"(?U)\s+$")


def clean_open_answer(c: Column | str, question: Column | str) -> Column:
    """Without a role word at the head and an echo of the question, two sentences at most."""
    t = sub(strip(_text(c)), r"(?iU)^(?:assistant:|assistant)\s*")
    head = F.split(strip(_text(question)), "\n")[0]
    half = F.floor(F.length(head) / 2).cast("int")
    echo = (F.length(head) >= 6) & F.startswith(t, F.substring(head, F.lit(1), F.greatest(F.lit(6), half)))
    t = F.when(echo, sub(F.substring(t, half + 1, F.length(t)), r"(?U)^\s+")).otherwise(t)
    t = sub(sub(t, r"(?U)\s+", " "), r"\.{2,}", "…")
    parts = F.split(t, r"(?U)(?<=[.!?])\s+|(?<=다)\s+")
    return F.when(F.size(parts) > 2, strip(F.array_join(F.slice(parts, 1, 2), " "))).otherwise(t)


# --- questions and options ---------------------------------------------------------------------------------

OPTION_LINE = r"(?U)^\s*[1-9][0-9]?\s"


def _lines(c: Column | str) -> Column:
    return F.split(strip(_text(c)), "\n")


def is_multiple_choice(c: Column | str) -> Column:
    return F.size(F.filter(_lines(c), lambda x: x.rlike(OPTION_LINE))) >= 2


def question_of(c: Column | str) -> Column:
    return F.array_join(F.transform(F.filter(_lines(c), lambda x: ~x.rlike(OPTION_LINE)), lambda x: strip(x)), " ")


def options_of(c: Column | str) -> Column:
    return F.transform(F.filter(_lines(c), lambda x: x.rlike(OPTION_LINE)), lambda x: strip(x))


def option_numbers(options: Column, most: int = 10) -> Column:
    """Distinct numbers of options, ① to ⑫ included, from 1 to most, as sorted text; all of them if none is found."""
    found = F.regexp_extract_all(circled_to_digits(F.array_join(options, "\n"), 12), F.lit(r"(?m)^\s*([1-9][0-9]?)"), F.lit(1))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.cast("int") <= most)))
    return F.when(F.size(found) > 0, found).otherwise(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: k.cast("string")))


def strip_leads(options: Column) -> Column:
    """Options without their number, letter or circled number."""
    return F.transform(options, lambda o: strip(sub(o, r"(?U)^\s*(?:[0-9]+|[①-⑫]|[가-하]\)|[A-D]\)|[A-D]\.)[.)]?\s*")))


def enrich_query(c: Column | str) -> Column:
    """A multiple-choice question with its options appended, collapsed and sorted; any other as it is."""
    t = _text(c)
    return F.when(is_multiple_choice(t), F.concat_ws("\n", t, F.array_join(F.array_sort(F.transform(options_of(t), lambda x: collapse(x))), "\n"))).otherwise(t)


def extract_answer(c: Column | str, question: Column | str) -> Column:
    """What follows the last answer label: the first number from 1 to 99 for multiple choice, else cleaned text."""
    t = strip(F.element_at(F.split(_text(c), "답변:"), -1))
    number = F.regexp_extract(t, "([1-9][0-9]?)", 1)
    chosen = F.when(number == "", F.lit("0")).otherwise(number)
    return F.when(t == "", F.lit(fixed.NO_ANSWER)).when(is_multiple_choice(question), chosen).otherwise(clean_answer(t))


def parse_choices(c: Column | str) -> Column:
    """(number, text) of the lines after the label of options at the end; null if there are none or a line is no option."""
    block = strip(F.regexp_extract(_text(c), r"(?Us)선택지\s*:\s*\n(.+)$", 1))
    lines = F.filter(F.split(block, "\n"), lambda x: strip(x) != "")
    form = r"(?U)^\s*([1-9][0-9]?)\s+(.+?)\s*$"
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, form, 1).alias("number"), F.regexp_extract(x, form, 2).alias("text")))
    return F.when((F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(form)), pairs)


# --- items, summaries, definitions -------------------------------------------------------------------------


def _first_form(line: Column, forms: list[str]) -> Column:
    """The item in a line of the first form that fits, else ''."""
    return F.coalesce(*(F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in forms), F.lit(""))


def _stripped_lines(c: Column | str) -> Column:
    return _filled(F.transform(F.split(_text(c), "\n"), lambda x: strip(x)))


def enumerated(c: Column | str) -> Column:
    """Enumerated items of more than two characters, without signs at their end."""
    items = F.transform(_stripped_lines(c), lambda x: sub(sub(strip(_first_form(x, fixed.ENUM_FORMS)), r"(?U)\s+", " "), "[.,;: ]+$"))
    return F.filter(items, lambda x: F.length(x) > 2)


def summary(c: Column | str, n: int = 350) -> Column:
    """Five sentences if there are three, else n characters."""
    t = collapse(_text(c))
    parts = sentences(t, law=True)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 5), " ")).otherwise(F.substring(t, 1, n))


def bullets(c: Column | str, most: int = 6) -> Column:
    """Up to `most` items of more than two characters; without any, the first three sentences of more than five."""
    items = F.filter(F.transform(_stripped_lines(c), lambda x: collapse(_first_form(x, fixed.BULLET_FORMS))), lambda x: F.length(x) > 2)
    fallback = F.filter(F.slice(F.split(collapse(_text(c)), SENTENCE_END_LAW), 1, 3), lambda x: F.length(x) > 5)
    return F.when(F.size(items) > 0, F.slice(items, 1, most)).otherwise(F.slice(fallback, 1, most))


def bullets_three(c: Column | str, most: int = 6) -> Column:
    """At least three: items, or else clauses in the order of their buckets; no repeats, whatever the case; filled up."""
    tidy = lambda x: sub(strip(x), "[.,; ]+$")
    items = F.transform(_stripped_lines(c), lambda x: F.struct(_any(x).alias("hit"), tidy(collapse(_first_form(x, fixed.BULLET_FORMS))).alias("item")))
    items = F.slice(F.transform(F.filter(items, lambda x: x["hit"]), lambda x: x["item"]), 1, most)
    clauses = F.filter(F.transform(F.split(collapse(_text(c)), f"(?U){fixed.CLAUSE_SPLIT}"), lambda x: strip(x)), lambda x: F.length(x) > 3)
    clauses = _filled(F.transform(clauses, lambda x: sub(x, "[.,; ]+$")))
    rank = lambda x: reduce(lambda other, k: F.when(x.rlike(fixed.CLAUSE_BUCKETS[k]), F.lit(k)).otherwise(other), reversed(range(len(fixed.CLAUSE_BUCKETS))), F.lit(len(fixed.CLAUSE_BUCKETS)))
    ordered = F.array_sort(F.transform(clauses, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i"), x.alias("x"))))
    found = F.when(F.size(items) > 0, items).otherwise(F.slice(F.transform(ordered, lambda x: x["x"]), 1, most))
    once = let(found, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: F.lower(y) == F.lower(x))))
    missing = F.greatest(F.lit(3) - F.size(once), F.lit(0))
    filler = F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.size(once) + 1, missing), lambda k: F.concat(F.lit(fixed.FILLER), k.cast("string")))
    return F.slice(F.when(missing > 0, F.concat(once, filler)).otherwise(once), 1, most)


def _any(x: Column) -> Column:
    return reduce(lambda a, b: a | b, (x.rlike(p) for p in fixed.BULLET_FORMS))


def polite(c: Column) -> Column:
    t = reduce(lambda t, e: sub(t, e[0], e[1]), fixed.POLITE_ENDINGS, strip(c))
    return F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def definition(c: Column | str, n: int = 300) -> Column:
    """Three sentences in polite form, n characters."""
    parts = F.transform(_filled(F.split(collapse(_text(c)), r"(?U)(?<=다\.)\s+|(?<=[.!?])\s+")), lambda x: polite(x))
    return strip(F.substring(F.array_join(F.slice(parts, 1, 3), " "), 1, n))


def examples(c: Column | str, most: int = 2) -> Column:
    """Examples after a label, or else in brackets."""
    t = _text(c)
    labelled = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?U)(?:예:|예\)|예시:|예를 들어)\s*([^.。]+)"), F.lit(1)), lambda x: collapse(x)), lambda x: F.length(x) > 2)
    bracketed = _filled(F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\((?:예:|예시:)\s*([^)]{2,80})\)"), F.lit(1)), lambda x: collapse(x)))
    return F.slice(F.when(F.size(labelled) > 0, labelled).otherwise(bracketed), 1, most)


def contrast(c: Column | str) -> Column:
    """The first sentence of a text that sets something apart, else null."""
    return F.when(_text(c).rlike(fixed.CONTRAST), F.split(collapse(_text(c)), SENTENCE_END_LAW)[0])


def crop(c: Column | str, key: Column, n: int = 180) -> Column:
    """One or two sentences from the head, the middle or the tail, chosen by a hash of the key."""

    def cut(parts: Column) -> Column:
        size, mode, k = F.size(parts), bucket(3, key, "mode"), bucket(2, key, "many") + 1
        start = bucket(F.greatest(size - 2, F.lit(1)), key, "start") + 2
        head, tail = F.slice(parts, F.lit(1), k), F.slice(parts, F.greatest(size - k + 1, F.lit(1)), k)
        middle = F.when(size <= 2, parts).otherwise(F.slice(parts, start, k))
        return F.when(size == 0, F.lit("")).otherwise(shorten(F.array_join(F.when(mode == 0, head).when(mode == 1, middle).otherwise(tail), " "), n))

    return let(sentences(collapse(_text(c)), law=True), cut)


def expand(c: Column | str, term: Column, key: Column) -> Column:
    """The text between a prefix that names the term and a suffix, both chosen by a hash of the key."""
    pick = lambda options, salt: F.element_at(F.array(*options), bucket(len(options), key, salt) + 1)
    prefix = pick([F.replace(F.lit(form), F.lit("{term}"), term) for form in fixed.EXPAND_PREFIXES], "prefix")
    return shorten(F.concat(prefix, shorten(c, 220), pick([F.lit(s) for s in fixed.EXPAND_SUFFIXES], "suffix")), 240)


def surface_noise(c: Column | str, key: Column, share: float = 0.15) -> Column:
    """Particles and conjunctions swapped for others in about `share` of their places, chosen by a hash of key and place."""
    if int(share * 10_000) <= 0:
        return _text(c)  # no place is hit
    words = F.split(_text(c), " ")

    def one(w: Column, i: Column) -> Column:
        hit = bucket(10_000, key, i, "hit") < int(share * 10_000)
        swaps = reduce(lambda other, kv: F.when(w == kv[0], F.element_at(F.array(*map(F.lit, kv[1])), bucket(len(kv[1]), key, i, "which") + 1)).otherwise(other), fixed.NOISE.items(), w)
        return F.when(hit, swaps).otherwise(w)

    return F.array_join(F.transform(words, one), " ")


def noisy_output(c: Column | str, run: int = 6, lines: int = 3, english: float | None = 0.25) -> Column:
    """Whether a generated text has a run of signs, several lines of signs only, or too large a share of Latin letters."""
    t = _text(c)
    signs = r"""^[\s/*@#%=\-|_~\\.,:;^+!?\[\](){}<>'"]+$"""
    found = t.rlike(rf"[/*@#%=\-|_~\\]{{{run},}}") | (F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(signs))) >= lines)
    return found | (F.length(sub(t, "[^A-Za-z]")) > F.length(t) * english) if english is not None else found


def normalize_compared(c: Column | str, html_text: bool = False) -> Column:
    """An answer as it is compared: quotes as blanks, lower case, no ASCII punctuation, collapsed; html_text: no tags and no blanks."""
    t = html_unescape(sub(_text(c), r"<[^>]*>")) if html_text else _text(c)
    t = F.translate(F.lower(F.translate(t, fixed.ANSWER_SIGNS, " " * len(fixed.ANSWER_SIGNS))), fixed.ASCII_PUNCTUATION, "")
    return F.replace(collapse(t), F.lit(" "), F.lit("")) if html_text else collapse(t)
