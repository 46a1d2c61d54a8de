"""Maximal periodic runs of words, found from Lyndon arrays in linear time (Ellert and Fischer's scheme).

A run's period is the length of a Lyndon word that starts in it and is the longest one at its place, in the order of
words or in its reverse; so two arrays of next smaller suffixes, with the length to which both suffixes of each edge
agree, hold every run. The arrays are made in one pass from left to right. The furthest match seen is kept: what
begins inside it was compared before, one offset to the left, and only what reaches its end is compared word by word
from there on. No suffix array, suffix tree or fingerprint is used; words are compared by their place in any fixed
order, for which the order of first appearance in the text serves.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy

#: Codes of words: 64 bits hold every text that fits into memory.
CODE = "q"


def next_smaller(x: array, n: int) -> tuple[array, array]:
    """For each of n suffixes the next smaller one (n: none) and how far the two agree; x holds n codes and -1 at its end.

    The end of the text is smaller than every word, so a suffix that is a prefix of an earlier one is smaller.
    """
    nss, agree = array(CODE, [n]) * n, array(CODE, [0]) * n
    back, held = array(CODE, [-1]) * n, array(CODE, [-1]) * n  # the previous smaller suffix, and how far it agrees
    shift = first = end = 0  # x[first:end] equals what stands shift before it, and end is the furthest seen
    for r in range(1, n):
        l = r - 1  # noqa: E741
        s = r - shift
        m, scan = 0, True
        if r < end and l >= first:
            m = agree[l - shift] if nss[l - shift] == s else held[s]
            scan = r + m >= end
            if scan:
                m = end - r
        while True:
            if scan:
                while x[l + m] == x[r + m]:
                    m += 1
                if r + m >= end and m:
                    first, end, shift = r, r + m, r - l
            if x[l + m] < x[r + m]:
                break
            nss[l], agree[l] = r, m
            reach, l = held[l], back[l]  # noqa: E741
            if l < 0:
                break
            scan = m == reach
            if m > reach:
                m = reach
            elif scan and r + m < end and first < r and l >= first:
                k = agree[l - shift] if nss[l - shift] == s else held[s] if back[s] == l - shift else -1
                if k >= m:
                    scan = r + k >= end
                    m = end - r if scan else k
        back[r], held[r] = l, m if l >= 0 else -1
    return nss, agree


def runs(words: list[bytes], shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least `shortest` words and two periods, by start, then period."""
    n = len(words)
    codes: dict[bytes, int] = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if n < max(2, shortest) or len(codes) == n:
        return []
    before = np.concatenate([np.full(1, -1), coded])  # before[i] is the word before i
    found = set()
    for order in (coded, len(codes) - 1 - coded):
        x = array(CODE, np.append(order, -1).tobytes())
        nss, agree = (np.frombuffer(a, np.int64) for a in next_smaller(x, n))
        period = nss - np.arange(n)
        # the leftmost root of a run has less than a period of it on its left
        likely = (nss < n) & (agree > 0) & (agree + 2 * period > shortest) & ((agree >= period) | (before[:n] == before[nss]))
        for i in np.flatnonzero(likely).tolist():
            j, p, right = int(nss[i]), int(period[i]), int(agree[i])
            left, most = 0, min(p, i)
            while left < most and x[i - 1 - left] == x[j - 1 - left]:
                left += 1
            if left < p and left + right >= p and left + p + right >= shortest:
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda f: (f[0], f[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, text_col: str | Column = "text", shortest: int = 12, collapse: bool = True) -> DataFrame:
    """docs with _n_words, _runs (array of start, length, period; numbers of words from 0) and _collapsed.

    Words are what stands between ASCII blanks (U+0020, U+0009 to U+000D). A run is a stretch of words with smallest
    period q (words q apart are the same) of at least two periods and `shortest` words, which no neighbouring word
    extends. _collapsed joins by one blank the words that no run holds after its first period; without collapse it
    is null. A null or empty text has no words, no runs and an empty _collapsed. Every row is a text of its own,
    so rows that repeat give rows that repeat; other columns stay, and those named as ours get a longer name of
    ours beside them. A text is one task's work, in memory in proportion to its length.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    bytes_col = fresh(docs, "_bytes")
    names = [fresh(docs, c) for c in ("_n_words", "_runs", "_collapsed")]
    kept_columns = [f for f in docs.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns), f"`{names[0]}` long, `{names[1]}` array<struct<start:long,length:long,period:long>>, `{names[2]}` string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(bytes_col)
            counts, spans, collapsed = [], [], []
            for data in batch.column(at):
                words = (data.as_py() or b"").split()
                found = runs(words, shortest)
                counts.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if collapse:
                    left = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()] if found else words
                    collapsed.append(b" ".join(left).decode())
                else:
                    collapsed.append(None)
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at]
            heads = [batch.schema.names[i] for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(collapsed, pa.string())], names=[*heads, *names])

    return docs.withColumn(bytes_col, text.cast("binary")).mapInArrow(tidy(of), schema)
