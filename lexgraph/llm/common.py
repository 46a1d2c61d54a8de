"""What several corpus operators share: the shared folder, written tables, words."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, new_path, shared_dir, written

__all__ = ["discard", "new_path", "shared_dir", "written"]

#: ASCII letters and digits and every byte of a non-ASCII character make words; A-Z become a-z, all else blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words as a pattern for SQL, on a text whose A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df has no column of, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_numbers(df: DataFrame, column: str) -> None:
    """Raise unless the column holds whole numbers, so that nothing fails in the midst of a job."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} must hold whole numbers, not {kind}")


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8, by WORD_BYTES; lone surrogates are replaced, null has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def tidy(run):
    """A function of Arrow batches that gives freed memory back to the system at its end: its worker stays, idle, beside others.

    In the worker Arrow takes memory from the system's pool, as its own keeps what it has freed.
    """

    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of n consecutive words; fewer words than n, but not none, are one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : len(hashes) - n + 1 + k]
    return np.unique(mix(out))


def groups(batches, keys: int):
    """Yield the rows of each run of equal values in the first `keys` columns (longs, not null) as Arrow tables.

    The input must be sorted by them; a run may span batches, and only the rows of one run are held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(marks[start].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def block_pairs(df: DataFrame, node: str, blocks: str | Column) -> DataFrame:
    """Deal the rows of a group to pairs of blocks (_i <= _j, with _side), so that any two rows meet in exactly one pair.

    `blocks` is a column with the group's number of blocks; a row goes to as many pairs.
    """
    blocks = F.col(blocks) if isinstance(blocks, str) else blocks
    df = df.withColumn("_mine", F.pmod(F.xxhash64(F.lit(41), F.col(node)), blocks))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return df.select("*", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), (F.col("_mine") > F.col("_other")).alias("_side")).drop("_mine", "_other")


def aligned(batches, keys: int):
    """Yield Arrow tables made of whole runs of equal values in the first `keys` columns; see groups()."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(keys)]
            here = int((marks == last).all(axis=1).argmin()) if not (marks == last).all() else batch.num_rows
            if here:
                held.append(batch.slice(0, here))
                batch, marks = batch.slice(here), marks[here:]
            if not batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == label).all():
            return new
        label = new
