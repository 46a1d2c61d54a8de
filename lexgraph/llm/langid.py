"""Language identification by nearest centroid.

A text is a vector of its letter bigrams and trigrams (hashed, sublinear counts times idf, unit length).
Each language has several centroids, found by spherical k-means over a bounded sample of its labelled
documents. A text gets the language of the centroid with the highest cosine, and is rejected if that is far
below what sample documents of that size reach with centroids of other documents.

The sample is all that the classifier is fitted on: up to `sample_docs` different whole documents of each
label, dealt by a hash of their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

BI, TRI = 10, 13
WIDTH = (1 << BI) + (1 << TRI)
BINS = 24
FILLED = 5  # documents of a size from which its usual cosine is known
UNKNOWN = "und"


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's lower-case letter bigrams and trigrams, all else being one blank between words, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    codes = np.concatenate([[32], codes[keep], [32] if is_letter[-1] else []]).astype(np.uint32)
    two = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)
    two ^= two >> np.uint32(15)
    three = two[:-1] * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
    three ^= three >> np.uint32(13)
    counts = np.bincount((two * np.uint32(374761393)) >> np.uint32(32 - BI), minlength=WIDTH)
    counts[1 << BI :] = np.bincount((three * np.uint32(2654435761)) >> np.uint32(32 - TRI), minlength=1 << TRI)
    found = np.flatnonzero(counts)
    return found, counts[found]


def size_bin(n: int) -> int:
    return min(BINS - 1, int(n).bit_length())


@dataclass
class Model:
    """What a fit leaves: idf, a row per centroid, its language, and per centroid's language and size of text the least cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]
    floors: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether it is rejected."""
        found, counts = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0, bool(self.names)
        weights = (1 + np.log(counts)) * self.idf[found]
        near = (weights / np.sqrt((weights * weights).sum())) @ self.columns[found]
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.names[best], score, score < self.floors[best, size_bin(len(found))]

    def __post_init__(self):
        self.columns = np.ascontiguousarray(self.centroids.T)


def _clusters(vectors: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors by spherical k-means from spread starting points, and each vector's best cosine."""
    x = np.zeros((len(vectors), WIDTH), np.float32)
    for row, (at, weight) in zip(x, vectors, strict=True):
        row[at] = weight
    start, near = [0], x @ x[0]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    centroids = x[start]
    for _ in range(rounds):
        best = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[best == c].sum(axis=0) if (best == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, (x @ centroids.T).max(axis=1)


def usual(best: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The usual cosine at each size, from cosines and sizes of documents; zeros if no size has enough of them.

    The median where enough are, else that of the nearest such size, and never less than at a smaller size. Below
    the smallest of them it falls with the root of the size.
    """
    known = np.array([b for b in range(BINS) if (bins == b).sum() >= FILLED])
    if not len(known):
        return np.zeros(BINS)
    medians = np.array([np.median(best[bins == b]) for b in known])
    nearest = np.abs(np.arange(BINS)[:, None] - known).argmin(axis=1)
    return np.maximum.accumulate(medians[nearest] * 2.0 ** (-np.maximum(0, known[0] - np.arange(BINS)) / 2))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 1000, per_language: int = 4, false_rejects: float = 0.001, seed: int = 9) -> Model:
    """Fit on labelled rows; those with a null text, label or id, or without a letter, teach nothing.

    Accepted is what reaches a share of its size's usual cosine in the language: the share that all but
    false_rejects of the sample reach, and half at most. A language without enough documents of any one size
    takes, for each size, the least that another language asks for; if there is none it rejects nothing.
    """
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id")).dropna()
    known = rows.groupBy(F.col("_lang").alias("_l")).agg(F.least(F.lit(1.0), F.lit(1.2 * sample_docs) / F.count("*")).alias("_share"))
    known = written(known, "labels")  # on disk its size is known: Spark broadcasts it only if it is small
    place = F.xxhash64(F.lit(seed), "_text").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    sample = rows.withColumn("_place", place).join(known, (F.col("_lang") == F.col("_l")) & (F.col("_place") < F.col("_share")))
    sample = sample.dropDuplicates(["_lang", "_place"])  # a text that is repeated is one

    def featured(batches):
        for batch in batches:
            found = [grams(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["_lang", "_place", "_at", "_tf"])

    sample = written(sample.select("_text", "_lang", "_place").mapInArrow(tidy(featured), "_lang string, _place double, _at array<long>, _tf array<long>").where("size(_at) > 0"), "langid-sample")
    n = sample.count()
    idf = np.full(WIDTH, np.log(1 + n) + 1)
    for at, df in sample.select(F.explode("_at").alias("at")).groupBy("at").count().collect():  # WIDTH rows at most
        idf[at] = np.log((1 + n) / (1 + df)) + 1

    def clustered(key, rows):
        rows = rows.nsmallest(sample_docs, "_place")
        vectors = []
        for at, tf in zip(rows["_at"], rows["_tf"], strict=True):
            w = (1 + np.log(tf)) * idf[at]
            vectors.append((at, w / np.sqrt((w * w).sum())))
        centroids, _ = _clusters(vectors, per_language)
        best = np.zeros(len(vectors))
        for half in (0, 1) if len(vectors) > 1 else ():  # cosines with centroids of the other half
            others, _ = _clusters(vectors[1 - half :: 2], per_language)
            best[half::2] = [float((others[:, at] @ w).max()) for at, w in vectors[half::2]]
        bins = np.array([size_bin(len(at)) for at, _ in vectors])
        typical = usual(best, bins)
        shares = best / typical[bins] if typical.any() else best[:0]
        m = len(centroids)
        return pd.DataFrame({"lang": [key[0]] * m, "centroid": list(centroids), "usual": [typical] * m, "shares": [shares] + [shares[:0]] * (m - 1)})

    found = sample.groupBy("_lang").applyInPandas(clustered, "lang string, centroid array<float>, usual array<double>, shares array<double>").collect()  # of each label per_language rows and sample_docs shares at most
    found.sort(key=lambda r: (r.lang, r.centroid))
    if not found:
        return Model(np.ones(WIDTH), np.zeros((0, WIDTH)), [], np.zeros((0, BINS)))
    typical, shares = np.array([r.usual for r in found]), np.sort([x for r in found for x in r.shares])
    if known_sizes := typical.any(axis=1).any():
        typical[~typical.any(axis=1)] = typical[typical.any(axis=1)].min(axis=0)
    share = min(0.5, float(shares[int(false_rejects * len(shares))])) if known_sizes else 0.0
    return Model(idf, np.array([r.centroid for r in found]), [r.lang for r in found], typical * share)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Return the columns in keep, lang_pred, score and rejected, a row for each of docs.

    lang_pred is 'und' and the score 0 for a text that is null or has no letter (which is rejected) and wherever
    no language is known (nothing is rejected then).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # per_language centroids of WIDTH numbers a label

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [shared.value.judge(t.as_py()) for t in part.column(text_at)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    names = [f"_in_{k}" for k in range(len(keep))]
    text_at = keep.index(text_col) if text_col in keep else len(keep)  # the text goes to Python once
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    schema = ", ".join([*(f"{a} {rows.schema[a].dataType.simpleString()}" for a in names), "lang_pred string, score double, rejected boolean"])
    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*(F.col(a).alias(c) for c, a in zip(keep, names, strict=True)), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Return id_col, held_out, lang_pred, score and rejected: fitted on the rows that are not held out, applied to all.

    Null ids are neither learned from nor held out. Repeated rows are judged alike; other columns are ignored.
    """
    marked = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_body"), F.col(lang_col).alias("_label")).withColumn("_out", held_out("_key"))
    model = fit(marked.where("NOT _out"), "_body", "_label", "_key", **how)
    out = predict(marked, model, "_body", ("_key", "_out"))
    return out.select(F.col("_key").alias(id_col), F.col("_out").alias("held_out"), "lang_pred", "score", "rejected")
