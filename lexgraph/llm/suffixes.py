"""Exact substring deduplication by suffix arrays, built by difference cover (DC3) over distributed deals of suffixes.

A suffix matters by its first `length` bytes. Suffixes are dealt by an anchor that those bytes decide alone: the least
hash among the grams in them; so equal prefixes always meet, and neighbours with one anchor travel as one piece of
text. Of equal pieces the earliest speaks for all, the others are repeated as a whole; a deal of one piece holds
nothing repeated and needs no sorting. The texts are never shuffled: what concerns a text is written to a table by
the file that holds it, and read there. A deal too large for one task is dealt again by
grams of another hash, in the end by whole prefixes. Each deal's pieces are then sorted as suffixes: triples at two of
three places are sorted and named, the names' own suffixes are sorted by recursion, the remaining third is merged in;
adjacent prefixes are compared, and of each class of equal ones all but the earliest are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aligned, fresh, mix, new_path, tidy, whole_numbers, written

#: Bytes of a gram whose hash may be an anchor.
GRAM = 32
#: Prefixes that are dealt at a time; a piece holds no more.
BLOCK = 1 << 20
#: Bytes of one suffix array, and of a deal beyond which it is dealt again. The names of DC3 are packed into 64 bits.
MOST, HOT = (1 << 21) - 8, 1_500_000
#: Deals by grams before whole prefixes decide.
ROUNDS = 3


def anchors(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of `length` bytes the least hash of the grams in them, and whether the first gram has it.

    In round ROUNDS the hash is that of all the bytes.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    whole = seed >= ROUNDS
    gram = length if whole else 1 << (min(GRAM, length).bit_length() - 1)
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    base, one = pow(0x100000001B3, 1, 1 << 64), letters[data]
    # hashes of 1, 2, 4 ... bytes; those of the gram are put together of them
    size, h, done, out = 1, one, 0, None
    while True:
        if gram & size:
            out = h[: len(data) - size + 1] if out is None else out[: len(data) - done - size + 1] * np.uint64(pow(base, size, 1 << 64)) + h[done : len(data) - size + 1]
            done += size
        if 2 * size > gram:
            break
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    out = mix(out)
    grams, width, size = out, length - gram + 1, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    out = np.minimum(out[:n], out[width - size : width - size + n])
    return out, grams[:n] == out


def pieces(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in data, prefixes, anchor) of each run of neighbouring prefixes with one anchor; texts end at `ends`.

    The anchor is one place in the text, the first with the least hash, so equal prefixes never share a run.
    """
    out = []
    for low in range(0, max(0, len(data) - length + 1), BLOCK):
        found, leaves = anchors(data[low : low + BLOCK + length - 1], length, seed)
        at = np.arange(low, low + len(found))
        text = np.searchsorted(ends, at, side="right")
        inside = at + length <= ends[text]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (found[1:] != found[:-1]) | leaves[:-1] | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        stop = np.append(np.flatnonzero(new | ~inside), len(found))
        last = stop[np.searchsorted(stop, first, side="right")] if len(first) else first
        out.append((text[first], first + low, last - first, found[first]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def suffix_ranks(x: np.ndarray) -> np.ndarray:
    """The rank of every suffix of x (whole numbers, at least 1) by the difference cover modulo 3."""
    n = len(x)
    if n < 3:
        out = np.empty(n, np.int64)
        out[sorted(range(n), key=lambda i: x[i:].tolist())] = np.arange(n)
        return out
    padded = np.concatenate([x, np.zeros(3, np.int64)]).astype(np.int64)
    kinds = np.uint64(int(padded.max()) + 1)
    letters = padded.astype(np.uint64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = (letters[sample] * kinds + letters[sample + 1]) * kinds + letters[sample + 2]
    names = np.unique(triples, return_inverse=True)[1].astype(np.int64) + 1
    if int(names.max()) < len(names):
        names = suffix_ranks(names) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    # the remaining third, sorted by its first letter and the rank of what follows
    zero = np.arange(0, n, 3)
    room = np.uint64(n + 3)
    with_next = lambda i: letters[i] * room + rank[i + 1].astype(np.uint64)
    with_second = lambda i: (letters[i] * kinds + letters[i + 1]) * room + rank[i + 2].astype(np.uint64)
    zero = zero[np.argsort(with_next(zero), kind="stable")]
    order = np.empty(len(sample), np.int64)
    order[names - 1] = sample
    order = order[order < n]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    place = np.searchsorted(with_next(ones), with_next(zero)) + np.searchsorted(with_second(twos), with_second(zero)) + np.arange(len(zero))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[zero] = place
    out[order] = np.flatnonzero(~taken)
    return out


def repeated(texts: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, prefixes) of the runs of prefixes that also start earlier; place orders the texts, equal ones are one."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + bytes(9), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    letters = data[: starts[-1] + sizes[-1]].astype(np.int64) + 2
    separators = starts[1:] - 1
    letters[separators] = 1
    sa = np.empty(len(letters), np.int64)
    sa[suffix_ranks(letters)] = np.arange(len(letters))
    text = np.repeat(np.arange(len(texts)), sizes + 1)[: len(letters)]
    inside = np.arange(len(letters)) + length <= starts[text] + sizes[text]
    sa = sa[inside[sa]]
    # adjacent prefixes, eight bytes at a time, as long as they agree
    words = sum(data[k : k + len(letters)].astype(np.uint64) << np.uint64(8 * k) for k in range(8))
    same = np.arange(1, len(sa))
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        column = words if length >= 8 else data
        same = same[column[sa[same] + at] == column[sa[same - 1] + at]]
    first = np.ones(len(sa), bool)
    first[same] = False
    order = place[text[sa]] * np.int64(1 << 22) + (sa - starts[text[sa]])
    heads = np.flatnonzero(first)
    least = np.minimum.reduceat(order, heads) if len(heads) else order
    found = np.zeros(len(letters) + 1, bool)
    found[sa[order > least[np.cumsum(first) - 1]]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], found]).astype(np.int8)))
    low, high = edges[0::2], edges[1::2]
    return text[low], low - starts[text[low]], high - low


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


PLACE = ["_file", "_o", "_d", "_start", "_n"]
PLACED = "_file int, _o long, _d long, _start long, _n long"


def _dealt(length: int):
    """Pieces of whole texts; of those that are equal within a batch only the earliest is not _later."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.as_buffer() for t in batch.column(3)]
            ends, raw = np.cumsum([len(t) for t in texts]), b"".join(texts)
            text, start, n, anchor = pieces(np.frombuffer(raw, np.uint8), ends, length, 0)
            view = memoryview(raw)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[s : s + m + length - 1]) for s, m in zip(start.tolist(), n.tolist(), strict=True)), np.uint64, len(start))
            start = start - np.append(0, ends)[text]
            file, o, d = (batch.column(k).to_numpy()[text] for k in range(3))
            order = np.lexsort((start, d, o, digest, anchor))
            later = np.empty(len(order), bool)
            later[order] = ~_changes(anchor[order], digest[order])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (file, o, d, start, n, anchor.view(np.int64), digest.view(np.int64), later))), names=[*PLACE, "_anchor", "_digest", "_later"])

    return run


def _firsts(batches) -> Iterator[pa.RecordBatch]:
    """Of the pieces of each anchor, sorted by digest and place: those that repeat an earlier one, and the distinct ones where there are several."""
    for table in aligned(batches, 1):
        file, o, d, start, n, anchor, digest, later = (table.column(c).to_numpy() for c in (*PLACE, "_anchor", "_digest", "_later"))
        at = np.flatnonzero(~later)
        if len(at):
            first = _changes(anchor[at], digest[at])
            heads = np.flatnonzero(_changes(anchor[at]))
            several = np.repeat(np.add.reduceat(first.astype(np.int64), heads) > 1, np.diff(np.append(heads, len(at))))
            chosen, gone = at[first & several], np.concatenate([np.flatnonzero(later), at[~first]])
        else:
            chosen, gone = at, np.flatnonzero(later)
        rows = np.concatenate([chosen, gone])
        yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in (file, o, d, start, n, anchor)), pa.array(np.arange(len(rows)) < len(chosen))], names=[*PLACE, "_anchor", "_sort"])


class Beside:
    """Rows of a table written by _beside, read by the task that holds the texts of a file."""

    def __init__(self, path: str):
        self.path, self.file, self.rows, self.at = path, None, None, {}

    def of(self, file: int, o: int, d: int) -> pa.Table | None:
        if file != self.file:
            system, path = fs.FileSystem.from_uri(f"{self.path}/_file={file}")
            self.file, self.at, self.rows = file, {}, None
            if system.get_file_info(path).type != fs.FileType.NotFound:
                parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
                self.rows = pa.concat_tables([pq.ParquetFile(system.open_input_file(p)).read() for p in parts]).sort_by([("_o", "ascending"), ("_d", "ascending"), ("_start", "ascending")])
                ids = [self.rows.column(c).to_numpy() for c in ("_o", "_d")]
                heads = np.flatnonzero(_changes(*ids))
                for low, high in zip(heads.tolist(), np.append(heads, self.rows.num_rows)[1:].tolist(), strict=True):
                    self.at[int(ids[0][low]), int(ids[1][low])] = low, high
        low, high = self.at.get((o, d), (0, 0))
        return self.rows.slice(low, high - low) if high else None


def _beside(df: DataFrame, name: str) -> str:
    """Write df by the files of the texts it is about; the path, for Beside."""
    path = new_path(df.sparkSession, name)
    df.repartition("_file").write.partitionBy("_file").option("compression", "zstd").parquet(path)
    return path


def _cut(path: str, length: int):
    """The pieces that the table at path asks for, with their bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        asked = Beside(path)
        for batch in batches:
            raw, tables, text = [], [], []
            for file, o, d, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if (rows := asked.of(file, o, d)) is not None:
                    text += [len(raw)] * rows.num_rows
                    raw.append(data.as_py())
                    tables.append(rows.append_column("_file", pa.array(np.full(rows.num_rows, file, np.int32))))
            if tables:
                found = pa.concat_tables(tables).combine_chunks()
                start, n = (found.column(c).to_numpy() for c in ("_start", "_n"))
                place = [found.column(c).combine_chunks() for c in ("_anchor", "_file", "_o", "_d", "_start")]
                yield from _with_pieces(place, n, raw, np.array(text), start, length)

    return run


def removable(texts: DataFrame, length: int = 100) -> str:
    """The path of (_file, _o, _d, _start, _n): the _n neighbouring starts from byte _start on whose `length` bytes also start earlier.

    texts: (_file, _o, _d, _text), as drop_repeated makes them. They stay where they are; what is found is brought to them by _file.
    """
    schema = f"{PLACED}, _anchor long"
    # equal pieces of one batch are dealt anywhere, so a piece that very many texts hold makes no large deal
    found = texts.where(F.octet_length("_text") >= length).mapInArrow(tidy(_dealt(length)), f"{schema}, _digest long, _later boolean")
    by = F.when(F.col("_later"), F.xxhash64("_o", "_d", "_start")).otherwise(F.col("_anchor"))
    found = found.select("_anchor", "_digest", *PLACE, "_later").repartition(by).sortWithinPartitions("_anchor", "_digest", "_o", "_d", "_start")
    found = written(found.mapInArrow(tidy(_firsts), f"{schema}, _sort boolean"), "firsts")
    out, asked = [found.where("NOT _sort").select(*PLACE)], found.where("_sort").drop("_sort")
    hot = written(asked.groupBy("_anchor").agg(F.sum(F.col("_n") + length).alias("_bytes")).where(F.col("_bytes") > HOT).select("_anchor"), "hot")
    some = not hot.isEmpty()
    piece = f"_anchor long, {PLACED}, _piece binary"
    cold = texts.mapInArrow(tidy(_cut(_beside(asked.join(hot, "_anchor", "left_anti") if some else asked, "asked"), length)), piece)
    out.append(cold.repartition("_anchor").sortWithinPartitions("_anchor").mapInArrow(tidy(_sorted(length)), PLACED))
    held, seed = texts.mapInArrow(tidy(_cut(_beside(asked.join(hot, "_anchor"), "asked-hot"), length)), piece) if some else None, 1
    while held is not None:
        held = written(held.mapInArrow(tidy(_again(length, seed)), piece).withColumn("_digest", F.xxhash64("_piece")), "pieces")
        place = F.struct("_o", "_d", "_start")
        first = written(held.groupBy("_anchor", "_digest").agg(F.min(place).alias("_first"), F.max("_n").alias("_size")), "first")
        keyed = held.join(first.drop("_size"), ["_anchor", "_digest"])
        out.append(keyed.where(place != F.col("_first")).select(*PLACE))
        own = keyed.where(place == F.col("_first")).select("_anchor", *PLACE, "_piece")
        hot = first.groupBy("_anchor").agg(F.sum(F.col("_size") + length).alias("_bytes")).where(F.col("_bytes") > HOT).select("_anchor")
        hot = written(hot if seed < ROUNDS else hot.limit(0), "hot")
        if hot.isEmpty():
            held = None
        else:
            held = own.join(hot, "_anchor")
            own = own.join(hot, "_anchor", "left_anti")
        out.append(own.repartition("_anchor").sortWithinPartitions("_anchor").mapInArrow(tidy(_sorted(length)), PLACED))
        seed += 1
    spans = out[0]
    for o in out[1:]:
        spans = spans.unionByName(o)
    return _beside(spans, "repeated")


def _with_pieces(place: list[pa.Array], n: np.ndarray, raw: list[bytes], text: np.ndarray, start: np.ndarray, length: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of (anchor, file, o, d, start), n and bytes, cut from raw[text] at start, in batches of about `most` bytes."""
    bounds = np.flatnonzero(np.diff(np.cumsum(n + length) // most, prepend=-1, append=-1))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        cuts = zip(text[low:high].tolist(), start[low:high].tolist(), n[low:high].tolist(), strict=True)
        data = pa.array([raw[t][s : s + m + length - 1] for t, s, m in cuts], pa.binary())
        yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in place), pa.array(n[low:high]), data], names=["_anchor", *PLACE, "_piece"])


def _again(length: int, seed: int):
    """Deal pieces anew by the anchors of another hash."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("_piece").to_pylist()
            ends = np.cumsum([len(r) for r in raw])
            text, start, n, anchor = pieces(np.frombuffer(b"".join(raw), np.uint8), ends, length, seed)
            start = start - np.append(0, ends)[text]
            old, file, o, d, at = (batch.column(c).take(pa.array(text)) for c in ("_anchor", "_file", "_o", "_d", "_start"))
            anchor = mix(anchor ^ mix(old.to_numpy().view(np.uint64))).view(np.int64)
            yield from _with_pieces([pa.array(anchor), file, o, d, pa.array(at.to_numpy() + start)], n, raw, text, start, length)

    return run


def _sorted(length: int):
    """Suffix arrays over whole deals, as many as fit into one."""

    def order(table: pa.Table) -> pa.RecordBatch:
        file, o, d, start = (table.column(c).to_numpy() for c in PLACE[:4])
        by = np.lexsort((start, d, o))
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(_changes(o[by], d[by], start[by]))
        text, low, n = repeated(table.column("_piece").to_pylist(), place, length)
        return pa.RecordBatch.from_arrays(list(map(pa.array, (file[text], o[text], d[text], start[text] + low, n))), names=PLACE)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in aligned(batches, 1):
            anchor, weight = table.column("_anchor").to_numpy(), np.append(0, np.cumsum(table.column("_n").to_numpy() + length))
            bounds, low = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor)).tolist(), 0
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                more = int(weight[last] - weight[first])
                if size and size + more > MOST:
                    yield order(pa.concat_tables([*held, table.slice(low, first - low)]))
                    held, size, low = [], 0, first
                size += more
            held.append(table.slice(low))
        if held:
            yield order(pa.concat_tables(held))

    return run


def drop_repeated(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _n_bytes, _spans (array of start, length: the bytes removed) and _kept (the bytes left, joined).

    Removed is each byte that a string of `length` bytes covers which also starts earlier: in a text with a smaller
    id, or in the same text before. Texts are their UTF-8 bytes; a null text is empty; no string goes on into the next
    text, and a cut may fall inside a character. A null id is smaller than all others. Different texts of one id
    follow each other in a fixed order; rows that repeat id and text are one text and get the same result. Ids must
    be whole numbers. Columns of docs stay; where one is named as ours, ours gets a longer name.
    """
    whole_numbers(docs, id_col)
    names = [fresh(docs, c) for c in ("_n_bytes", "_spans", "_kept")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_o"), F.xxhash64(text).alias("_d"), F.struct("*").alias("_row")).withColumn("_file", F.spark_partition_id())
    kept = written(kept, "texts", "zstd")
    own = F.coalesce(F.col("_row").getField(text_col), F.lit("")).cast("binary").alias("_text")
    spans = removable(kept.select("_file", "_o", "_d", own), length)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def strike(batches) -> Iterator[pa.RecordBatch]:
        beside = Beside(spans)
        for batch in batches:
            sizes, cuts, left = [], [], []
            for file, o, d, value in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                data, cover = value.as_py(), beside.of(file, o, d)
                removed: list[dict] = []
                if cover is not None:
                    start, n = (cover.column(c).to_numpy() for c in ("_start", "_n"))
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                    removed = [{"start": a, "length": b - a} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                sizes.append(len(data))
                cuts.append(removed)
                bounds = [0, *(x for r in removed for x in (r["start"], r["start"] + r["length"])), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(bounds[0::2], bounds[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(left, pa.binary())], names=["_row", "_n", "_cuts", "_left"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("_n", T.LongType()), T.StructField("_cuts", span), T.StructField("_left", T.BinaryType())])
    done = kept.select("_file", "_o", "_d", own, "_row").mapInArrow(tidy(strike), schema)
    return done.select("_row.*", *(F.col(a).alias(b) for a, b in zip(("_n", "_cuts", "_left"), names, strict=True)))
