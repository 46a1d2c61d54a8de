"""Packing tokenised documents into sequences of a fixed length by minimum bin slack.

A document is cut into full windows and one rest. Full windows are sequences by themselves. The rests of a
bucket of documents are packed window by window: the longest rest left opens the window, and a subset-sum
over the multiset of remaining lengths, run on the bits of one integer per length, finds the multiset that
fills the window closest to its capacity; it is traced back to counts per length and taken as often as the
counts allow. Rests are never cut, so the digest of a piece can be taken where its text is tokenised and no
token is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, whole_numbers

#: The pattern by which byte-level BPE of this family splits a text (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE files write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A function from text to a uint32 array of ids, from a `tokenizers` file.

    Strings of special tokens in a text are ordinary text, and none is added. A plain byte-level BPE file whose
    ids follow its merges is run by tiktoken, which gives the same ids several times faster; any other file by
    tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not (spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"))
    if plain:
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges))
    if plain:
        import tiktoken

        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy, {"disallowed_special": ()}
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return lambda text: np.array(tool.encode(text, add_special_tokens=False).ids, np.uint32), {}


def tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """A row per document: _id, _n (ids with end_id), _crcs (CRC-32 of each window-long cut) and, if asked, _ids (their bytes)."""

    def run(batches):
        encode, how = load_encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, crcs, kept = [], [], []
                for text in part.column(1):
                    ids = np.concatenate([encode(text.as_py() or "", **how), end]).astype("<u4", copy=False)
                    counts.append(len(ids))
                    crcs.append([zlib.crc32(ids[k : k + window]) for k in range(0, len(ids), window)])
                    if with_ids:
                        kept.append(ids.tobytes())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))] + ([pa.array(kept, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_n", "_crcs", "_ids"][: len(columns)])

    schema = "_id long, _n long, _crcs array<long>" + (", _ids binary" if with_ids else "")
    whole_numbers(docs, id_col)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length, at most as given, whose total is the closest to capacity from below.

    Bit s of reach[k] says that the first k lengths can total s. The search ends at the first length with which
    the capacity is met.
    """
    sizes = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    mask, reach, used = (1 << (capacity + 1)) - 1, [1], []
    for n in sizes:
        now, left, step = reach[-1], min(counts[n], capacity // n), 1
        while left:  # powers of two and a rest stand for all counts
            k = min(step, left)
            now |= (now << (n * k)) & mask
            left, step = left - k, step * 2
        reach.append(now)
        used.append(n)
        if now >> capacity & 1:
            break
    total, taken = reach[-1].bit_length() - 1, {}
    for k in range(len(used), 0, -1):
        n = used[k - 1]
        while not reach[k - 1] >> total & 1:
            taken[n] = taken.get(n, 0) + 1
            total -= n
    return taken


def bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places in lengths (each from 1 to capacity), bin by bin."""
    waiting: dict[int, list[int]] = {}
    for k in reversed(range(len(lengths))):
        waiting.setdefault(lengths[k], []).append(k)
    counts, out = {n: len(p) for n, p in waiting.items()}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        take = fill(counts, capacity - first)
        take[first] = take.get(first, 0) + 1
        counts[first] += 1
        for _ in range(min(counts[n] // k for n, k in take.items())):
            out.append([waiting[n].pop() for n, k in sorted(take.items(), reverse=True) for _ in range(k)])
            for n, k in take.items():
                counts[n] -= k
        counts = {n: c for n, c in counts.items() if c}
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = 8192, with_ids: bool = False) -> DataFrame:
    """Return a row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, input_ids.

    A null or empty text is the end id alone. Null and repeated ids are kept, every row being its own document;
    other columns are ignored, and an empty table gives no rows. Documents are dealt to buckets of about
    bucket_docs by a hash of their ids, tokens and places in the table as it is read, so that repeated rows are
    spread; each bucket leaves one sequence that is far from full at most.
    sequence_id is the bucket shifted by 32 bits plus a running number.
    """
    n = max(1, -(-docs.count() // bucket_docs))
    rows = tokenised(docs, tokenizer, window, end_id, id_col, text_col, with_ids)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_n", "_crcs", F.monotonically_increasing_id()), F.lit(n)))
    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", input_ids array<int>" if with_ids else "")

    def deal(key, rows):
        rows = rows.sort_values(["_n", "_id"], kind="stable", na_position="first")
        rows = rows.assign(_key=[tuple(c) for c in rows["_crcs"]]).sort_values(["_n", "_id", "_key"], kind="stable", na_position="first").reset_index(drop=True)
        base, out = int(key[0]) << 32, []
        full, rest = (rows["_n"] // window).to_numpy(), (rows["_n"] % window).to_numpy()
        ids, totals, crcs = rows["_id"].tolist(), rows["_n"].tolist(), rows["_crcs"].tolist()
        for d in np.flatnonzero(full):
            for k in range(full[d]):
                out.append((d, k * window, window, crcs[d][k], base, 0))
                base += 1
        tails = np.flatnonzero(rest)
        for places in bins(rest[tails].tolist(), window):
            at = 0
            for p in places:
                d = tails[p]
                out.append((d, int(full[d]) * window, int(rest[d]), crcs[d][full[d]], base, at))
                at += int(rest[d])
            base += 1
        made = {"_id": pd.array([ids[o[0]] for o in out], "Int64"), "start": [o[1] for o in out], "length": [o[2] for o in out], "ids_crc32": [o[3] for o in out]}
        made |= {"doc_tokens": [totals[o[0]] for o in out], "sequence_id": [o[4] for o in out], "offset": [o[5] for o in out]}
        if with_ids:
            blobs = rows["_ids"].tolist()
            made["input_ids"] = [np.frombuffer(blobs[o[0]], "<u4")[o[1] : o[1] + o[2]].astype(np.int32) for o in out]
        return pd.DataFrame(made)

    return rows.groupBy("_bucket").applyInPandas(deal, schema).withColumnRenamed("_id", id_col)


def default_tokenizer() -> str:
    """The public tokenizer file that the queries use."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))
