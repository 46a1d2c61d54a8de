import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexgraph.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, bucket string, offset string"


@pytest.fixture(scope="module")
def path():
    return packing.default_tokenizer()


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_encoder_gives_the_ids_of_tokenizers(text):
    path = packing.default_tokenizer()
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    encode, how = _loaded(path)
    text = text.encode("utf-8", "ignore").decode()
    assert encode(text, **how).tolist() == tool.encode(text, add_special_tokens=False).ids


_kept = {}


def _loaded(path):
    if path not in _kept:
        _kept[path] = packing.load_encoder(path)
    return _kept[path]


def test_special_strings_are_ordinary_text(path):
    encode, how = _loaded(path)
    assert 50256 not in encode("a <|endoftext|> b", **how).tolist()


def brute(counts, capacity):
    best = {0}
    for n, c in counts.items():
        best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= capacity}
    return max(best)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_closest_multiset(counts, capacity):
    take = packing.fill(counts, capacity)
    assert all(0 < k <= counts[n] for n, k in take.items())
    assert sum(n * k for n, k in take.items()) == brute(counts, capacity)


def test_bins_hold_each_length_once_and_leave_little():
    rng = random.Random(3)
    lengths = [rng.randint(1, 2047) for _ in range(3000)]
    out = packing.bins(lengths, 2048)
    assert sorted(p for b in out for p in b) == list(range(3000))
    assert all(sum(lengths[p] for p in b) <= 2048 for b in out)
    assert len(out) <= 1.01 * sum(lengths) / 2048 + 1


def test_round_trip(spark, path):
    tool = Tokenizer.from_file(path)
    texts = ["", None, "One two.", "One two.", "x " * 5000, "ünïcode  \n\n text " * 700, "a"]
    rows = [(i if i < 6 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(2, "One two.", "clash", "clash")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), path, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    docs = {}
    for r in got:
        assert zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) == r.ids_crc32
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for i, t, *_ in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(docs) == set(want)
    for key, pieces in docs.items():
        copies = len(want[key])
        pieces.sort(key=lambda r: r.start)
        assert sum(r.length for r in pieces) == key[1] * copies
        assert [x for r in pieces[::copies] for x in r.input_ids] == want[key][0]


def test_empty_table(spark, path):
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []
