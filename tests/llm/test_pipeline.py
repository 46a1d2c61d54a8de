"""The stages against plain versions, each on its own input."""

import random

import corpus_pipeline
from lexgraph.llm import packing
from tokenizers import Tokenizer

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as classes
from .test_jaccard import grams
from .test_line_dedup import brute as deduped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, text_crc32 long"
STEMS = {"aa": "ka ro mi ta shi no wa", "bb": "sch ung keit ver zu au"}


def documents():
    rng, rows = random.Random(4), []

    def sentence(lang, n):
        return " ".join("".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))

    for i in range(240):
        lang = rng.choice(list(STEMS))
        rows.append((i, "menu home about\n" * (i % 3 == 0) + sentence(lang, rng.randint(20, 120)) + "\n" + sentence(lang, 30), lang, f"s{i % 2}", 0, "x", 1))
    rows += [(300 + k, rows[k][1], *rows[k][2:]) for k in range(12)]  # exact copies
    rows += [(320 + k, rows[k][1] + " zu", *rows[k][2:]) for k in range(20, 32)]  # near copies
    rows += [(340 + k, sentence("aa", 30) + " " + BENCH[k % 3][1] + " ka", "aa", "s1", 0, "x", 1) for k in range(12)]
    rows += [(400, None, "aa", "s0", 0, "x", 1), (401, "", "bb", None, 0, "x", 1), (402, "123 456", "aa", "s1", 0, "x", 1), (None, rows[5][1], "aa", "s1", 0, "x", 1), (7, rows[7][1], *rows[7][2:])]
    return [(*r[:4], len(r[1] or ""), *r[5:]) for r in rows]


BENCH = [(1, "the first benchmark question has more than ten words in it for sure"), (2, "second question of the benchmark that nobody should train on at all ever"), (3, "short item here")]


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, left = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        left = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept[name] = [tuple(r) for r in left.collect()]
        if k < 4:
            assert left.columns == docs.columns, name

    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(kept["language_id"], key=repr) == sorted(want, key=repr)
    want = [(*r[:4], len(r[1]), *r[5:7]) for r in deduped(kept["language_id"], 0.1, 2)]
    assert sorted(kept["line_dedup"], key=repr) == sorted(want, key=repr) and all("menu" not in r[1] for r in want)
    found = kept["jaccard_join"]
    groups = {low for _, low, _, _ in classes([r for r in kept["line_dedup"] if grams(r[1])])}
    assert sorted((r[0] for r in found if grams(r[1])), key=repr) == sorted(groups, key=repr) and set(found) <= set(kept["line_dedup"])
    bad = {r[0] for r in contaminated(found, BENCH) if r[5]}
    assert bad and sorted(kept["decontamination"], key=repr) == sorted((r for r in found if r[0] not in bad), key=repr)

    tool = Tokenizer.from_file(packing.default_tokenizer())
    sizes = {r[0]: len(tool.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in kept["decontamination"]}
    pieces = [r.asDict() for r in left.collect()]
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == sizes and sum(p["length"] for p in pieces) == sum(sizes.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (r.asDict() for r in again))) == sorted(map(repr, pieces))
