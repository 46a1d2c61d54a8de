import random

from lexgraph.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
STEMS = {"aa": "ka ro mi ta shi no wa", "bb": "sch ung keit ver zu au", "cc": "tion ing ough the and"}


def rows(n=600):
    rng, out = random.Random(2), []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        stems = STEMS[lang].split()
        out.append((i, " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))), lang, "x", "x"))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, "karomi tashi", "aa"), (1003, "Съешь же ещё этих мягких французских булок да выпей чаю" * 4, None), (1004, "zu " * 200_000, "bb"), (3, "karo", None)]
    data = rows() + [(*r, "x", "x") for r in odd]
    got = langid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    truth = {r[0]: r[2] for r in rows()}
    out = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert by[1003].rejected and by[1003].lang_pred in STEMS and by[1004].lang_pred == "bb" and by[None].lang_pred == "aa" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got if r.doc_id in truth) == 0


def test_unknown_languages_are_rejected_at_all_lengths(spark):
    rng, data = random.Random(4), rows()
    alphabets = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "bdfjlpqvxyz")
    strange = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(4, 9))) for _ in range(n)) for a in alphabets for n in (3, 10, 30, 300, 3000, 20_000)]
    long = [" ".join(t for _, t, g, *_ in data if g == lang) for lang in STEMS]
    asked = [(5000 + k, t, None, "x", "x") for k, t in enumerate(strange + long)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data + asked, SCHEMA)).collect()}
    assert [got[5000 + k].rejected for k in range(len(asked))] == [True] * len(strange) + [False] * len(long)
    assert sum(got[r[0]].rejected for r in data) == 0


def test_every_label_is_learned(spark):
    rng, data = random.Random(6), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for lang in range(120):
        stems = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(8)]
        data += [(100 * lang + k, " ".join("".join(rng.choice(stems) for _ in range(2)) for _ in range(40)), f"l{lang}", "x", "x") for k in range(8)]
    data += [(20_000, data[0][1], "l0", "x", "x")] * 3000  # one document, often
    got = langid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    truth = {r[0]: r[2] for r in data}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.98 and len({r.lang_pred for r in got}) == 120


def test_unlearned_words_of_the_same_letters_are_rejected(spark):
    rng, data = random.Random(7), rows()
    other = "pel gri fum dax oll ivy bst uqu ept"
    strange = [(9000 + k, " ".join("".join(rng.choice(other.split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 300))), None, "x", "x") for k in range(100)]
    got = [r for r in langid.identify(spark.createDataFrame(data + strange, SCHEMA)).collect() if r.doc_id >= 9000]
    assert len(got) == 100 and sum(r.rejected for r in got) >= 95


def test_nothing_to_learn_from(spark):
    got = langid.identify(spark.createDataFrame([(1, "words", None, "", ""), (2, None, None, "", "")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, False)] * 2
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_labels_of_held_out_rows_are_not_used(spark):
    data = rows(300)
    base = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    import zlib

    swapped = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, a, b) for i, t, lang, a, b in data]
    assert base == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(swapped, SCHEMA)).collect()}
