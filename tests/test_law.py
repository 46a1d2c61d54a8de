import pytest
from lexgraph.operators import law, terms
from pyspark.sql import functions as F

TEXT = """머리글
제1장 총칙
제1조(목적) 이 법은 목적을 정한다.
제2조 (정의) 용어는 다음과 같다.
① 첫째 항은 제1조를 따른다.
1. 첫 호
가. 첫 목
이어진 글
② 둘째 항
제3조 삭제
제1절 세칙
제4조의2 벌칙
 1. 호만 있다
제2장
1. 조 밖의 글
"""


def nodes(spark, compat=False):
    return law.parse_laws(spark.createDataFrame([("A", TEXT), ("B", None)], "law string, text string"), compat=compat)


def test_tree(spark):
    rows = {(r.law, r.node_id): r for r in nodes(spark).collect()}
    got = [(k[1], r.parent_id, r.label, r.title, r.text, r.deleted) for k, r in sorted(rows.items()) if k[0] == "A"]
    assert got == [
        (0, None, "법률", "", "머리글", False), (2, 0, "장", "제1장 총칙", "", False), (3, 2, "조", "제1조 목적", "이 법은 목적을 정한다.", False), (4, 2, "조", "제2조 정의", "용어는 다음과 같다.", False),
        (5, 4, "항", "①", "첫째 항은 제1조를 따른다.", False), (6, 5, "호", "1", "첫 호", False), (7, 6, "목", "가", "첫 목\n이어진 글", False), (9, 4, "항", "②", "둘째 항", False), (10, 2, "조", "제3조", "", True),
        (11, 2, "절", "제1절 세칙", "", False), (12, 11, "조", "제4조의2", "벌칙", False), (13, 12, "호", "1", "호만 있다", False), (14, 0, "장", "제2장", "1. 조 밖의 글", False),
    ]
    assert [k for k in rows if k[0] == "B"] == [("B", 0)]
    assert all(r.label != "항" for r in nodes(spark, True).collect())


def test_articles_stop_two_levels_down(spark):
    got = {r.aid: r.text for r in law.collect_articles(nodes(spark)).collect()}
    assert got == {"A_제1조목적": "이 법은 목적을 정한다.", "A_제2조정의": "용어는 다음과 같다.\n첫째 항은 제1조를 따른다.\n첫 호\n둘째 항", "A_제3조": "", "A_제4조의2": "벌칙\n호만 있다"}
    merged = law.merge_articles(law.collect_articles(nodes(spark)))
    assert sorted(r.aid for r in merged.collect()) == ["A_제1조", "A_제2조", "A_제3조", "A_제4조의2"]
    assert sorted(r.aid for r in law.merge_articles(law.collect_articles(nodes(spark)), keep_sub=False).collect()) == ["A_제1조", "A_제2조", "A_제3조", "A_제4조"]


ARTICLES = [
    ("A_제1조", "제1조", "목적", "A", 1), ("A_제2조", "제2조", "제1조에 따른다. 이 법 제3조의2를 본다.", "A", 2), ("A_제3조의2", "제3조의2", "다만 「B」 제1조는 예외", "A", 3), ("B_제1조", "제1조", "없음", "B", 1),
    ("C_제9조", "제9조", "제1조에 따른다. 이 건은 B 제1조에서 정한다.", "C", 1), ("C_제7조", "제7조", "제9조의 벌금", "C", 2),
]


def edges(spark, compat=False):
    df = spark.createDataFrame(ARTICLES, "aid string, title string, text string, law string, ord int")
    return sorted(map(tuple, law.citation_edges(df, compat).collect()))


def test_citations(spark):
    assert edges(spark) == [
        ("A_제2조", "A_제1조", "적용"), ("A_제2조", "A_제3조의2", "적용"), ("A_제3조의2", "A_제1조", "예외"), ("A_제3조의2", "B_제1조", "예외"), ("C_제7조", "C_제9조", "벌칙"), ("C_제9조", "B_제1조", "적용"),
    ]
    assert ("A_제2조", "A_제3조의2", "적용") not in edges(spark, True)
    df = spark.createDataFrame(ARTICLES, "aid string, title string, text string, law string, ord int")
    assert ("C_제7조", "C_제9조", "벌칙") in {tuple(r) for r in law.citation_edges_by_id(df).collect()}


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (1, "a")], "query_id int, id string")
    by = lambda n: {r.id: r.hop for r in law.expand(e, seeds, n).collect()}
    assert by(0) == {"a": 0} and by(1) == {"a": 0, "b": 1} and by(2) == {"a": 0, "b": 1, "c": 2} and by(3)["d"] == 3


def test_ratio(spark):
    e = spark.createDataFrame([("a1", "a2"), ("a1", "b1"), ("a2", "a1"), ("b1", "b2")], "src string, dst string")
    n = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B")], "id string, law string")
    assert tuple(law.cross_law_ratio(e, n).first()) == (4, 1, 25.0)
    assert tuple(law.cross_law_ratio(e.limit(0), n).first()) == (0, 0, 0.0)


def test_split_and_keywords(spark):
    body = "이 조문의 본문은 서른 글자를 넘어야 하므로 조금 더 길게 쓴다. 끝."
    df = spark.createDataFrame([(f"머리 제1조 {body} 제 2 조 짧다",)], "t string")
    assert [tuple(x) for x in df.select(law.split_law_text("t").alias("a")).first().a] == [("제1조", body)]
    n = spark.createDataFrame([("개인정보 보호법", "제1조(약칭)"), ("X", "제2조")], "law string, title string")
    assert sorted(r[0] for r in law.law_keywords(n).collect()) == ["개인정보 보호법", "약칭"]


def test_terms(spark):
    text = "머리\n1.1\n 용어 하나\n정의는 이러하고 저러하다.\n\n12\n1.2\n용어-둘 -\n둘째 정의는 길게 쓴다 여기. 67\n1.3\n짧\n아\n"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    assert [(r.section, r.term, r.definition) for r in terms.terms_plain(df).orderBy("pos").collect()][0] == ("1.1", "용어 하나", "정의는 이러하고 저러하다.")
    assert [(r.section, r.term, r.definition) for r in terms.terms_tagged(df).orderBy("pos").collect()] == [("1.1", "용어 하나", "정의는 이러하고 저러하다."), ("1.2", "용어-둘", "둘째 정의는 길게 쓴다 여기.")]
    two = spark.createDataFrame([("f", "1.1\n데이터가\n흐르는 길\n정의는 이러하고 저러하다.\r\n2.10\n아주 길고 긴 용어의 이름을 (여기에) 쓴다\n그 정의는 이러하고 저러하다 (12)\n1.1\n데이터가\n흐르는 길\n또 하나의 정의가 여기 있다.")], "file string, text string")
    assert [(r.section, r.term, r.definition) for r in terms.terms_two_lines(two).orderBy("pos").collect()] == [("1.1", "데이터가 흐르는 길", "정의는 이러하고 저러하다."), ("2.10", "아주 길고 긴 용어의 이름을 (여기에) 쓴다", "그 정의는 이러하고 저러하다")]


def test_viz(spark):
    n, e = law.viz_tables(spark.createDataFrame([("i", "L", "T", "x" * 500)], "id string, law string, title string, text string"), spark.createDataFrame([("i", "j", "벌칙"), ("i", "j", "else")], "src string, dst string, relation string"))
    assert len(n.first().tooltip) == 400 and [r.colour for r in e.orderBy(F.desc("relation")).collect()] == ["red", "gray"]


def test_numbers_beyond_all_articles(spark):
    df = spark.createDataFrame([(1, "제1조부터 제99999999999조까지"), (2, "제1조부터 제9000000000조까지, 제3조부터 제99999999999999999999999조까지"), (3, "제12조부터 제0009조까지"), (4, "제1조부터 제10001조까지")], "id long, text string")
    got = {r.id: r.k for r in df.select("id", law.reference_keys("text").alias("k")).collect()}
    assert got[1] == ["1", "99999999999"] and "9000000000" in got[2] and "99999999999999999999999" in got[2] and len(got[2]) == 4
    assert {"9", "10", "11", "12"} <= set(got[3]) and len(got[4]) == 10_001


def test_long_texts_and_hot_numbers(spark):
    """A megabyte without punctuation before a citation, and an article number that every law has."""
    laws = [(f"법{k}", "제1조") for k in range(300)] + [("전자금융거래법", "제2조"), ("전자금융거래법", "제1조")]
    rows = [(f"{n}_{t}", t, "제1조를 따른다", n, 0) for n, t in laws] + [("long_제9조", "제9조", "가나다라 " * 200_000 + "전자금융거래법 제2조", "긴법", 0)]
    articles = spark.createDataFrame(rows, "aid string, title string, text string, law string, ord int")
    edges = {(r.src, r.dst) for r in law.citation_edges(articles).collect()}
    assert edges == {("long_제9조", "전자금융거래법_제2조"), ("전자금융거래법_제2조", "전자금융거래법_제1조")}


def test_trees_to_json_and_back(spark, tmp_path):
    """Any depth, texts with quotes and line breaks, several kinds of children under one node; faults are errors."""
    import json

    from lexgraph.operators import trees
    from lexgraph.sources import readers, writers

    nodes = law.parse_laws(spark.createDataFrame([("A", TEXT), ("B", None), ("C", '제1조 "따옴표" \\\\ 끝')], "law string, text string"))
    writers.trees(nodes, str(tmp_path / "t"))
    columns = ["law", "node_id", "parent_id", "label", "title", "text", "deleted"]
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert key(readers.trees(spark, str(tmp_path / "t"))) == key(nodes)
    whole = {r.law: json.loads(r.tree) for r in trees.nested(nodes).collect()}
    ids = lambda n: [n["node_id"], *(i for c in n["children"] for i in ids(c))]
    assert ids(whole["A"]) == sorted(ids(whole["A"])) and whole["B"]["children"] == []  # the order of the lines

    chain = [("t", k, k - 1 if k else None, k, f"n{k}") for k in range(12)]
    deep = spark.createDataFrame(chain, "law string, node_id int, parent_id int, level int, name string")
    back = trees.flat(trees.nested(deep, fields="name string"), fields="name string")
    assert sorted((r.node_id, r.parent_id, r.depth, r.name) for r in back.collect())[5] == (5, 4, 5, "n5") and back.count() == 12
    for bad in (("t", 20, 77, 3, "no parent"), ("t", 3, 2, 3, "twice"), ("t", 11, 10, 11, "a leaf twice"), ("t", 20, 5, 4, "above its parent")):
        with pytest.raises(Exception, match="node"):
            trees.nested(deep.union(spark.createDataFrame([bad], deep.schema)), fields="name string").collect()
    assert trees.nested(nodes.limit(0), levels=[0, 1]).count() == 0


def test_hubs_in_lists_and_many_queries(spark):
    """A hub with more neighbours than a list holds, more than 64 queries, against breadth-first search."""
    import random

    r = random.Random(3)
    links = [("hub", f"n{k}") for k in range(500)] + [(f"n{r.randrange(500)}", f"m{r.randrange(80)}") for _ in range(120)]
    seeds = [(q, r.choice(["hub", "none", f"n{r.randrange(500)}", f"m{r.randrange(80)}"])) for q in range(150) for _ in range(2)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for q in range(150):
        front = seen = {i for s, i in seeds if s == q}
        want |= {(q, i, 0) for i in front}
        for hop in (1, 2, 3):
            front = {b for a in front for b in near.get(a, ())} - seen
            seen = seen | front
            want |= {(q, i, hop) for i in front}
    got = law.expand(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([*seeds, (None, "hub"), (7, None)], "query_id int, id string"), 3, size=16).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    lists, hubs = law.adjacency(spark.createDataFrame(links, "src string, dst string"), 16)
    assert max(len(x.near) for x in lists.collect()) < 48 and {x.a for x in hubs.collect()} >= {"hub"}
