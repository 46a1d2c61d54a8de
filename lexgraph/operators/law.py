"""Law texts: lines to a flat node table, articles, references, the citation graph and its neighbourhoods.

A law is a document; windows over its lines give each line the headings that are open above it. All joins are
on keys, and the node table replaces the recursive tree: parent ids rebuild it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.predicates import holds_any, relation
from ..functions.text import _text, let, normalize, normalize_lines, strip, sub
from ..storage import written

HEAD = r"제\s*[0-9]+\s*조(?:\s*의\s*[0-9]+)?"
CHAPTER, SECTION = r"(?U)^\s*(제\s*[0-9]+\s*장)\s*(.+)?\s*$", r"(?U)^\s*(제\s*[0-9]+\s*절)\s*(.+)?\s*$"
ARTICLE = rf"(?U)^\s*({HEAD})\s*(\([^)]+\))?\s*(.*)$"
DELETED = rf"(?U)^\s*{HEAD}\s*삭제\s*$"
PARAGRAPH, ITEM, SUBITEM = r"(?U)^\s*([①-⑳]+)\s*(.*)$", r"(?U)^\s*([0-9]+)\.\s+(.*)$", r"(?U)^\s*([가-힣])\.\s+(.*)$"
LEVELS = {"법률": 0, "장": 1, "절": 2, "조": 3, "항": 4, "호": 5, "목": 6}


def parse_laws(laws: DataFrame, law_col: str = "law", text_col: str = "text", compat: bool = False) -> DataFrame:
    """Return nodes (law, node_id, parent_id, level, label, title, text, deleted, article_id, depth).

    node_id is the number of the line among those not blank (0 for the law itself), which is also the order of
    the tree; depth counts from the article. compat: circled numbers are normalised away first, so that no
    paragraph is ever seen.
    """
    lines = laws.select(F.col(law_col).alias("law"), F.split(normalize_lines(text_col, compat), "\n").alias("_l"))
    lines = lines.select("law", F.posexplode(F.filter("_l", lambda x: strip(x) != "")).alias("_at", "line")).withColumn("n", F.col("_at") + 1)
    line = F.col("line")
    outer = F.when(line.rlike(DELETED), "삭제").when(line.rlike(CHAPTER), "장").when(line.rlike(SECTION), "절").when(line.rlike(ARTICLE), "조")
    before = Window.partitionBy("law").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("law").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda cond, w: F.max(F.when(cond, F.col("n"))).over(w)  # noqa: E731  line numbers only grow
    lines = lines.withColumn("_outer", outer)
    open_article = last(F.col("_outer").isin("조", "삭제"), before) > F.coalesce(last(F.col("_outer").isin("장", "절"), before), F.lit(0))
    inner = F.when(~F.coalesce(open_article, F.lit(False)), F.lit(None)).when(line.rlike(PARAGRAPH), "항").when(line.rlike(ITEM), "호").when(line.rlike(SUBITEM), "목")
    lines = lines.withColumn("kind", F.coalesce("_outer", inner))

    for name, kinds in (("ch", ["장"]), ("sec", ["절"]), ("art", ["조", "삭제"]), ("par", ["항"]), ("item", ["호"]), ("sub", ["목"])):
        lines = lines.withColumn(f"_{name}", last(F.col("kind").isin(kinds), upto))
    after = lambda c, *others: F.when(F.col(c) > F.coalesce(F.greatest(*(F.col(o) for o in others), F.lit(0)), F.lit(0)), F.col(c))
    lines = lines.select(
        "law", "n", "line", "kind", F.col("_ch").alias("ch"), after("_sec", "_ch").alias("sec"), after("_art", "_ch", "_sec").alias("art"), after("_par", "_art", "_ch", "_sec").alias("par"),
        after("_item", "_par", "_art", "_ch", "_sec").alias("item"), after("_sub", "_item", "_par", "_art", "_ch", "_sec").alias("sub"),
    )
    kind = F.col("kind")
    top = F.coalesce("sec", "ch", F.lit(0))
    parent = F.when(kind == "장", F.lit(0)).when(kind == "절", F.coalesce("ch", F.lit(0))).when(kind.isin("조", "삭제"), top).when(kind == "항", F.col("art"))
    parent = parent.when(kind == "호", F.coalesce("par", "art")).when(kind == "목", F.coalesce("item", "par", "art"))
    in_item = F.when(F.col("item").isNull(), F.when(F.col("par").isNotNull(), 2).otherwise(1)).otherwise(F.when(F.col("par").isNotNull(), 3).otherwise(2))
    depth = F.when(kind.isin("조", "삭제"), 0).when(kind == "항", 1).when(kind == "호", F.when(F.col("par").isNotNull(), 2).otherwise(1)).when(kind == "목", in_item)
    target = F.when(kind.isNotNull(), F.col("n")).otherwise(F.coalesce("sub", "item", "par", "art", "sec", "ch", F.lit(0)))
    part = lambda p, k: F.regexp_extract("line", p, k)
    heading = lambda p: strip(F.concat(part(p, 1), F.lit(" "), part(p, 2)))
    article_title = strip(part(ARTICLE, 2), " ()")
    title = F.when(kind == "장", heading(CHAPTER)).when(kind == "절", heading(SECTION)).when(kind == "삭제", F.regexp_extract("line", f"(?U)({HEAD})", 1))
    title = title.when(kind == "조", F.concat(part(ARTICLE, 1), F.when(article_title == "", "").otherwise(F.concat(F.lit(" "), article_title))))
    title = title.when(kind == "항", part(PARAGRAPH, 1)).when(kind == "호", part(ITEM, 1)).when(kind == "목", part(SUBITEM, 1))
    body = F.when(kind.isNull(), line).when(kind == "조", strip(part(ARTICLE, 3))).when(kind == "항", part(PARAGRAPH, 2)).when(kind == "호", part(ITEM, 2)).when(kind == "목", part(SUBITEM, 2)).otherwise("")
    lines = lines.select("law", "n", "kind", parent.alias("parent"), depth.alias("depth"), target.alias("node_id"), title.alias("title"), body.alias("body"), "art")
    roots = laws.select(F.col(law_col).alias("law"), F.lit(0).alias("n"), F.lit("법률").alias("kind"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("int").alias("depth"), F.lit(0).alias("node_id"), F.lit("").alias("title"), F.lit("").alias("body"), F.lit(None).cast("int").alias("art"))
    head = lambda c: F.max(F.when(F.col("kind").isNotNull(), F.col(c)))  # noqa: E731  one such line a node
    texts = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"] != ""), lambda x: x["body"]), "\n")
    nodes = lines.unionByName(roots).groupBy("law", "node_id").agg(head("parent").alias("parent_id"), head("kind").alias("kind"), head("title").alias("title"), head("depth").alias("depth"), head("art").alias("article_id"), texts.alias("text"))
    label = F.when(F.col("kind") == "삭제", "조").otherwise(F.col("kind"))
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), label)
    return nodes.select("law", "node_id", "parent_id", level.alias("level"), label.alias("label"), "title", "text", (F.col("kind") == "삭제").alias("deleted"), "article_id", "depth")


def collect_articles(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """(aid, title, text, law, ord): articles with the texts down to `depth` levels below, blank ones left out."""
    inside = nodes.where(F.col("article_id").isNotNull() & (F.col("depth") <= depth))
    texts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: strip(x["text"]) != ""), lambda x: x["text"])
    merged = inside.groupBy("law", "article_id").agg(F.max(F.when(F.col("node_id") == F.col("article_id"), F.col("title"))).alias("title"), F.array_join(texts, "\n").alias("text"))
    return merged.select(F.concat("law", F.lit("_"), F.replace("title", F.lit(" "), F.lit(""))).alias("aid"), "title", "text", "law", F.col("article_id").alias("ord"))


def base_title(c: Column, keep_sub: bool = True) -> Column:
    """제n조, with 의m if it is to be kept; the title itself where it has no article number."""
    t = F.regexp_extract(c, f"(?U)({HEAD})" if keep_sub else r"(?U)(제\s*[0-9]+\s*조)", 1)
    return F.when(t == "", strip(c)).otherwise(sub(t, r"(?U)\s+"))


def merge_articles(articles: DataFrame, keep_sub: bool = True) -> DataFrame:
    """Articles of one law and number as one, texts joined in order."""
    rows = articles.withColumn("_base", base_title(F.col("title"), keep_sub))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    merged = rows.groupBy("law", "_base").agg(F.array_join(texts, "\n").alias("text"), F.min("ord").alias("ord"))
    return merged.select(F.concat("law", F.lit("_"), F.col("_base")).alias("aid"), F.col("_base").alias("title"), "text", "law", "ord")


def split_articles(c: Column | str) -> Column:
    """(title, body) of the articles of a text as one normalised line; what comes before the first is left out."""
    parts = F.split(normalize(c), rf"(?U)(?={HEAD})")
    parts = F.filter(parts, lambda p: p.rlike(f"(?U)^{HEAD}"))
    return F.transform(parts, lambda p: F.struct(strip(F.regexp_extract(p, f"(?U)^({HEAD})", 1)).alias("title"), strip(F.regexp_replace(p, f"(?U)^{HEAD}", "")).alias("body")))


def split_law_text(c: Column | str, least: int = 30) -> Column:
    """(article, body) where the body has `least` characters or more; empty lines are kept to one."""
    parts = F.filter(F.split(_text(c), r"(?U)(?=제\s*[0-9]+\s*조)"), lambda p: strip(p).rlike(r"(?U)^제\s*[0-9]+\s*조"))
    head = r"(?Us)^\s*(제\s*[0-9]+\s*조)\s*(.*)"
    pairs = F.transform(parts, lambda p: F.struct(sub(F.regexp_extract(p, head, 1), r"(?U)\s+").alias("article"), sub(strip(F.regexp_extract(p, head, 2)), r"\n{3,}", "\n\n").alias("body")))
    return F.filter(pairs, lambda x: F.length(x["body"]) >= least)


def ref_key(number: Column, sub_number: Column) -> Column:
    return F.concat(number, F.when(F.coalesce(sub_number, F.lit("")) == "", "").otherwise(F.concat(F.lit("의"), sub_number)))


#: Articles between the ends of a cited range that are spelled out; of a longer one, which no law has, the ends count alone.
LONGEST_RANGE = 10_000


def _upto_last(t: Column, after: str) -> Column:
    """t up to its last 조 and what may follow it: every citation ends there, so the rest, often most of a text, need not be searched."""
    rest = F.substring_index(t, "조", -1)
    return F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(rest)), F.regexp_extract(rest, after, 0))


def reference_keys(c: Column | str) -> Column:
    """Sorted distinct keys ('5', '5의2') of the articles a text cites, of whatever law; ranges, also reversed ones, are spelled out.

    A range over more than LONGEST_RANGE articles, or with a number that is no long, stands for its two ends.
    """
    single = r"(?:제 ?)?([0-9]+) ?조(?: ?의 ?([0-9]+))?(?: ?제 ?[0-9]+ ?항)?"
    ranged = r"(?:제 ?)?([0-9]+) ?조 ?(?:부터|이상) ?(?:제 ?)?([0-9]+) ?조 ?(?:까지|이하)"

    def spelled(a: Column, b: Column) -> Column:
        low, high = F.least(a.try_cast("long"), b.try_cast("long")), F.greatest(a.try_cast("long"), b.try_cast("long"))
        short = a.try_cast("long").isNotNull() & b.try_cast("long").isNotNull() & (high - low <= LONGEST_RANGE)
        plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.when(short, F.transform(F.sequence(low, F.when(short, high).otherwise(low)), lambda k: k.cast("string"))).otherwise(F.array(plain(a), plain(b)))

    def found(t: Column) -> Column:
        pairs = lambda p, f: F.zip_with(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.regexp_extract_all(t, F.lit(p), F.lit(2)), f)
        return F.array_sort(F.array_distinct(F.concat(pairs(single, ref_key), F.flatten(pairs(ranged, spelled)))))

    # normalised once; has single spaces only
    return let(let(normalize(c), lambda t: _upto_last(t, "^ ?(?:의 ?[0-9]+|까지|이하)?")), found)


def article_id(title: Column, prefix: Column) -> Column:
    t = normalize(title)
    number = F.regexp_extract(t, r"(?U)제\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?", 1)
    return F.concat(prefix, F.lit("_"), F.when(number == "", "unknown").otherwise(ref_key(number, F.regexp_extract(t, r"(?U)제\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?", 2))))


def article_key(title: Column) -> Column:
    found = F.regexp_extract(title, rf"(?U)^\s*({HEAD})", 1)
    return F.replace(F.when(found == "", title).otherwise(found), F.lit(" "), F.lit(""))


def law_name(c: Column) -> Column:
    """Without blanks, en dashes as hyphens."""
    return F.replace(sub(_text(c), r"(?U)\s+"), F.lit("–"), F.lit("-"))


def cross_law_refs(c: Column | str, compat: bool = False) -> Column:
    """(law, article, same) of the citations that name a law; same: it is the citing law.

    The name is what stands before an article number, back to the last character that no name has, so the time is
    linear in the text. compat drops 의m.
    """
    t, number = _upto_last(_text(c), r"(?U)^(?:\s*의\s*[0-9]+)?"), r"(?U)제\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?"
    # split at what no name has; the part after the last such place is the name
    other = r"(?U)[^가-힣A-Za-z0-9()·\-\s]"

    def name(x: Column) -> Column:
        if not compat:
            x = F.regexp_replace(x, r"(?U)」?\s*$", "")
        last = strip(F.element_at(F.split(x, other), -1))
        return F.when(F.length(last) >= 2, last).otherwise("") if compat else last

    parts = F.split(t, number)
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), name)  # nothing is cited after the last one, often most of the text
    found = F.arrays_zip(before.alias("law"), F.regexp_extract_all(t, F.lit(number), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(number), F.lit(2)).alias("m"))
    found = F.filter(found, lambda x: x["n"].isNotNull() & (x["law"] != ""))
    rows = F.transform(found, lambda x: F.struct(x["law"].alias("law"), F.when(F.lit(compat), x["n"]).otherwise(ref_key(x["n"], x["m"])).alias("article")))
    ends = "(?:이|같은)\\s*법$"
    same = lambda law: law.rlike(f"(?U)^{ends}" if compat else f"(?U)(?:^|\\s){ends}")
    rows = F.filter(rows, lambda x: same(x["law"]) | ~holds_any(x["law"], fixed.NOT_A_LAW))
    return F.transform(rows, lambda x: F.struct(law_name(x["law"]).alias("law"), x["article"].alias("article"), same(x["law"]).alias("same")))


def node_key(article: Column, compat: bool = False) -> Column:
    """The title of the article that a key names; compat puts 의m before 조, where no title has it."""
    fixed_form = F.concat(F.lit("제"), F.regexp_extract(article, "^([0-9]+)", 1), F.lit("조"), F.regexp_extract(article, "(의[0-9]+)$", 1))
    return F.concat(F.lit("제"), article, F.lit("조")) if compat else fixed_form


def citation_edges(articles: DataFrame, compat: bool = False) -> DataFrame:
    """(src, dst, relation) between articles (aid, title, text, law), one edge a pair, none to itself.

    A citation that names a known law goes to that law's article. Any other, and again the named ones, go by
    number: to the only article of that number there is, or else to that of the citing law.
    """
    nodes = articles.select(F.col("aid").alias("dst"), F.col("law").alias("dst_law"), article_key(F.col("title")).alias("akey"), F.col("ord").alias("dst_ord") if "ord" in articles.columns else F.lit(0).alias("dst_ord"))
    laws = articles.select(F.col("law").alias("dst_law")).distinct().withColumn("name", law_name(F.col("dst_law")))
    read = articles.select("aid", "law", relation("text").alias("relation"), cross_law_refs("text", compat).alias("named"), reference_keys("text").alias("numbers"))
    read = written(read, "citations")  # the texts are searched once
    cites = read.select(F.col("aid").alias("src"), F.col("law").alias("src_law"), "relation", F.explode("named").alias("r"))
    cites = cites.select("src", "src_law", "relation", F.col("r.law").alias("cited"), F.col("r.same").alias("same"), node_key(F.col("r.article"), compat).alias("akey"))
    cites = cites.distinct()
    own = cites.where("same").withColumn("dst_law", F.col("src_law")).select("src", "relation", "akey", "dst_law")
    named = cites.where("NOT same")
    if compat:
        named = named.join(laws, named["cited"] == laws["name"]).select("src", "relation", "akey", "dst_law")
    else:  # the longest known law that the cited words end in; only ends as long as some law's name are looked up
        lengths = laws.agg(F.collect_set(F.length("name")).alias("_lengths"))  # as many as there are lengths of names
        n = F.length("cited")
        ends = F.transform(F.filter("_lengths", lambda k: (k <= n) & (k > 0)), lambda k: F.substring(F.col("cited"), n - k + 1, k))
        named = named.crossJoin(F.broadcast(lengths)).withColumn("name", F.explode(ends)).drop("_lengths").join(laws, "name")
        named = named.groupBy("src", "relation", "akey", "cited").agg(F.max_by("dst_law", F.struct(F.length("name"), "dst_law")).alias("dst_law")).select("src", "relation", "akey", "dst_law")
    explicit = own.union(named).join(nodes, ["akey", "dst_law"]).select("src", "dst", "relation")

    # every law has an article 1: a number is looked up with the citing law, or among those that one article has
    only = nodes.groupBy("akey").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("akey", "dst")
    simple = read.select(F.col("aid").alias("src"), F.col("law").alias("dst_law"), "relation", F.explode("numbers").alias("r"))
    simple = simple.select("src", "dst_law", "relation", node_key(F.col("r"), compat).alias("akey"))
    here, alone = simple.join(nodes, ["akey", "dst_law"]), simple.join(only, "akey")
    return explicit.union(here.select("src", "dst", "relation")).union(alone.select("src", "dst", "relation")).where("src <> dst").distinct()


def citation_edges_by_id(articles: DataFrame, compat: bool = False) -> DataFrame:
    """(src, dst, relation): each cited number goes to the first article, in order of law and place, whose id holds it and the citing law's name."""
    nodes = articles.select(F.col("aid").alias("dst"), F.struct("law", "ord").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("aid", F.lit("제[0-9]+(?:의[0-9]+)?조(?:의[0-9]+)?"), F.lit(0)))).alias("_held"))
    nodes = nodes.select("dst", "at", F.explode(F.array_distinct(F.array("_held", F.regexp_extract("_held", "^(제[0-9의]+조)", 1)))).alias("akey"))
    cites = articles.select(F.col("aid").alias("src"), F.col("law").alias("src_law"), relation("text").alias("relation"), F.explode(reference_keys("text")).alias("r"))
    hits = cites.select("src", "src_law", "relation", node_key(F.col("r"), compat).alias("akey")).join(nodes, "akey").where(F.contains("dst", F.col("src_law")))
    return hits.groupBy("src", "akey", "relation").agg(F.min_by("dst", "at").alias("dst")).where("src <> dst").select("src", "dst", "relation").distinct()


#: Neighbours in a list of the adjacency, about; a node with more has several lists.
LIST = 1024
#: Tasks that a node's neighbours are dealt to while its lists are made.
DEALS = 64


def adjacency(edges: DataFrame, size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Written tables (a, chunk, near) of each node's neighbours in lists of about `size`, edges taken both ways, and (a, chunks) of nodes with several."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = written(both, "edges")
    hubs = both.groupBy("a").agg(F.ceil(F.count("*") / size).alias("chunks")).where("chunks > 1")
    hubs = written(hubs, "hubs")  # at most a row for each `size` edges
    deals = hubs.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = both.withColumn("_deal", F.pmod(F.xxhash64("b"), F.lit(DEALS)).cast("int")).join(deals, ["a", "_deal"], "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("b", F.lit(1)), F.col("chunks")), F.lit(0)).cast("long")
    lists = dealt.select("a", chunk.alias("chunk"), "b").groupBy("a", "chunk").agg(F.collect_list("b").alias("near"))
    return written(lists, "lists"), hubs


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, size: int = LIST) -> DataFrame:
    """(query_id, id, hop): nodes within `hops` of the seeds (query_id, id), edges taken both ways; a node has its least hop.

    64 queries, with like seeds where there are such, are the bits of one number, so a hop reads a node once for all of them; a hub's neighbours are lists of
    bounded length in different tasks. Seeds and each hop's front are written, so that a hop reads its predecessor instead of
    computing it again. Seeds without query or id are passed over.
    """
    seeds = written(seeds.select("query_id", "id").dropna().distinct(), "seeds")
    lists, hubs = adjacency(edges, size)
    # queries whose seeds have the same neighbours get numbers in turn: a front then has a node once for all of them, not once for each
    marks = lists.groupBy("a").agg(F.min(F.array_min(F.transform("near", lambda b: F.xxhash64(b)))).alias("low"), F.max(F.array_max(F.transform("near", lambda b: F.xxhash64(b)))).alias("high"))
    marked = seeds.join(marks, seeds["id"] == marks["a"], "left").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = written(marked.sort("low", "high", "query_id").select("query_id").withColumn("_n", F.monotonically_increasing_id()), "queries")
    bit = F.expr("shiftleft(1L, cast(_n & 63 AS INT))")
    front = seeds.join(asked, "query_id").groupBy(F.shiftright("_n", 6).alias("block"), "id").agg(F.bit_or(bit).alias("bits"))
    seen = front = front.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        read = front.join(hubs, front["id"] == hubs["a"], "left").select("block", "id", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
        near = read.join(lists, (read["id"] == lists["a"]) & (read["chunk"] == lists["chunk"])).select("block", F.explode("near").alias("id"), "bits", F.lit(0).cast("long").alias("old"))
        both = near.union(seen.select("block", "id", F.lit(0).cast("long"), "bits")).groupBy("block", "id").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        new = both.select("block", "id", F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits"), F.lit(hop).alias("hop")).where("bits <> 0")
        front = written(new, "front")
        seen = seen.union(front)
    # a block's queries, in order of their bits, are joined before the bits are spelled out
    owners = asked.groupBy(F.shiftright("_n", 6).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_n", "query_id"))).alias("_ids"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    rows = seen.join(owners, "block").select("id", "hop", F.explode(F.transform(numbers, lambda k: F.get("_ids", k)["query_id"])).alias("query_id"))
    return rows.select("query_id", "id", "hop")


def cross_law_ratio(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, cross (between laws) and ratio in percent; laws are looked up, not cut from ids."""
    law = nodes.select(F.col("id").alias("_id"), F.col("law").alias("_law"))
    rows = edges.join(law.select(F.col("_id").alias("src"), F.col("_law").alias("a")), "src").join(law.select(F.col("_id").alias("dst"), F.col("_law").alias("b")), "dst")
    counts = rows.agg(F.count("*").alias("edges"), F.count_if(F.col("a") != F.col("b")).alias("cross"))
    return counts.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("cross") * 100.0, F.col("edges")), F.lit(0.0)), 2))


def viz_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a drawing of the graph shows: labels with 400 characters as tooltip, and edges with a colour per relation."""
    colours = {"벌칙": "red", "예외": "orange", "면제": "green", "적용": "blue"}
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in colours.items() for x in kv)), F.col("relation")), F.lit("gray"))
    return nodes.select("id", F.concat_ws(" ", "law", "title").alias("label"), F.substring("text", 1, 400).alias("tooltip")), edges.select("src", "dst", "relation", colour.alias("colour"))


def law_keywords(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(keyword): distinct names of laws and words in brackets of titles, of `least` characters or more."""
    from ..functions.text import normalize_query

    aliases = nodes.select(F.explode(F.regexp_extract_all("title", F.lit(r"\(([^)]+)\)"), F.lit(1))).alias("k"))
    words = nodes.select(F.col("law").alias("k")).union(aliases).select(sub(normalize_query("k"), r"(?U)\s*법\s*$", "법").alias("keyword"))
    return words.where(F.length("keyword") >= least).distinct()
