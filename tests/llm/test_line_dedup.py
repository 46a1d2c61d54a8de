from collections import Counter

from lexgraph.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, source string, _host string, _text string, _drop string, _pages string"


def brute(rows, max_ratio, min_pages):
    pages, seen = Counter(), Counter()
    for _, text, host, *_ in rows:
        pages[host or ""] += 1
        seen.update({(host or "", x.strip(" ")) for x in (text or "").split("\n") if text is not None and x.strip(" ")})
    out = []
    for doc, text, host, *rest in rows:
        if text is None:
            out.append((doc, None, host, *rest, 0, 0))
            continue
        lines = text.split("\n")
        bad = lambda x: x.strip(" ") and seen[host or "", x.strip(" ")] >= min_pages and seen[host or "", x.strip(" ")] > max_ratio * pages[host or ""]  # noqa: B023, E731
        kept = [x for x in lines if not bad(x)]
        out.append((doc, "\n".join(kept), host, *rest, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(i, f"menu\nbody {i}\n\n menu \nfoot {i % 3}", f"h{i % 2}" if i % 7 else None, "a", "b", "c", "d") for i in range(40)]
    rows += [(None, "menu\nx", "h0", "a", "b", "c", "d"), (1, None, "h1", "a", "b", "c", "d"), (2, "", "h1", "a", "b", "c", "d"), (3, "\n\n", "", "a", "b", "c", "d"), (4, "menu", None, "a", "b", "c", "d")]
    rows += [rows[0]] * 3 + [(90, "x y\n" * 20000 + "menu", "h0", "a", "b", "c", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    for ratio, least in ((0.1, 5), (0.5, 2), (0.0, 1), (1.0, 1)):
        got = dedup_lines(df, max_ratio=ratio, min_pages=least)
        assert got.columns == [*df.columns, "_n_lines", "_n_dropped"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, ratio, least)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
