import re
from collections import Counter
from itertools import permutations

from sylvaframe.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, step string, mask string"
LABELS = "doc_id long, quality int, toxic int, n string"
LONG = " ".join(f"w{k}" for k in range(120))


def brute(rows, labels):
    """{(part, order, step): counts}, each document walked through each order."""
    marks = {}
    for i, q, t in labels:
        if i is not None:
            marks[i] = (marks.get(i, (0, 0))[0] or int(q == 1), marks.get(i, (0, 0))[1] or int(t == 1))
    out = Counter()
    parts = {lang or "" for _, _, lang in rows}
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        good, toxic = marks.get(i, (0, 0))
        for order in map("".join, permutations("ABCDE")):
            alive = True
            for k, x in enumerate(order, 1):
                key = (lang or "", order, k)
                here = alive and fails[x]
                out[(*key, "redundant")] += fails[x] and not alive
                out[(*key, "unique_fails")] += fails[x] and sum(fails.values()) == 1
                out[(*key, "removed")] += here
                out[(*key, "good_lost")] += here and good
                out[(*key, "toxic_lost")] += here and toxic
                out[(lang or "", x, "shapley")] += here
                alive = alive and not fails[x]
                out[(*key, "kept")] += alive
    return {(p, o, k): tuple(int(out[(p, o, k, c)]) for c in A.COUNTS) + (int(out[(p, o[k - 1], "shapley")]),) for p in parts for o in map("".join, permutations("ABCDE")) for k in range(1, 6)}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = A.audit(docs, spark.createDataFrame([(*r, "z") for r in labels], LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (*(r[c] for c in A.COUNTS), r.shapley) for r in got}


def test_against_walking_each_document(spark):
    rows = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (2, LONG, "en"), (4, None, "en"), (5, "", None), (6, "  \t", ""), (None, LONG, "en"), (None, "x # y", None),
        (7, LONG.upper(), "fr"), (8, LONG + " $ " + LONG, "fr"), (9, "a " * 300, "de"), (10, "A#" * 3, "de"), (11, " " + LONG.replace("w1", "W") + "\n", "en"), (12, LONG + "|", "en"), (13, "é" * 50 + " ABCDE", "xx"), (14, "A" * 5 + "é" * 45, "xx"), (15, " ".join(f"w{k % 80}" for k in range(100)), "xx"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1), (12, None, 1), (9, 1, 0), (9, 1, 0)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_many_copies_with_null_and_repeated_ids(spark):
    rows = [(k // 2, LONG, "en" if k % 3 else "fr") for k in range(200)] + [(None, LONG, "fr")] * 30
    assert found(spark, rows, []) == brute(rows, [])


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, LONG, "en")]
    assert found(spark, rows, []) == brute(rows, [])


def test_long_text(spark):
    rows = [(1, "word " * 400_000, "en"), (2, " ".join(map(str, range(300_000))), "en")]
    got = found(spark, rows, [])
    assert got[("en", "BADCE", 1)] == (1, 1, 0, 1, 0, 0, 120) and got[("en", "ABCDE", 5)][0] == 1


def test_cells_add_up_to_all_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    counted = A.cells(docs, labels)
    assert counted.agg({"n": "sum"}).first()[0] == docs.count()
    assert counted.groupBy("part").count().agg({"count": "max"}).first()[0] <= 4 * 2**5
