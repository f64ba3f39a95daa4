import re
from collections import defaultdict

from docweave.llm.repeated_lines import find_repeated_lines, remove_repeated_lines

ROWS = [
    (1, 10, "Notice 1\nbody a\n---"), (1, 11, "NOTICE, 2!\nbody b"), (1, 12, "body c\nnotice\nNotice"), (1, 12, "body c\nnotice\nNotice"), (1, 13, None), (1, 14, ""), (1, 15, "other"), (1, 16, "x y"),
    (2, 20, "alone"), (None, 30, "stray\n12"), (1, None, "Notice"),
]


def brute(rows, share=0.2):
    docs = {(s, d): t for s, d, t in rows if d is not None}
    total, seen = defaultdict(set), defaultdict(set)
    lines = []
    for (s, d), t in docs.items():
        total[s].add(d)
        for n, line in enumerate((t or "").split("\n"), 1):
            k = re.sub(r"[\W\d_]", "", line.lower())
            if k:
                seen[s, k].add(d)
                lines.append((s, d, n, k))
    return sorted(((d, n) for s, d, n, k in lines if len(seen[s, k]) >= share * len(total[s])))


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "lab long, id long, text string, key string, salt int")
    got = sorted((r["id"], r["line_no"]) for r in find_repeated_lines(df, "lab", "id", "text").collect())
    assert got == brute(ROWS)
    strict = sorted((r["id"], r["line_no"]) for r in find_repeated_lines(df, "lab", "id", "text", 0.4).collect())
    assert strict == brute(ROWS, 0.4)


def test_removal_keeps_other_lines(spark):
    df = spark.createDataFrame(ROWS, "lab long, id long, text string")
    got = {r["id"]: r["text"] for r in remove_repeated_lines(df, "lab", "id", "text", 0.4).collect()}
    assert got[10] == "body a\n---" and got[11] == "body b" and got[12] == "body c" and got[13] is None and got[15] == "other"


def test_empty_table(spark):
    df = spark.createDataFrame([], "lab long, id long, text string")
    assert find_repeated_lines(df, "lab", "id", "text").count() == 0
    assert remove_repeated_lines(df, "lab", "id", "text").count() == 0


def test_one_id_in_two_sources(spark):
    rows = [(1, 7, "same\nown one"), (1, 8, "same"), (2, 7, "same\nown two"), *[(2, 20 + i, f"words {'abcdefgh'[i]}") for i in range(8)]]
    df = spark.createDataFrame(rows, "lab long, id long, text string")
    got = {(r["lab"], r["id"]): r["text"] for r in remove_repeated_lines(df, "lab", "id", "text", 0.6).collect()}
    assert got[1, 7] == "own one" and got[2, 7] == "same\nown two" and len(got) == len(rows)
