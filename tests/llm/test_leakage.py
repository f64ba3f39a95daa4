import random
from itertools import combinations

from docweave.llm.leakage import find_leaks, holds_passage, words_of

WORDS = "river stone lamp field cloud engine silver paper garden winter bridge copper signal market valley thunder basket mirror candle harbor forest ladder anchor ribbon saddle velvet pepper marble hammer kettle".split()


def text(rng, n):
    return [rng.choice(WORDS) + str(rng.randint(1, 99)) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(11)
    items = {i: text(rng, 40) for i in range(12)}
    docs, truth = [], set()
    for d in range(120):
        body = text(rng, 60)
        if d % 4 == 0:
            i = rng.randrange(12)
            start = rng.randrange(20)
            part = items[i][start : start + 18]
            if d % 8 == 0:
                part[6] = "replaced"
                del part[12]
            body[20:20] = part
            truth.add((d, i))
        elif d % 4 == 1:
            body[20:20] = items[rng.randrange(12)][:6]
        docs.append((d, ", ".join(w.upper() for w in body)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (None, docs[0][1])]
    truth |= {(902, i) for d, i in truth if d == 0}
    df = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id long").repartition(3)
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, "doc_id", "text", ev, "item_id", "text").collect()}
    assert got == truth
    assert find_leaks(df.limit(0), "doc_id", "text", ev, "item_id", "text").count() == 0
    assert find_leaks(df, "doc_id", "text", ev.limit(0), "item_id", "text").count() == 0


def test_verification():
    item = [f"w{i}" for i in range(30)]
    rare = set(item)
    assert holds_passage(["x", *item[5:17], "y"], item, rare)
    assert not holds_passage(["x", *item[5:16], "y"], item, rare)
    assert holds_passage(item[:4] + ["q"] + item[5:10] + item[11:16], item, rare)
    assert not holds_passage(item[:6] + ["a", "b", "c", "d"] + item[10:16], item, rare)


def test_words_ignore_writing():
    assert words_of("Ａ Word,  29.5 x") == ["a", "word", "29.5", "x"]


def test_every_pattern_of_replaced_words(spark):
    item = [f"w{i}" for i in range(12)]
    docs = []
    for n in range(4):
        for gone in combinations(range(12), n):
            part = [f"x{i}" if i in gone else w for i, w in enumerate(item)]
            if holds_passage(part, item, set(item)):
                docs.append((len(docs), "before it " + " ".join(part) + " after it"))
    assert len(docs) > 40 and any("w1 x2 w3 w4 x5 w6 w7 x8 w9" in t for _, t in docs)
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), "item_id", "text")
    assert {r["doc_id"] for r in got.collect()} == {d for d, _ in docs}


def test_one_phrase_in_nearly_every_document(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.range(3_000).selectExpr("id AS doc_id", f"concat('{item} in ', id) AS text")
    assert find_leaks(docs, "doc_id", "text", spark.createDataFrame([(1, item), (2, item)], "item_id long, text string"), "item_id", "text").count() == 6_000
