import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import quality, text, vectors
from docweave.operators import chunking, knn, pages, ranking, store
from docweave.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("t, expected", [("안녕하세요", "ko"), ("Hello world", "en"), ("Hello 안녕 12345678901", "mixed"), ("12345", "unknown"), ("", "unknown")])
def test_language(spark, t, expected):
    assert one(spark, text.language(F.col("t")), t=t) == expected


def test_url_exclusion_and_forms(spark):
    assert one(spark, quality.excluded_by(F.col("u")), u="http://x/research") is None
    assert one(spark, quality.excluded_by(F.col("u")), u="http://x/Admin/portal") == "/admin"
    assert one(spark, quality.excluded_by(F.col("u")), u="http://x/?password=1") is not None
    assert one(spark, quality.form_fields(F.col("h")), h='<input type="password" name="user_email">') == ["password", "email"]
    assert one(spark, quality.pii_keywords(F.col("t")), t="로그인하여 개인정보를 입력하세요.") == ["로그인", "개인정보"]


def test_ingest_score(spark):
    score = quality.ingest_score(F.col("n"), F.col("lang"), F.col("tok"), F.col("title"))
    assert one(spark, score, n=600, lang="en", tok=150, title="t") == 100
    assert one(spark, score, n=310, lang="mixed", tok=50, title="") == 60


def test_fold_keeps_the_rules():
    assert len(chunking.fold("x" * 1000, None)) == 1
    assert chunking.fold("x" * 150, None, keep_rest=False) == [] and chunking.fold("x" * 150, None) == [(None, "x" * 150)]
    assert [t for t, _ in chunking.fold("x" * 150 + "\n\nHead:\n\n" + "y" * 300, "first")] == ["Head:"]
    assert len(chunking.fold("x" * 450 + "\n\n" + "y" * 100, None, keep_rest=False)) == 1
    assert [c for _, c in chunking.fold("x" * 450 + "\n\n" + "y" * 100, None)][1].endswith("y" * 100)


def test_every_paragraph_is_in_a_chunk():
    import random

    rng = random.Random(4)
    for _ in range(200):
        parts = [f"p{i}" + "z" * rng.choice([5, 60, 250, 500]) for i in range(rng.randint(1, 9))]
        held = [c for _, c in chunking.fold("\n\n".join(parts), None)]
        assert all(any(p in c for c in held) for p in parts)


def test_chunks_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, "단락 " * 200, "e")], "doc_id long, text string, md5 string")
    got = chunking.chunks(df, "doc_id", "text").collect()
    assert [(r["doc_id"], r["chunk_no"]) for r in got] == [(3, 1)]
    assert chunking.chunks(df.limit(0), "doc_id", "text").count() == 0


def test_main_text_drops_noise_and_keeps_order():
    html = "<html><body><nav>menu menu menu</nav><main><h1>Title of page</h1><p>First paragraph here.</p><p>First  paragraph here.</p><div class='ad box'>buy buy buy now</div><p>Second paragraph here.</p></main></body></html>"
    title, body = pages.main_text(html)
    assert title == "Title of page"
    assert body.split("\n\n") == ["Title of page", "First paragraph here.", "Second paragraph here."]


def test_texts_are_taken_once():
    assert pages.main_text("<div><p>a</p><p>b</p></div>")[1] == "a\n\nb"
    assert pages.main_text("<p>a<p>b<ul><li>c<li>d</ul>")[1] == "a\n\nb\n\nc\n\nd"
    assert pages.main_text("<div>연구<p>2024. 1. 2.</p>rest</div>")[1] == "연구\n\n2024. 1. 2.\n\nrest"
    page = "".join(f"<p>paragraph {i}" for i in range(800))
    assert len(pages.main_text(page)[1]) < len(page)


@pytest.mark.parametrize("piece", ["<p>x y ", "<div>x ", "<b><p>x ", "<table><tr><td>x", "<li>a", "<span>q", "<a href='/lab'>z", "</div>", "<h1>"])
def test_odd_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    html = piece * 50_000
    pages.main_text(html), pages.page_tables(html), pages.page_links(html, "http://h.test/"), pages.lab_listing(html)
    assert time.perf_counter() - began < 30


def test_nested_tables_stand_for_themselves():
    outer, inner = pages.page_tables("<table><tr><td>a<table><tr><td>b<td>c</table>d<tr><td>e</table>")
    assert outer["rows"] == [["ad"], ["e"]] and inner["rows"] == [["b", "c"]]


def test_table_as_text_and_records(spark):
    df = spark.createDataFrame([("cap", ["h", "k"], [["1", "2", "3"], ["4"]]), ("", [], [["x", "y"]]), ("", ["h", "h"], [["1", "2"]])], "c string, h array<string>, r array<array<string>>")
    got = df.select(pages.table_text(F.col("c"), F.col("h"), F.col("r")).alias("t"), pages.table_records(F.col("h"), F.col("r")).alias("m")).collect()
    assert got[0]["t"] == "표: cap\n\nh | k\n" + "-" * 50 + "\n1 | 2 | 3\n4" and got[0]["m"] == [{"h": "1", "k": "2"}, {"h": "4"}]
    assert got[1]["t"] == "x | y" and got[1]["m"] == [] and got[2]["m"] == [{"h": "2"}]


def test_tables_and_tags():
    html = "<table><caption>Papers</caption><tr><th>Year</th><th>Venue</th><th>Title</th></tr><tr><td>2024.5</td><td>CVPR</td><td>A</td></tr><tr><td></td></tr><tr><td>2023</td></tr></table><table></table>"
    (t,) = pages.page_tables(html)
    assert t["headers"] == ["Year", "Venue", "Title"] and t["lab_tags"] == ["CVPR2024"] and len(t["rows"]) == 2


def test_listing_and_links():
    html = "<div class='labs'><dl><dt>비전 연구실<small>Vision Lab</small></dt><dd><span>지도교수</span>김하나</dd><dd><span>웹사이트</span><a href='http://v.test'>go</a></dd></dl></div>"
    (lab,) = pages.lab_listing(html)
    assert (lab["kor_name"], lab["eng_name"], lab["professor"], lab["homepage"]) == ("비전 연구실", "Vision Lab", "김하나", "http://v.test")
    found = pages.page_links("<a href='/a/people/a/people?x=1'>x</a><a href='http://other.test/lab'>y</a><a href='/news'>논문</a>", "http://h.test/")
    assert found == ["http://h.test/a/people", "http://h.test/news"]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, vec array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in knn.nearest(df, df.filter("id % 10 = 0"), "id", "vec", 4).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i in range(60) if i != q))[:4]
        assert [got[(q, k + 1)] for k in range(4)] == [(i, -s) for s, i in order]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"]), (3, ["d"])], "id long, toks array<string>")
    asked = spark.createDataFrame([(9, ["c", "a", "c"])], "q long, toks array<string>")
    got = {r["doc"]: r["score"] for r in ranking.bm25_topk(docs, "id", F.col("toks"), asked, "q", F.col("toks")).collect()}
    raw = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    mean = sum(raw.values()) / 4
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    part = lambda tf, n, t: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert got[1] == pytest.approx(part(1, 2, "a"))
    assert got[2] == pytest.approx(2 * part(2, 3, "c") + part(1, 3, "a"))
    assert 3 not in got


def test_bm25_topk_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    texts = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for i in range(80)}
    words = {i: [rng.choice("abcdefghz") for _ in range(rng.randint(0, 3))] for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "id long, toks array<string>").repartition(4)
    asked = spark.createDataFrame(list(words.items()), "q long, toks array<string>")
    held = {t: sum(t in v for v in texts.values()) for t in "abcdefgh"}
    raw = {t: math.log(80 - n + 0.5) - math.log(n + 0.5) for t, n in held.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / 8 for t, v in raw.items()}
    mean = sum(map(len, texts.values())) / 80
    every = {}
    for q, ws in words.items():
        for d, ts in texts.items():
            if set(ws) & set(ts):
                score = sum(idf[w] * ts.count(w) * 2.5 / (ts.count(w) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for w in ws if w in ts)
                every.setdefault(q, []).append((-round(score, 9), d))
    best = {q: {k + 1: d for k, (_, d) in enumerate(sorted(v)[:5])} for q, v in every.items()}
    for block, part in ((100, 100), (3, 25)):  # broadcast, and dealt to blocks and parts
        got = {}
        for r in ranking.bm25_topk(docs, "id", F.col("toks"), asked, "q", F.col("toks"), 5, block, part).collect():
            got.setdefault(r["query"], {})[r["rank"]] = r["doc"]
        assert got == best
    assert ranking.bm25_topk(docs.limit(0), "id", F.col("toks"), asked, "q", F.col("toks")).count() == 0
    assert ranking.bm25_topk(docs, "id", F.col("toks"), asked.limit(0), "q", F.col("toks")).count() == 0


def test_dealt_blocks_read_the_rows_once(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)]) for i in range(200)], "id long, vec array<double>")
    broadcast = knn.nearest(df, df.filter("id % 5 = 0"), "id", "vec", 3)
    dealt = knn.nearest(df, df.filter("id % 5 = 0"), "id", "vec", 3, block_bytes=7 * 24, part_rows=50)
    rows = lambda d: sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in d.collect())
    assert rows(dealt) == rows(broadcast) and len(rows(dealt)) == 120
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation [") <= 2  # the queries and the rows


def test_neighbours_above_a_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id long, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vec array<double>")
    assert [(r["query_id"], r["id"]) for r in knn.nearest(df, asked, "id", "vec", 5, "q", 0.5).orderBy("rank").collect()] == [(1, 1), (1, 3)]


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, ["x", "a", "b"]), (2, ["a", "x", "x"]), (3, ["a", "b", "a"])], "id long, toks array<string>")
    got = {r["doc"]: round(r["score"], 6) for r in ranking.cover_density(docs, "id", F.col("toks"), ["a", "b"]).collect()}
    assert got == {1: 0.5, 3: 1.0}


def test_scaling(spark):
    df = spark.createDataFrame([(1, 0.69), (1, 0.70), (1, 0.80), (1, 0.90), (2, 0.75), (3, 0.1)], "g long, s double")
    got = [round(r["x"], 6) for r in df.select("g", "s", ranking.masked_scaled(F.col("s"), "g").alias("x")).orderBy("g", "s").collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 0.5, 0.0]


def test_cosine_of_odd_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, F.round(vectors.cosine(F.col("a"), F.col("b")), 6), a=[3.0, 4.0], b=[3.0, 4.0]) == 1.0


def test_store_transforms(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "lab_id long, md5 string")
    new = spark.createDataFrame([(1, "a", 5), (1, "c", 7), (1, "c", 6), (None, "d", 1)], "lab_id long, md5 string, n int")
    assert store.is_stored(new, old, ["lab_id", "md5"]).count() == 1
    assert sorted((r["md5"], r["n"]) for r in store.insert_new(new, old, ["lab_id", "md5"], ["n"]).collect()) == [("c", 6), ("d", 1)]
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "k long, f string, g string")
    b = spark.createDataFrame([(1, "z", None), (3, "w", None)], "k long, f string, g string")
    assert sorted(tuple(r) for r in store.diff(a, b, "k", ["f", "g"]).select("k", "change_type").collect()) == [(1, "modified"), (2, "deleted"), (3, "added")]
    assert sorted((r["k"], r["f"]) for r in store.upsert(a, b, "k", ["f", "g"]).collect()) == [(1, "z"), (2, "y"), (3, "w")]


def test_keyed_json(spark, tmp_path):
    (tmp_path / "labs.json").write_text('{"1": {"kor_name": "가", "professor": null}, "2": {"kor_name": "나"}}', encoding="utf-8")
    got = {r["lab_id"]: (r["kor_name"], r["professor"]) for r in files.read_labs(spark, str(tmp_path / "labs.json")).collect()}
    assert got == {"1": ("가", ""), "2": ("나", "")}
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_pages_as_dataframes(spark):
    html = "<body><table><tr><th>Venue</th><th>Year</th></tr><tr><td>ICCV</td><td>2023</td></tr></table><div class='labs'><dl><dt>가</dt></dl></div></body>" + " " * 100
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    (t,) = pages.tables(df, "id", "html").collect()
    assert (t["id"], t["lab_tags"], t["rows"]) == (1, ["ICCV2023"], [["ICCV", "2023"]])
    assert [r["kor_name"] for r in pages.listing(df, "html").collect()] == ["가"]
    assert [r["id"] for r in pages.main_content(df, "id", "html").collect()] == [1]


def test_cache_lookup_equals_scan(spark):
    import datetime as dt
    import random

    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), start + dt.timedelta(hours=rng.randint(0, 900)), rng.choice([True, False, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "log_id long, lab_id long, at timestamp_ntz, success boolean")
    got = {r["log_id"]: (r["cached_at"], r["hit"]) for r in store.cache_lookup(df, "lab_id", "at", F.col("success")).collect()}
    for i, lab, at, _ in rows:
        earlier = [t for j, k, t, ok in rows if k == lab and ok and (t, j) < (at, i)]
        last = max(earlier, default=None)
        assert got[i] == (last, last is not None and at - last <= dt.timedelta(days=7))


def test_index_recall(spark, sf_dir):
    import __spark_entry__

    every = __spark_entry__.queries()
    exact = {(r["query_vec_id"], r["vec_id"]) for r in every["vector_topk"](spark, sf_dir).collect()}
    found = {(r["query_vec_id"], r["vec_id"]) for r in every["vector_topk_index"](spark, sf_dir).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_index_holds_every_row(spark):
    from docweave.operators import ivf

    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)]) for i in range(50)] + [(99, None), (100, [0.0, 0.0, 0.0])], "id long, vec array<double>")
    centres, probes = ivf.fit(df, "id", "vec", 5)
    index = ivf.build(df, "id", "vec", centres)
    assert index.count() == index.select("id").distinct().count() == 51
    assert ivf.search(index, df.limit(0), "id", "vec", centres, 3, probes).count() == 0


def test_search_of_many_queries(spark):
    docs = spark.createDataFrame([(0, "a b", "x a y b a".split(), [1.0, 0.0]), (50, "b a a", "a b".split(), None), (1, "c", "b a".split(), [0.6, 0.8]), (2, None, "a a".split(), [0.0, 1.0]), (3, "z", [], None)], "id long, title string, toks array<string>, vec array<double>")
    asked = docs.filter("id % 50 = 0")
    terms = F.split("title", " ")
    words = ranking.search_topk(docs, asked, "id", F.col("toks"), terms, 10)
    assert {(r["query"], r["doc"], round(r["score"], 6), r["rank"]) for r in words.collect()} == {(0, 1, 0.5, 1), (0, 50, 0.5, 2), (50, 0, round(1 / 3 + 1 / 2, 6), 1), (50, 1, 0.5, 2)}
    both = ranking.search_topk(docs, asked, "id", F.col("toks"), terms, 2, "vec", 0.3, 0.7)
    assert {(r["query"], r["doc"], round(r["score"], 6), r["rank"]) for r in both.collect()} == {(0, 1, 0.57, 1), (0, 50, 0.15, 2), (50, 0, 0.25, 1), (50, 1, 0.15, 2)}
    dealt = ranking.search_topk(docs, asked, "id", F.col("toks"), terms, 2, "vec", 0.3, 0.7, 1, 2)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, both.collect()))
    assert ranking.search_topk(docs, asked.limit(0), "id", F.col("toks"), terms, 2, "vec", 0.3, 0.7).count() == 0


def test_hybrid_search_answers_every_asked_page(spark, sf_dir):
    from docweave.plans import catalog

    asked = spark.read.parquet(f"{sf_dir}/lab_docs.parquet").filter("doc_id % 50 = 0 AND embedding IS NOT NULL").select("doc_id").distinct()
    got = catalog.queries()["hybrid_topk"](spark, sf_dir).groupBy("query_doc_id").count().collect()
    assert {r["query_doc_id"]: r["count"] for r in got} == {r["doc_id"]: 20 for r in asked.collect()}


def test_visit_order_has_every_page(spark, sf_dir):
    from docweave.plans import catalog

    links = spark.read.parquet(f"{sf_dir}/lab_link.parquet").select("lab_id", F.regexp_replace("url", r"^https?://(www\.)?", "").alias("page")).distinct()
    got = catalog.queries()["crawl_visit_order_all"](spark, sf_dir)
    assert got.count() == links.count() and got.select("lab_id", "page").exceptAll(links).count() == 0
