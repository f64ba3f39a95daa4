"""Retrieval and recommendation queries with their SQL.

Queries of a search are the rows whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text, vectors
from docweave.operators import ivf, knn, ranking
from docweave.sources.tables import load

TERMS = ["지식", "그래프"]
SOURCE_TOP = 50  # labs that each source of candidates proposes
RERANK = {"keyword_score": 0.4, "semantic_score": 0.3, "domain_score": 0.2, "tag_score": 0.1}


def _asked(df, key):
    return df.filter(F.col(key) % 50 == 0)


def vector_topk(spark, d):
    vecs = load(spark, d, "embeddings", ["vec_id", "embedding"])
    return knn.nearest(vecs, _asked(vecs, "vec_id"), "vec_id", "embedding", 10).select(F.col("query_id").alias("query_vec_id"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_topk_index(spark, d):
    """The same by an inverted-file index: approximate, so without SQL; its recall is measured in the tests."""
    vecs = load(spark, d, "embeddings", ["vec_id", "embedding"])
    centres, probes = ivf.fit(vecs, "vec_id", "embedding", 64)
    found = ivf.search(ivf.build(vecs, "vec_id", "embedding", centres), _asked(vecs, "vec_id"), "vec_id", "embedding", centres, 10, probes)
    return found.select(F.col("query_id").alias("query_vec_id"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def vector_search_filtered(spark, d):
    docs = load(spark, d, "lab_docs", ["doc_id", "lab_id", "section", "quality_score", "embedding"], once=True)
    good = docs.filter((F.col("quality_score") >= 50) & (F.lower(F.trim("section")) == "research"))
    names = load(spark, d, "lab", ["lab_id", "kor_name"], once=True)
    top = knn.nearest(good, _asked(docs, "doc_id"), "doc_id", "embedding", 5)
    return top.join(good.select(F.col("doc_id").alias("id"), "lab_id"), "id").join(names, "lab_id").select(F.col("query_id").alias("query_doc_id"), F.col("id").alias("doc_id"), "lab_id", F.col("kor_name").alias("lab_name"), F.round("score", 6).alias("score"), "rank")


def lab_mean_vectors(spark, d):
    docs = load(spark, d, "lab_docs", ["doc_id", "lab_id", "embedding"], once=True).filter("embedding IS NOT NULL")
    means = docs.select("lab_id", F.posexplode("embedding").alias("dim", "x")).groupBy("lab_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norms = means.groupBy("lab_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return means.join(norms, "lab_id").select("lab_id", "dim", F.round(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")), 6).alias("value"))


def vector_pairs(spark, d):
    """Cosine of each page to the mean of its lab."""
    docs = load(spark, d, "lab_docs", ["doc_id", "lab_id", "embedding"], once=True).filter("embedding IS NOT NULL")
    mean = docs.select("lab_id", F.posexplode("embedding").alias("dim", "x")).groupBy("lab_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("lab_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return docs.join(whole, "lab_id").select("doc_id", "lab_id", F.round(vectors.cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


def _holding(docs):
    for term in TERMS:
        docs = docs.filter(text.may_hold(F.col("text"), term))
    return docs


def hybrid_search(spark, d):
    docs = load(spark, d, "lab_docs", ["doc_id", "lab_id", "quality_score", "embedding"], once=True).filter("quality_score >= 30")
    texts = _holding(load(spark, d, "lab_docs", ["doc_id", "text", "quality_score"]).filter("quality_score >= 30"))  # a row that stands twice has the same covers
    asked = docs.filter("embedding IS NOT NULL").orderBy("doc_id").limit(1).select(F.col("embedding").alias("q"))
    words = ranking.cover_density(texts, "doc_id", text.plain_tokens(F.col("text")), TERMS).withColumnRenamed("doc", "doc_id").withColumnRenamed("score", "keyword_score")
    scored = docs.crossJoin(F.broadcast(asked)).select("doc_id", "lab_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("vector_score")).join(words, "doc_id", "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    top = scored.withColumn("hybrid", F.col("vector_score") * 0.7 + F.col("keyword_score") * 0.3).orderBy(F.desc(F.round("hybrid", 9)), "doc_id").limit(20)
    return top.select("doc_id", "lab_id", F.round("hybrid", 6).alias("hybrid_score"), F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"))


def full_text_match(spark, d):
    docs = _holding(load(spark, d, "lab_docs", ["doc_id", "text"]))
    return ranking.cover_density(docs, "doc_id", text.plain_tokens(F.col("text")), TERMS).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def hybrid_topk(spark, d):
    """Hybrid search for every asked page, by its vector and the words of its title, against all pages."""
    docs = load(spark, d, "lab_docs", ["doc_id", "text", "title", "embedding"], once=True)
    top = ranking.search_topk(docs, _asked(docs, "doc_id"), "doc_id", text.plain_tokens(F.col("text")), text.plain_tokens(F.col("title")), 20, "embedding", 0.3, 0.7)
    return top.select(F.col("query").alias("query_doc_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("hybrid_score"), F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), "rank")


def full_text_topk(spark, d):
    """Full-text match for every asked page, by the words of its title, against all pages."""
    docs = load(spark, d, "lab_docs", ["doc_id", "text", "title"], once=True)
    top = ranking.search_topk(docs, _asked(docs, "doc_id"), "doc_id", text.plain_tokens(F.col("text")), text.plain_tokens(F.col("title")), 10)
    return top.select(F.col("query").alias("query_doc_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _labs(spark, d):
    return load(spark, d, "lab", ["lab_id", "kor_name", "description"], once=True).select("lab_id", F.concat_ws(" ", F.coalesce("kor_name", F.lit("")), F.coalesce("description", F.lit(""))).alias("lab_text"))


def _students(spark, d):
    return _asked(load(spark, d, "student_profile", ["profile_id", "research_interests"], once=True), "profile_id").filter("research_interests IS NOT NULL")


def _search(c):
    return text.search_tokens(F.col(c))


def bm25_labs(spark, d):
    scored = ranking.bm25_topk(_labs(spark, d), "lab_id", _search("lab_text"), _students(spark, d), "profile_id", _search("research_interests"), 20)
    return scored.select(F.col("query").alias("profile_id"), F.col("doc").alias("lab_id"), F.round("score", 6).alias("score"), "rank")


def bm25_documents(spark, d):
    docs = load(spark, d, "lab_docs", ["doc_id", "text", "title"], once=True)
    top = ranking.bm25_topk(docs, "doc_id", _search("text"), _asked(docs, "doc_id").filter("title IS NOT NULL"), "doc_id", _search("title"), 10)
    return top.select(F.col("query").alias("query_doc_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def domain_match(spark, d):
    docs = load(spark, d, "lab_docs", ["doc_id", "text", "title"])
    return docs.select("doc_id", F.array_join(ranking.domains_of(F.col("text")), ",").alias("domains"), F.round(ranking.domain_score(ranking.domain_hits(F.coalesce("title", F.lit(""))), ranking.domain_hits(F.col("text"))), 6).alias("score")).dropDuplicates(["doc_id"])


def _scores(spark, d):
    """The best SOURCE_TOP labs of each profile by words, by vector and by domain, together, with their scores.

    Each source gives a bounded list for each profile, so pairs never outnumber profiles by more
    than three lists; only these are scored.
    """
    labs, students = _labs(spark, d), _students(spark, d)
    n_labs = labs.agg(F.count("*").alias("n_labs"))
    key = ranking.bm25_topk(labs, "lab_id", _search("lab_text"), students, "profile_id", _search("research_interests"), SOURCE_TOP).filter("score > 0").withColumn("log", F.log1p("score"))
    bounds = key.groupBy("query").agg(F.count("*").alias("n"), F.min("log").alias("least"), F.max("log").alias("most")).join(F.broadcast(n_labs)).select("query", F.when(F.col("n") < F.col("n_labs"), 0.0).otherwise(F.col("least")).alias("low"), F.col("most").alias("high"))
    keyword = key.join(bounds, "query").select("query", "doc", F.when(F.col("high") - F.col("low") < 1e-8, 0.0).otherwise((F.col("log") - F.col("low")) / (F.col("high") - F.col("low"))).alias("keyword_score"))
    vec = lambda df, key, c: df.select(key, vectors.hashed_counts(_search(c)).alias("vec"))
    close = knn.nearest(vec(labs, "lab_id", "lab_text"), vec(students, "profile_id", "research_interests"), "lab_id", "vec", SOURCE_TOP, "profile_id", 0.35)
    semantic = close.select(F.col("query_id").alias("query"), F.col("id").alias("doc"), ranking.masked_scaled(F.col("score"), "query_id", 0.35).alias("semantic_score"))
    q = students.select(F.col("profile_id").alias("query"), ranking.domain_hits(F.col("research_interests")).alias("qd"))
    t = labs.select(F.col("lab_id").alias("doc"), ranking.domain_hits(F.col("lab_text")).alias("td"))
    touched = t.select("doc", F.posexplode("td").alias("domain", "hits")).filter("hits > 0")
    leading = touched.withColumn("at", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("hits"), "doc"))).filter(F.col("at") <= SOURCE_TOP).select("domain", "doc")
    touching = q.select("query", F.posexplode("qd").alias("domain", "hits")).filter("hits > 0").join(F.broadcast(leading), "domain").select("query", "doc").distinct()  # nine domains of SOURCE_TOP labs
    pairs = keyword.join(semantic, ["query", "doc"], "full_outer").join(touching, ["query", "doc"], "full_outer").join(q, "query").join(t, "doc")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return pairs.select("query", "doc", zero("keyword_score"), zero("semantic_score"), ranking.domain_score(F.col("qd"), F.col("td")).alias("domain_score"), "qd", "td")


def candidate_generation(spark, d):
    s = _scores(spark, d).withColumn("combined", ranking.combined(F.col("keyword_score"), F.col("semantic_score"), F.col("domain_score")))
    s = s.filter((F.col("combined") > 0.05) & ranking.relevant(F.col("qd"), F.col("td"), F.col("combined")))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("combined", 9)), "doc")
    top = s.withColumn("rank", F.row_number().over(w)).filter("rank <= 15")
    return top.select(F.col("query").alias("profile_id"), F.col("doc").alias("lab_id"), *[F.round(c, 6).alias(c) for c in ("keyword_score", "semantic_score", "domain_score")], F.round("combined", 6).alias("combined_score"), "rank")


def _tag_overlap(spark, d):
    item = lambda c: F.lower(F.trim(c))
    mine = _students(spark, d).select("profile_id", F.explode(F.array_distinct(F.transform(F.split("research_interests", ","), lambda x: F.lower(F.trim(x))))).alias("item")).filter("item <> ''")
    theirs = load(spark, d, "lab_tag", ["lab_id", "tag_value"]).select("lab_id", F.explode(text.word_tokens(F.concat_ws(" ", item("tag_value")))).alias("item")).distinct()
    words = mine.select("profile_id", F.explode(F.split("item", " +")).alias("item")).distinct()
    shared = words.join(theirs, "item").groupBy("profile_id", "lab_id").agg(F.count("*").alias("shared"))
    a, b = words.groupBy("profile_id").agg(F.count("*").alias("a")), theirs.groupBy("lab_id").agg(F.count("*").alias("b"))
    return shared.join(a, "profile_id").join(b, "lab_id").select("profile_id", "lab_id", "shared", (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("jaccard"))


def tag_jaccard(spark, d):
    return _tag_overlap(spark, d).select("profile_id", "lab_id", "shared", F.round("jaccard", 6).alias("jaccard"))


def rerank(spark, d):
    tags = _tag_overlap(spark, d).select(F.col("profile_id").alias("query"), F.col("lab_id").alias("doc"), F.col("jaccard").alias("tag_score"))
    scored = _scores(spark, d).join(tags, ["query", "doc"], "left").withColumn("final", ranking.weighted_sum(RERANK)).filter("final >= 0.1")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("final", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select(F.col("query").alias("profile_id"), F.col("doc").alias("lab_id"), F.round("final", 6).alias("final_score"), "rank")


def intro_similarity(spark, d):
    p = load(spark, d, "student_profile", ["profile_id", "intro1", "intro2"], once=True).filter("intro1 IS NOT NULL AND intro2 IS NOT NULL")
    a, b = text.plain_tokens(F.col("intro1")), text.plain_tokens(F.col("intro2"))
    t = p.select("profile_id", a.alias("a"), b.alias("b"))
    return t.select("profile_id", F.round(ranking.tfidf_cosine(F.col("a"), F.col("b")), 6).alias("tfidf"), F.round(vectors.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_index, vector_search_filtered, lab_mean_vectors, vector_pairs, hybrid_search, full_text_match, hybrid_topk, full_text_topk, bm25_labs, bm25_documents, domain_match, candidate_generation, tag_jaccard, rerank, intro_similarity)}

_DOCS = "docs AS (SELECT DISTINCT ON (doc_id) * FROM lab_docs)"
_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
_V = "::DOUBLE[]"


def _tok(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[ \n\r\t]+'), lambda x: x <> '' AND x NOT IN {_STOP})"


def _plain(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '[ \n\r\t]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda x: x <> '')"


def _topk(corpus: str, queries: str, key: str, k: int) -> str:
    return f"""SELECT q, id, s, rank FROM (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id)::INTEGER AS rank FROM
 (SELECT a.{key} AS q, b.{key} AS id, list_cosine_similarity(a.embedding{_V}, b.embedding{_V}) AS s FROM {queries} a, {corpus} b WHERE a.{key} <> b.{key} AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL)) WHERE rank <= {k}"""


_BM25 = """size AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM c),
post AS (SELECT id, len(toks) AS dl, unnest(toks) AS tok FROM c), tf AS (SELECT id, dl, tok, count(*) AS tf FROM post GROUP BY ALL),
raw AS (SELECT tok, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, size GROUP BY tok, n_docs),
idf AS (SELECT tok, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT q, unnest(toks) AS tok FROM a), times AS (SELECT q, tok, count(*) AS n FROM asked GROUP BY ALL),
bm AS (SELECT q, id, sum(n * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM times JOIN idf USING (tok) JOIN tf USING (tok), size GROUP BY q, id)"""
_LABS = "labs AS (SELECT DISTINCT lab_id AS id, coalesce(kor_name, '') || ' ' || coalesce(description, '') AS t FROM lab)"
_STUDENTS = "students AS (SELECT DISTINCT profile_id AS q, research_interests AS t FROM student_profile WHERE profile_id % 50 = 0 AND research_interests IS NOT NULL)"
_PAIRS = f"{_LABS}, {_STUDENTS}, c AS (SELECT id, {_tok('t')} AS toks FROM labs), a AS (SELECT q, {_tok('t')} AS toks FROM students), {_BM25}"


def _domain_any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


def _domains(t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_domain_any(t, terms)} THEN '{k}' END" for k, (_, terms) in ranking.DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


def _domain_score(q: str, t: str) -> str:
    parts = []
    for w, terms in ranking.DOMAINS.values():
        n = "(" + " + ".join(f"contains({t}, '{x}')::INTEGER" for x in terms) + ")"
        parts.append(f"CASE WHEN {_domain_any(q, terms)} AND {n} > 0 THEN least({n} * 3.0::DOUBLE / {len(terms)}, 1.0::DOUBLE) * {w}::DOUBLE END")
    return f"least(coalesce(list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), 0.0::DOUBLE), 1.0::DOUBLE)"


def _hit_list(t: str) -> str:
    return "[" + ", ".join("(" + " + ".join(f"contains({t}, '{x}')::INTEGER" for x in terms) + ")" for _, terms in ranking.DOMAINS.values()) + "]"


def _buckets(toks: str) -> str:
    return f"list_transform(range(0, 64), lambda i: len(list_filter(list_transform({toks}, lambda x: ('0x' || substr(md5(x), 1, 4))::INTEGER % 64), lambda b: b = i))::DOUBLE)"


def _first(partition: str, order: str, rows: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS place FROM {rows}) WHERE place <= {SOURCE_TOP})"


_SCORES = f"""{_PAIRS},
vq AS (SELECT q, {_buckets('toks')} AS v FROM a), vc AS (SELECT id, {_buckets('toks')} AS v FROM c),
sim AS (SELECT q, id, coalesce(list_cosine_similarity(vq.v, vc.v), 0) AS s FROM vq, vc),
bk AS (SELECT q, id, ln(1 + score) AS x FROM {_first('q', 'round(score, 9) DESC, id', 'bm')} WHERE score > 0),
bs AS (SELECT q, id, s AS y FROM {_first('q', 's DESC, id', '(SELECT * FROM sim WHERE s >= 0.35)')}),
hits AS (SELECT id, unnest(range(0, len(hs))) AS dom, unnest(hs) AS h FROM (SELECT id, {_hit_list('lower(t)')} AS hs FROM labs)),
asks AS (SELECT q, unnest(range(0, len(hs))) AS dom, unnest(hs) AS h FROM (SELECT q, {_hit_list('lower(t)')} AS hs FROM students)),
bd AS (SELECT DISTINCT q, f.id FROM asks JOIN {_first('dom', 'h DESC, id', '(SELECT * FROM hits WHERE h > 0)')} f ON f.dom = asks.dom WHERE asks.h > 0),
every AS (SELECT q, id FROM bk UNION SELECT q, id FROM bs UNION SELECT q, id FROM bd),
kb AS (SELECT q, CASE WHEN count(*) < (SELECT count(*) FROM labs) THEN 0 ELSE min(x) END AS x0, max(x) AS x1 FROM bk GROUP BY q), sb AS (SELECT q, min(y) AS y0, max(y) AS y1 FROM bs GROUP BY q),
scores AS (SELECT e.q, e.id, CASE WHEN x IS NULL OR x1 - x0 < 1e-8 THEN 0 ELSE (x - x0) / (x1 - x0) END AS keyword_score, CASE WHEN y IS NULL THEN 0 WHEN y1 - y0 < 1e-8 THEN 0.5 ELSE (y - y0) / (y1 - y0) END AS semantic_score,
 {_domain_score('lower(s.t)', 'lower(l.t)')} AS domain_score, {_domains('lower(s.t)')} AS qd, {_domains('lower(l.t)')} AS td
 FROM every e JOIN students s ON s.q = e.q JOIN labs l ON l.id = e.id LEFT JOIN bk ON bk.q = e.q AND bk.id = e.id LEFT JOIN bs ON bs.q = e.q AND bs.id = e.id LEFT JOIN kb ON kb.q = e.q LEFT JOIN sb ON sb.q = e.q)"""
_TAGS = r"""words AS (SELECT DISTINCT q, unnest(list_filter(regexp_split_to_array(lower(replace(t, ',', ' ')), ' +'), lambda x: x <> '')) AS w FROM students),
tags AS (SELECT DISTINCT lab_id AS id, unnest(list_filter(regexp_split_to_array(lower(trim(tag_value)), '[ \n\r\t]+'), lambda x: x <> '')) AS w FROM lab_tag),
overlap AS (SELECT q, id, count(*) AS shared, count(*) / ((SELECT count(*) FROM words x WHERE x.q = words.q) + (SELECT count(*) FROM tags y WHERE y.id = tags.id) - count(*))::DOUBLE AS jaccard FROM words JOIN tags USING (w) GROUP BY q, id)"""
_COVER = f"""held AS (SELECT doc_id, toks FROM (SELECT doc_id, {_plain('text')} AS toks FROM docs) WHERE list_has_all(toks, ['{TERMS[0]}', '{TERMS[1]}'])),
spots AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos FROM held),
lasts AS (SELECT doc_id, pos, max(CASE WHEN tok = '{TERMS[0]}' THEN pos END) OVER w AS l1, max(CASE WHEN tok = '{TERMS[1]}' THEN pos END) OVER w AS l2 FROM spots WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cover AS (SELECT doc_id, least(l1, l2) AS s, min(pos) AS e FROM lasts WHERE l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY 1, 2),
dense AS (SELECT doc_id, sum(1.0::DOUBLE / (e - s + 1)) AS score FROM cover GROUP BY doc_id)"""

_MATCHES = f"""a AS (SELECT doc_id AS q, embedding AS v, list_distinct({_plain('title')}) AS terms FROM docs WHERE doc_id % 50 = 0),
b AS (SELECT doc_id AS id, embedding AS v, {_plain('text')} AS toks FROM docs),
words AS (SELECT id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos FROM b),
hits AS (SELECT q, id, len(terms) AS n, tok, pos FROM a JOIN words ON list_contains(terms, tok) WHERE q <> id),
back AS (SELECT e.q, e.id, e.n, e.pos AS e, p.tok, max(p.pos) AS s FROM hits e JOIN hits p ON p.q = e.q AND p.id = e.id AND p.pos <= e.pos GROUP BY ALL),
whole AS (SELECT q, id, e, min(s) AS s FROM back GROUP BY q, id, e, n HAVING count(*) = n),
matched AS (SELECT q, id, sum(1.0::DOUBLE / (e - s + 1)) AS ks FROM (SELECT q, id, s, min(e) AS e FROM whole GROUP BY q, id, s) GROUP BY q, id)"""

ORACLES = {
    "vector_topk": f"SELECT q AS query_vec_id, id AS vec_id, round(s, 6) AS score, rank FROM ({_topk('embeddings', '(SELECT * FROM embeddings WHERE vec_id % 50 = 0)', 'vec_id', 10)})",
    "vector_search_filtered": f"""WITH {_DOCS}, good AS (SELECT * FROM docs WHERE quality_score >= 50 AND lower(trim(section)) = 'research')
 SELECT t.q AS query_doc_id, t.id AS doc_id, g.lab_id, l.kor_name AS lab_name, round(s, 6) AS score, rank FROM ({_topk('good', '(SELECT * FROM docs WHERE doc_id % 50 = 0)', 'doc_id', 5)}) t JOIN good g ON g.doc_id = t.id JOIN (SELECT DISTINCT lab_id, kor_name FROM lab) l ON l.lab_id = g.lab_id""",
    "lab_mean_vectors": f"""WITH {_DOCS}, x AS (SELECT lab_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS dim FROM docs WHERE embedding IS NOT NULL), m AS (SELECT lab_id, dim, avg(x) AS x FROM x GROUP BY 1, 2)
 SELECT lab_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY lab_id)), 6) AS value FROM m""",
    "vector_pairs": f"""WITH {_DOCS}, x AS (SELECT lab_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM docs WHERE embedding IS NOT NULL), m AS (SELECT lab_id, dim, avg(x) AS x FROM x GROUP BY 1, 2),
 v AS (SELECT lab_id, list(x ORDER BY dim) AS mean FROM m GROUP BY lab_id) SELECT doc_id, lab_id, round(list_cosine_similarity(embedding{_V}, mean), 6) AS similarity FROM docs JOIN v USING (lab_id) WHERE embedding IS NOT NULL""",
    "hybrid_search": f"""WITH docs AS (SELECT * FROM (SELECT DISTINCT ON (doc_id) * FROM lab_docs) WHERE quality_score >= 30), {_COVER}, q AS (SELECT embedding AS v FROM docs WHERE embedding IS NOT NULL ORDER BY doc_id LIMIT 1),
 s AS (SELECT doc_id, lab_id, coalesce(list_cosine_similarity(embedding{_V}, v{_V}), 0) AS vs, coalesce(score, 0) AS ks FROM docs CROSS JOIN q LEFT JOIN dense USING (doc_id))
 SELECT doc_id, lab_id, round(vs * 0.7::DOUBLE + ks * 0.3::DOUBLE, 6) AS hybrid_score, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score FROM s ORDER BY round(vs * 0.7::DOUBLE + ks * 0.3::DOUBLE, 9) DESC, doc_id LIMIT 20""",
    "full_text_match": f"WITH {_DOCS}, {_COVER} SELECT doc_id, round(score, 6) AS score FROM dense",
    "hybrid_topk": f"""WITH {_DOCS}, {_MATCHES}, every AS (SELECT a.q, b.id, coalesce(list_cosine_similarity(a.v{_V}, b.v{_V}), 0) AS vs, coalesce(ks, 0) AS ks FROM a JOIN b ON a.q <> b.id LEFT JOIN matched m ON m.q = a.q AND m.id = b.id WHERE ks > 0 OR (a.v IS NOT NULL AND b.v IS NOT NULL)),
 best AS (SELECT *, vs * 0.7::DOUBLE + ks * 0.3::DOUBLE AS h FROM every) SELECT q AS query_doc_id, id AS doc_id, round(h, 6) AS hybrid_score, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(h, 9) DESC, id)::INTEGER AS rank FROM best) WHERE rank <= 20""",
    "full_text_topk": f"""WITH {_DOCS}, {_MATCHES} SELECT q AS query_doc_id, id AS doc_id, round(ks, 6) AS score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ks, 9) DESC, id)::INTEGER AS rank FROM matched) WHERE rank <= 10""",
    "bm25_labs": f"WITH {_PAIRS} SELECT q AS profile_id, id AS lab_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM bm) WHERE rank <= 20",
    "bm25_documents": f"""WITH {_DOCS}, c AS (SELECT doc_id AS id, {_tok('text')} AS toks FROM docs), a AS (SELECT doc_id AS q, {_tok('title')} AS toks FROM docs WHERE doc_id % 50 = 0 AND title IS NOT NULL), {_BM25}
 SELECT q AS query_doc_id, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM bm) WHERE rank <= 10""",
    "domain_match": f"WITH {_DOCS} SELECT doc_id, array_to_string({_domains('lower(text)')}, ',') AS domains, round({_domain_score('lower(coalesce(title, chr(0)))', 'lower(text)')}, 6) AS score FROM docs",
    "candidate_generation": f"""WITH {_SCORES}, comb AS (SELECT *, 0.5::DOUBLE * CASE WHEN domain_score > 0.3 THEN domain_score * 0.7::DOUBLE + keyword_score * 0.3::DOUBLE ELSE keyword_score END + 0.5::DOUBLE * semantic_score AS combined FROM scores),
 ok AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(combined, 9) DESC, id)::INTEGER AS rank FROM comb WHERE combined > 0.05 AND NOT (len(qd) > 0 AND len(td) > 0 AND NOT list_has_any(qd, td) AND combined < 0.8))
 SELECT q AS profile_id, id AS lab_id, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score, round(domain_score, 6) AS domain_score, round(combined, 6) AS combined_score, rank FROM ok WHERE rank <= 15""",
    "tag_jaccard": f"WITH {_STUDENTS}, {_TAGS} SELECT q AS profile_id, id AS lab_id, shared, round(jaccard, 6) AS jaccard FROM overlap",
    "rerank": f"""WITH {_SCORES}, {_TAGS}, f AS (SELECT q, id, 0.4::DOUBLE * keyword_score + 0.3::DOUBLE * semantic_score + 0.2::DOUBLE * domain_score + 0.1::DOUBLE * coalesce(jaccard, 0) AS final FROM scores LEFT JOIN overlap USING (q, id))
 SELECT q AS profile_id, id AS lab_id, round(final, 6) AS final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(final, 9) DESC, id)::INTEGER AS rank FROM f WHERE final >= 0.1) WHERE rank <= 10""",
    "intro_similarity": f"""WITH p AS (SELECT DISTINCT profile_id, {_plain('intro1')} AS a, {_plain('intro2')} AS b FROM student_profile WHERE intro1 IS NOT NULL AND intro2 IS NOT NULL),
 ta AS (SELECT profile_id, w, count(*) AS n FROM (SELECT profile_id, unnest(a) AS w FROM p) GROUP BY ALL), tb AS (SELECT profile_id, w, count(*) AS n FROM (SELECT profile_id, unnest(b) AS w FROM p) GROUP BY ALL),
 j AS (SELECT coalesce(ta.profile_id, tb.profile_id) AS profile_id, coalesce(ta.n, 0) AS x, coalesce(tb.n, 0) AS y, CASE WHEN ta.n IS NULL OR tb.n IS NULL THEN ln(1.5) + 1 ELSE 1 END AS k FROM ta FULL JOIN tb ON ta.profile_id = tb.profile_id AND ta.w = tb.w)
 SELECT p.profile_id, round(coalesce(any_value(s.t), 0), 6) AS tfidf, round(coalesce(any_value(s.jac), 0), 6) AS jaccard FROM p LEFT JOIN (SELECT profile_id, sum(x * y * k * k) / nullif(sqrt(sum(x * x * k * k) * sum(y * y * k * k)), 0) AS t, count(*) FILTER (x > 0 AND y > 0) / count(*)::DOUBLE AS jac FROM j GROUP BY profile_id) s USING (profile_id) GROUP BY p.profile_id""",
}
