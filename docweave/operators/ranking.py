"""Lexical ranking: BM25, full-text match with cover density, TF-IDF cosine, domain terms, score scaling.

Queries are rows and run many at once. Statistics are counted over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.blocks import meet
from docweave.sources.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_BLOCK = 4_000  # queries that stand together
PART_ROWS = 4_096  # documents that meet a block at a time, where there are several
CELLS = 4_000_000  # scores that a task holds at a time

# Terms of each research domain and its weight.
DOMAINS = {
    "AI/ML": (1.0, ("ai", "인공지능", "artificial intelligence", "machine learning", "머신러닝", "기계학습", "ml", "deep learning", "딥러닝", "심층학습", "dl", "neural network", "신경망", "deep neural")),
    "컴퓨터비전": (1.0, ("computer vision", "컴퓨터 비전", "컴퓨터비전", "cv", "영상처리", "image processing", "이미지 처리", "object detection", "객체 탐지", "객체 검출", "image recognition", "이미지 인식", "영상 인식", "visual", "비전")),
    "로봇/자율주행": (1.0, ("robot", "로봇", "robotics", "로보틱스", "autonomous", "자율주행", "self-driving", "자율 주행", "slam", "navigation", "내비게이션", "spatial")),
    "NLP/대화": (1.0, ("nlp", "natural language", "자연어", "자연어처리", "language model", "언어 모델", "text", "텍스트", "chatbot", "챗봇", "dialogue", "대화", "대화형", "conversational", "speech", "음성")),
    "제어": (0.9, ("control", "제어", "control system", "제어시스템", "optimization", "최적화", "fuzzy")),
    "전력/에너지": (1.0, ("power", "전력", "energy", "에너지", "smart grid", "스마트 그리드", "스마트그리드", "power system", "전력 시스템", "전력망", "microgrid", "마이크로그리드")),
    "반도체": (0.9, ("semiconductor", "반도체", "device", "소자", "vlsi", "ic", "integrated circuit", "집적회로", "transistor", "트랜지스터")),
    "통신/네트워크": (1.0, ("communication", "통신", "network", "네트워크", "5g", "6g", "wireless", "무선", "iot")),
    "신호처리": (0.8, ("signal processing", "신호처리", "신호 처리", "dsp", "filtering", "필터링")),
}


def statistics(listed: DataFrame) -> tuple[DataFrame, float]:
    """(token, idf) over all documents (doc, tokens), and their mean length; one pass over the tokens.

    The inverse document frequency is ln(N - n + .5) - ln(n + .5); where it is negative, a quarter
    of the mean over all tokens stands for it.
    """
    whole = F.lit(None).cast("string")  # stands once in each document and sums the lengths
    held = listed.select(F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("length"), F.explode(F.concat(F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")), F.array(whole))).alias("token"))
    own = F.col("token").isNull()
    counts = cut(held.groupBy("token").agg(F.count("*").alias("df"), F.avg(F.when(own, F.col("length"))).alias("mean_length")))
    total = counts.filter(own).first()
    n, length = (total["df"], total["mean_length"] or 1.0) if total else (0, 1.0)
    raw = counts.filter("token IS NOT NULL").withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf")), float(length)


def bm25_topk(docs: DataFrame, doc: str, doc_tokens: Column, queries: DataFrame, query: str, query_tokens: Column, k: int = 10, block: int = QUERY_BLOCK, part: int = PART_ROWS) -> DataFrame:
    """(query, doc, score, rank): the best k documents of each query by BM25, ties by document; a token that is asked twice counts twice.

    Where many queries share frequent words the pairs outnumber both sides by far. So the queries'
    weights meet the documents in blocks, each task keeps k for each query, and only those are
    shuffled.
    """
    listed = docs.select(F.col(doc).alias("doc"), doc_tokens.alias("tokens"))
    idf, mean_length = statistics(listed)
    asked = queries.select(F.col(query).alias("query"), F.explode(query_tokens).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))
    weights = cut(asked.join(idf, "token").select("query", "token", (F.col("times") * F.col("idf")).alias("weight")))  # counted and read
    n = weights.agg(F.countDistinct("query").alias("n")).first()["n"]
    schema = f"query {weights.schema['query'].dataType.simpleString()}, doc {listed.schema['doc'].dataType.simpleString()}, score double"
    found = meet(listed, "doc", weights, "query", _bm25_block(mean_length, k), schema, n, block, part)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _bm25_block(mean_length: float, k: int):
    def run(rows: pd.DataFrame, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, place = np.unique(rows["query"].to_numpy(), return_inverse=True)
        weights = rows["weight"].to_numpy()
        of_token = {t: (place[at], weights[at]) for t, at in rows.groupby("token").indices.items()}
        step = max(64, CELLS // len(names))
        best = None
        for pdf in frames:
            for a in range(0, len(pdf), step):
                some = pdf.iloc[a : a + step]
                held: dict[str, tuple[list[int], list[float]]] = {}
                for j, tokens in enumerate(some["tokens"]):
                    if tokens is None or len(tokens) == 0:
                        continue
                    norm = K1 * (1 - B + B * len(tokens) / mean_length)
                    for t, tf in Counter(tokens).items():
                        if t in of_token:
                            cell = held.setdefault(t, ([], []))
                            cell[0].append(j)
                            cell[1].append(tf * (K1 + 1) / (tf + norm))
                score = np.zeros((len(names), len(some)))
                met = np.zeros(score.shape, dtype=bool)
                for t, (js, parts) in held.items():
                    q, weight = of_token[t]
                    at = np.ix_(q, js)
                    score[at] += np.outer(weight, parts)
                    met[at] = True
                score = np.where(met, np.round(score, 12), -np.inf)
                keep = min(k, score.shape[1])
                floor = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                q, c = np.nonzero((score >= np.round(floor, 9)[:, None] - 1e-9) & met)
                found = pd.DataFrame({"query": names[q], "doc": some["doc"].to_numpy()[c], "score": score[q, c]})
                best = found if best is None else pd.concat([best, found])
                if len(best) > 4 * k * len(names):
                    best = _best(best, k)
        if best is not None:
            yield _best(best, k)

    return run


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.assign(rounded=rows["score"].round(9)).sort_values(["query", "rounded", "doc"], ascending=[True, False, True])
    return rows.groupby("query", sort=False).head(k).drop(columns="rounded")


def cover_density(docs: DataFrame, doc: str, tokens: Column, terms: list[str]) -> DataFrame:
    """(doc, score) of the documents that hold all ``terms``: each shortest stretch with all terms adds 1 / its length."""
    terms = list(dict.fromkeys(terms))
    held = docs.select(F.col(doc).alias("doc"), tokens.alias("tokens")).filter(reduce(lambda a, b: a & b, [F.array_contains("tokens", t) for t in terms]))
    spots = held.select("doc", F.posexplode("tokens").alias("at", "token")).filter(F.col("token").isin(terms)).distinct()
    before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("token") == t, F.col("at"))).over(before) for t in terms]
    full = spots.select("doc", "at", F.array(*last).alias("lasts")).filter(~F.exists("lasts", lambda x: x.isNull())).withColumn("start", F.array_min("lasts"))
    shortest = full.groupBy("doc", "start").agg(F.min("at").alias("end"))
    return shortest.groupBy("doc").agg(F.sum(F.lit(1.0) / (F.col("end") - F.col("start") + 1)).alias("score"))


def covers(spots: dict[str, list[int]], terms: list[str]) -> float:
    """The sum over all shortest stretches with all ``terms`` of 1 / their length; ``spots`` has the places of each token, in order."""
    last: dict[str, int] = {}
    ends: dict[int, int] = {}
    for at, t in sorted((at, t) for t in terms for at in spots[t]):
        last[t] = at
        if len(last) == len(terms):
            ends.setdefault(min(last.values()), at)
    return sum(1.0 / (end - start + 1) for start, end in ends.items())


def search_topk(docs: DataFrame, queries: DataFrame, key: str, tokens: Column, terms: Column, k: int, vec: str | None = None, word_weight: float = 1.0, vec_weight: float = 0.0, block: int = QUERY_BLOCK, part: int = PART_ROWS) -> DataFrame:
    """(query, doc, score, vector_score, keyword_score, rank): the best k of ``docs`` for each of ``queries``; ties by document.

    Both have the id ``key``; the keyword score is the cover density of all the query's ``terms``
    in a document's ``tokens``, the vector score the cosine of ``vec``, 0 where a side has none. Only
    documents that hold all terms or have a cosine are found, and a query does not find itself.
    Queries meet the documents in blocks; a document meets those queries whose rarest term it holds,
    and each task keeps k for each query, so pairs are never shuffled.
    """
    none = F.lit(None).cast("array<double>")
    listed = docs.select(F.col(key).alias("doc"), tokens.alias("tokens"), (F.col(vec) if vec else none).alias("vec"))
    asked = queries.select(F.col(key).alias("query"), F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))).alias("terms"), (F.col(vec) if vec else none).alias("vec"))
    words = asked.select(F.explode("terms").alias("token")).distinct()
    held = listed.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(words, "token", "right")
    rarest = asked.select("query", F.explode("terms").alias("token")).join(held, "token").groupBy("query").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("rarest"))
    asked = cut(asked.join(rarest, "query", "left"))  # counted and read
    kind = listed.schema["doc"].dataType.simpleString()
    schema = f"query {kind}, doc {kind}, score double, vector_score double, keyword_score double"
    found = meet(listed, "doc", asked, "query", _search_block(k, word_weight, vec_weight), schema, asked.count(), block, part)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(vectors: pd.Series) -> tuple[np.ndarray | None, np.ndarray]:
    """Vectors of length 1, zeros where there is none, and which there are; None if there are none at all."""
    there = vectors.notna().to_numpy()
    if not there.any():
        return None, there
    some = np.array([np.asarray(v, dtype=np.float64) for v in vectors[there]])
    n = np.linalg.norm(some, axis=1, keepdims=True)
    m = np.zeros((len(vectors), some.shape[1]))
    m[there] = some / np.where(n > 0, n, 1.0)
    return m, there


def _search_block(k: int, word_weight: float, vec_weight: float):
    def run(rows: pd.DataFrame, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = rows["query"].to_numpy()
        mine, asks = _unit(rows["vec"])
        alike: dict[tuple[str, ...], list[int]] = {}  # queries of the same terms are matched once
        by_rarest: dict[str, set[tuple[str, ...]]] = {}
        for i, (terms, rarest) in enumerate(zip(rows["terms"], rows["rarest"])):
            if len(terms):
                terms = tuple(sorted(terms))
                alike.setdefault(terms, []).append(i)
                by_rarest.setdefault(rarest, set()).add(terms)
        step = max(64, CELLS // len(names))
        best = None
        for pdf in frames:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                own = part["doc"].to_numpy()
                word = np.zeros((len(names), len(part)))
                for j, tokens in enumerate(part["tokens"]):
                    spots: dict[str, list[int]] = {}
                    for at, t in enumerate(tokens if tokens is not None else ()):
                        spots.setdefault(t, []).append(at)
                    for t in spots.keys() & by_rarest.keys():
                        for terms in by_rarest[t]:
                            if all(x in spots for x in terms):
                                word[alike[terms], j] = covers(spots, list(terms))
                theirs, has = _unit(part["vec"])
                met = word > 0
                cosine = np.zeros(word.shape)
                if mine is not None and theirs is not None:
                    cosine = mine @ theirs.T
                    met |= asks[:, None] & has[None, :]
                met &= names[:, None] != own[None, :]
                score = np.where(met, word_weight * word + vec_weight * cosine, -np.inf)
                keep = min(k, score.shape[1])
                floor = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                q, c = np.nonzero((score >= floor[:, None] - 2e-9) & met)
                found = pd.DataFrame({"query": names[q], "doc": own[c], "score": score[q, c], "vector_score": cosine[q, c], "keyword_score": word[q, c]})
                best = found if best is None else pd.concat([best, found])
                if len(best) > 4 * k * len(names):
                    best = _best(best, k)
        if best is not None:
            yield _best(best, k)

    return run


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays as a corpus of two: a shared word weighs 1, any other ln(1.5) + 1."""
    weight = F.log(F.lit(1.5)) + 1.0
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t)).cast("double")
    both = F.array_intersect(a, b)
    shared = F.aggregate(both, F.lit(0.0), lambda s, t: s + count(a, t) * count(b, t))
    square = lambda arr, other: F.aggregate(F.array_distinct(arr), F.lit(0.0), lambda s, t: s + F.when(F.array_contains(other, t), count(arr, t) * count(arr, t)).otherwise(count(arr, t) * count(arr, t) * weight * weight))
    n = F.sqrt(square(a, b) * square(b, a))
    return F.when(n > 0, shared / n).otherwise(0.0)


def domains_of(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(lambda x, y: x | y, [low.contains(t) for t in terms]), F.lit(k)) for k, (_, terms) in DOMAINS.items()]))


def domain_hits(text: Column) -> Column:
    """How many terms of each domain stand in a text, as an array in the order of DOMAINS; computed once for each text, not for each pair."""
    low = F.lower(text)
    return F.array(*[reduce(lambda x, y: x + y, [low.contains(t).cast("int") for t in terms]) for _, terms in DOMAINS.values()])


def domain_score(query_hits: Column, text_hits: Column) -> Column:
    """Mean over the domains that both texts touch of three times the share of the domain's terms, one at most, by weight."""
    both = [(query_hits[i] > 0) & (text_hits[i] > 0) for i in range(len(DOMAINS))]
    n = reduce(lambda a, b: a + b, [x.cast("int") for x in both])
    parts = [F.when(x, F.least(text_hits[i] * 3.0 / len(terms), F.lit(1.0)) * weight).otherwise(0.0) for i, (x, (weight, terms)) in enumerate(zip(both, DOMAINS.values()))]
    return F.when(n > 0, F.least(reduce(lambda a, b: a + b, parts) / n, F.lit(1.0))).otherwise(0.0)


def masked_scaled(score: Column, group: str, threshold: float = 0.70) -> Column:
    """Scores from the threshold on between their least and greatest; one value alone gives .5, below it 0."""
    w = Window.partitionBy(group)
    x = F.when(score >= threshold, score)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull(), 0.0).when(high - low < 1e-8, 0.5).otherwise((x - low) / (high - low))


def combined(keyword: Column, semantic: Column, domain: Column, keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> Column:
    """Keyword and meaning weighted; a clear domain match outweighs the keyword score."""
    effective = F.when(domain > 0.3, domain * 0.7 + keyword * 0.3).otherwise(keyword)
    return effective * keyword_weight + semantic * semantic_weight


def relevant(query_hits: Column, text_hits: Column, score: Column) -> Column:
    """False where both sides name domains, none is shared and the score is below .8."""
    some = lambda hits: F.array_max(hits) > 0
    shared = F.array_max(F.zip_with(query_hits, text_hits, lambda a, b: F.least(a, b))) > 0
    return ~(some(query_hits) & some(text_hits) & ~shared & (score < 0.8))


def weighted_sum(scores: dict[str, float]) -> Column:
    """Weighted sum of score columns by name; a missing score counts 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in scores.items()])
