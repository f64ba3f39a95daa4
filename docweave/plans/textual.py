"""Text and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import quality, text
from docweave.sources.tables import load


def _docs(spark, d, *columns):
    return load(spark, d, "lab_docs", ["doc_id", *columns])


def _once(df, *more):
    """Rows that stand twice count once: told from the narrow result, so that no text is shuffled for it."""
    return df.dropDuplicates(["doc_id", *more])


def detect_language(spark, d):
    t = F.col("text")
    docs = load(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.language(t).alias("language"), F.round(text.hangul(t) / F.length(t), 6).alias("hangul_share"), F.round(text.latin(t) / F.length(t), 6).alias("latin_share"), F.length(t).cast("long").alias("n_chars"))


def extract_contacts(spark, d):
    docs = load(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.array_join(text.emails(F.col("text")), " ").alias("emails"), F.array_join(text.urls(F.col("text")), " ").alias("urls"), F.array_join(text.phones(F.col("text")), " ").alias("phones"))


def clean_text(spark, d):
    return _once(_docs(spark, d, "text").select("doc_id", text.clean(F.col("text")).alias("cleaned")))


def strip_numbering(spark, d):
    return _once(_docs(spark, d, "text").select("doc_id", F.md5(text.without_numbering(F.col("text"))).alias("unnumbered_md5"), F.md5(text.without_signs(F.col("text"))).alias("unsigned_md5")))


def token_estimate(spark, d):
    t = F.col("text")
    return load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", text.token_estimate(t, text.language(t)).alias("tokens"), text.chunk_tokens(t).alias("chunk_tokens"), F.size(text.word_tokens(t)).alias("words"))


def stopword_tokens(spark, d):
    p = load(spark, d, "student_profile", ["profile_id", "research_interests", "portfolio"], once=True)
    return p.select("profile_id", F.array_join(text.search_tokens(F.col("research_interests")), " ").alias("search_tokens"), F.array_join(text.plain_tokens(F.col("portfolio")), " ").alias("plain_tokens"))


def section_classify(spark, d):
    return _once(_docs(spark, d, "text", "source_url").select("doc_id", text.section(F.col("text"), F.regexp_extract("source_url", r"^https?://[^/]+(.*)$", 1)).alias("section_found")))


def heading_lines(spark, d):
    lines = _docs(spark, d, "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return _once(lines.filter((F.col("line") != "") & text.is_heading(F.col("line"))).select("doc_id", (F.col("at") + 1).cast("int").alias("line_no"), "line"), "line_no")


def paragraphs(spark, d):
    return load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("at", "paragraph")).select("doc_id", F.col("at").cast("int").alias("paragraph_no"), F.length("paragraph").cast("long").alias("n_chars"), F.md5("paragraph").alias("md5"))


def url_exclusion(spark, d):
    links = load(spark, d, "lab_link", ["lab_id", "url"]).unionByName(load(spark, d, "documents", ["doc_id", "url"]).select(F.col("doc_id").alias("lab_id"), "url"))
    found = quality.excluded_by(F.col("url"))
    return links.filter("url IS NOT NULL").select("lab_id", "url", found.isNotNull().alias("excluded"), found.alias("pattern"))


def pii_keywords(spark, d):
    found = quality.pii_keywords(F.col("text"))
    return _once(_docs(spark, d, "text").select("doc_id", F.size(found).alias("n_hits"), F.array_join(found, ",").alias("hits")))


def quality_report(spark, d):
    """Quality of each page. Texts are scored where they are read; only ids, hashes and scores meet the counts of equal texts."""
    docs = _docs(spark, d, "text", "section", "md5")
    sec, t = F.lower(F.trim("section")), F.col("text")
    scored = _once(docs.select("doc_id", "md5", quality.section_score(t, sec).alias("section_score"), quality.length_score(F.length(t)).alias("length_score"), quality.language_score(t).alias("language_score")))
    copies = scored.groupBy("md5").agg(F.count("*").alias("copies"))
    # Nearly all texts stand alone: only hashes of several pages are joined, dealt by page where one is frequent.
    many = copies.filter("copies > 1 AND md5 IS NOT NULL").select("md5", "copies", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("deal"))
    dealt = scored.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    held = dealt.join(many, ["md5", "deal"], "left").withColumn("duplicate_score", quality.duplicate_score(F.coalesce("copies", F.lit(1))))
    c = [F.col(x) for x in ("section_score", "length_score", "language_score", "duplicate_score")]
    total = quality.overall(*c)
    return held.select("doc_id", *[F.round(x, 6).alias(n) for x, n in zip(c, ("section_score", "length_score", "language_score", "duplicate_score"))], F.round(total, 6).alias("overall_score"), (total < 0.5).alias("needs_review"), quality.reasons(*c, total < 0.5).alias("reason"))


def ingest_quality(spark, d):
    docs = _docs(spark, d, "lab_id", "text", "title")
    t = text.clean(F.col("text"))
    scored = docs.withColumn("t", t).withColumn("lang", text.language(F.col("t")))
    return _once(scored.select("doc_id", "lang", quality.ingest_score(F.length("t"), F.col("lang"), text.token_estimate(F.col("t"), F.col("lang")), F.col("title")).alias("quality")))


def site_quality(spark, d):
    pages = _docs(spark, d, "lab_id").groupBy("lab_id").agg(F.countDistinct("doc_id").alias("pages"))
    labs = load(spark, d, "lab", ["lab_id"], once=True)
    return labs.join(pages, "lab_id", "left").select("lab_id", quality.site_score(F.coalesce("pages", F.lit(0))).alias("site_score"))


def md5_fingerprint(spark, d):
    return _once(_docs(spark, d, "text", "md5").select("doc_id", F.md5("text").alias("text_md5"), (F.md5("text") == F.col("md5")).alias("agrees")))


QUERIES = {f.__name__: f for f in (detect_language, extract_contacts, clean_text, strip_numbering, token_estimate, stopword_tokens, section_classify, heading_lines, paragraphs, url_exclusion, pii_keywords, quality_report, ingest_quality, site_quality, md5_fingerprint)}


# The same in SQL, written from the rules rather than from the plans above.
def _n(t: str, cls: str) -> str:
    return f"length(regexp_replace({t}, '[^{cls}]', '', 'g'))"


def _count(t: str, p: str) -> str:
    return f"len(regexp_extract_all({t}, '{p}'))"


def _lang(t: str) -> str:
    ko, en = f"{_n(t, '가-힣')} / length({t})::DOUBLE", f"{_n(t, 'a-zA-Z')} / length({t})::DOUBLE"
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'unknown' WHEN {ko} > 0.4 THEN 'ko' WHEN {en} > 0.6 THEN 'en' WHEN {ko} > 0.1 OR {en} > 0.1 THEN 'mixed' ELSE 'unknown' END"


def _tokens(t: str, lang: str) -> str:
    h = _n(t, "가-힣")
    mixed = f"greatest(floor({h} * 1.5 + {_count(t, '[a-zA-Z]+')} * 0.25 + {_count(t, '[0-9]+')} * 0.3::DOUBLE), floor(length({t}) / 4))"
    return f"(CASE {lang} WHEN 'ko' THEN floor({h} * 1.5 + (length({t}) - {h}) * 0.5) WHEN 'en' THEN floor({_count(t, '[A-Za-z0-9_]+')} * 0.25) ELSE {mixed} END)::INTEGER"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, '{_q(x)}')" for x in terms) + ")"


def _hits(t: str, terms) -> str:
    return "(" + " + ".join(f"contains({t}, '{_q(x)}')::INTEGER" for x in terms) + ")"


_DOCS = "docs AS (SELECT DISTINCT ON (doc_id) * FROM lab_docs)"
_WS = "chr(32) || chr(10) || chr(13) || chr(9)"


def _clean(t: str) -> str:
    for p in text.COPYRIGHT + text.NAVIGATION:
        t = f"regexp_replace({t}, '{p}', '', 'gi')"
    return f"trim(replace(regexp_replace(regexp_replace({t}, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(9), ' '), {_WS})"


_SECTION = "CASE " + " ".join(f"WHEN {_any('u', terms)} THEN '{k}'" for k, terms in text.SECTION_BY_URL.items()) + " " + " ".join(f"WHEN {_any('t', terms)} THEN '{k}'" for k, terms in text.SECTION_BY_TEXT.items()) + " ELSE 'general' END"
_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
_SECTION_SCORE = "CASE lower(trim(section)) " + " ".join(f"WHEN '{k}' THEN least({_hits('lower(text)', w)} * 2.0::DOUBLE / {len(w)}, 1.0::DOUBLE)" for k, w in quality.SECTION_WORDS.items()) + " ELSE 0.5::DOUBLE END"

ORACLES = {
    "detect_language": f"SELECT doc_id, {_lang('text')} AS language, round({_n('text', '가-힣')} / length(text)::DOUBLE, 6) AS hangul_share, round({_n('text', 'a-zA-Z')} / length(text)::DOUBLE, 6) AS latin_share, length(text) AS n_chars FROM documents",
    "extract_contacts": rf"""SELECT doc_id,
 array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '{text.EMAIL}'), lambda x: lower(x))), lambda x: length(x) < 100)), ' ') AS emails,
 array_to_string(list_sort(list_filter(list_transform(list_distinct(regexp_extract_all(text, '{text.URL}')), lambda x: rtrim(x, '.,;:)')), lambda x: length(x) < 500)), ' ') AS urls,
 array_to_string(list_sort(list_filter(list_distinct(list_concat(list_concat(regexp_extract_all(text, '{text.PHONES[0]}'), regexp_extract_all(text, '{text.PHONES[1]}')), regexp_extract_all(text, '{text.PHONES[2]}'))), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 11)), ' ') AS phones
 FROM documents""",
    "clean_text": f"WITH {_DOCS} SELECT doc_id, {_clean('text')} AS cleaned FROM docs",
    "strip_numbering": rf"""WITH {_DOCS} SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^[0-9]+\.[ \t]+', '', 'g'), '(?m)^[IVX]+\.[ \t]+', '', 'g')) AS unnumbered_md5,
 md5(regexp_replace(text, '[^A-Za-z0-9\s.,!?;:()\-''"\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS unsigned_md5 FROM docs""",
    "token_estimate": rf"""SELECT doc_id, {_tokens('text', '(' + _lang('text') + ')')} AS tokens,
 floor({_n('text', '가-힣')} * 1.5 + {_count('text', '[a-zA-Z]+')} * 0.25 + (length(text) - {_n('text', '가-힣')} - length(regexp_replace(text, '[^a-zA-Z \t\n\r]', '', 'g'))) * 0.5)::INTEGER AS chunk_tokens,
 len(list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda x: x <> ''))::INTEGER AS words FROM documents""",
    "stopword_tokens": rf"""SELECT profile_id, array_to_string(list_filter(regexp_split_to_array(lower(research_interests), '[ \n\r\t]+'), lambda x: x <> '' AND x NOT IN {_STOP}), ' ') AS search_tokens,
 array_to_string(list_filter(list_transform(regexp_split_to_array(lower(portfolio), '[ \n\r\t]+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda x: x <> ''), ' ') AS plain_tokens
 FROM (SELECT DISTINCT * FROM student_profile)""",
    "section_classify": f"WITH {_DOCS} SELECT doc_id, {_SECTION} AS section_found FROM (SELECT doc_id, lower(text) AS t, lower(coalesce(regexp_extract(source_url, '^https?://[^/]+(.*)$', 1), '')) AS u FROM docs)",
    "heading_lines": rf"""WITH {_DOCS}, p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1))::INTEGER AS line_no FROM p)
 SELECT doc_id, line_no, line FROM l WHERE line <> '' AND length(line) < 100 AND (line LIKE '%:' OR regexp_matches(line, '^[0-9]+\.?[ \t]') OR (upper(line) = line AND lower(line) <> line))""",
    "paragraphs": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM documents),
 u AS (SELECT doc_id, unnest(ps) AS paragraph, unnest(range(0, len(ps)))::INTEGER AS paragraph_no FROM p) SELECT doc_id, paragraph_no, length(paragraph) AS n_chars, md5(paragraph) AS md5 FROM u""",
    "url_exclusion": "WITH x AS (SELECT lab_id, url FROM lab_link UNION ALL SELECT doc_id, url FROM documents) SELECT lab_id, url, p IS NOT NULL AS excluded, p AS pattern FROM (SELECT lab_id, url, CASE "
    + " ".join(f"WHEN regexp_matches(lower(url), '{_q(p)}') THEN '{_q(p)}'" for p in quality.EXCLUDED_URLS)
    + " END AS p FROM x WHERE url IS NOT NULL)",
    "pii_keywords": f"WITH {_DOCS} SELECT doc_id, len(h)::INTEGER AS n_hits, array_to_string(h, ',') AS hits FROM (SELECT doc_id, list_filter([" + ", ".join(f"'{k}'" for k in quality.PII_KEYWORDS) + "], lambda k: contains(lower(text), k)) AS h FROM docs)",
    "quality_report": f"""WITH {_DOCS}, s AS (SELECT doc_id, {_SECTION_SCORE} AS a,
 CASE WHEN length(text) BETWEEN 200 AND 400 THEN 1.0 WHEN length(text) BETWEEN 150 AND 500 THEN 0.8 WHEN length(text) BETWEEN 100 AND 600 THEN 0.6 ELSE 0.3 END::DOUBLE AS b,
 {_n('text', '가-힣')} AS h, {_n('text', 'a-zA-Z')} AS e, CASE WHEN md5 IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY md5) END AS n FROM docs),
 r AS (SELECT doc_id, a, b, CASE WHEN h + e = 0 THEN 0.5 WHEN greatest(h, e) / (h + e)::DOUBLE >= 0.8 THEN 1.0 WHEN greatest(h, e) / (h + e)::DOUBLE >= 0.6 THEN 0.8 ELSE 0.6 END::DOUBLE AS c,
 CASE WHEN n <= 1 THEN 1.0 WHEN n = 2 THEN 0.5 ELSE 0 END::DOUBLE AS d FROM s), o AS (SELECT *, a * 0.3::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE + d * 0.2::DOUBLE AS t FROM r)
 SELECT doc_id, round(a, 6) AS section_score, round(b, 6) AS length_score, round(c, 6) AS language_score, round(d, 6) AS duplicate_score, round(t, 6) AS overall_score, t < 0.5 AS needs_review,
 CASE WHEN t >= 0.5 THEN '' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN a < 0.5 THEN '섹션 불일치' END, CASE WHEN b < 0.5 THEN '길이 부적절' END, CASE WHEN c < 0.5 THEN '언어 불일관' END, CASE WHEN d < 0.5 THEN '중복 발견' END), ''), '복합 요인') END AS reason FROM o""",
    "ingest_quality": f"""WITH {_DOCS}, c AS (SELECT doc_id, title, {_clean('text')} AS t FROM docs), l AS (SELECT *, {_lang('t')} AS lang FROM c)
 SELECT doc_id, lang, least(50 + CASE WHEN length(t) > 500 THEN 20 WHEN length(t) > 300 THEN 10 ELSE 0 END + CASE WHEN lang IN ('ko', 'en') THEN 15 ELSE 0 END + CASE WHEN {_tokens('t', 'lang')} > 100 THEN 10 ELSE 0 END
 + CASE WHEN title <> '' THEN 5 ELSE 0 END, 100)::INTEGER AS quality FROM l""",
    "site_quality": f"WITH {_DOCS} SELECT l.lab_id, (CASE WHEN n > 0 THEN 30 ELSE 0 END + CASE WHEN n >= 5 THEN 40 WHEN n >= 2 THEN 20 ELSE 0 END)::INTEGER AS site_score FROM (SELECT DISTINCT lab_id FROM lab) l LEFT JOIN (SELECT lab_id, count(*) AS n FROM docs GROUP BY 1) p USING (lab_id)",
    "md5_fingerprint": f"WITH {_DOCS} SELECT doc_id, md5(text) AS text_md5, md5(text) = md5 AS agrees FROM docs",
}
