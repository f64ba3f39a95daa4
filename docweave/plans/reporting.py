"""Reporting and store queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import vectors
from docweave.operators import reports, store
from docweave.sources.tables import load

PROFILE_FIELDS = ["major", "certifications", "awards", "tech_stack", "toeic_score", "gpa"]
CUT = "2024-06-01 00:00:00"


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return load(spark, d, "lab_docs", ["doc_id", *columns], once=True)


def lab_stats(spark, d):
    return reports.lab_stats(load(spark, d, "lab", once=True), _docs(spark, d, "lab_id", "section", "quality_score"), load(spark, d, "lab_tag", once=True), load(spark, d, "lab_link"))


def section_distribution(spark, d):
    return reports.section_distribution(_docs(spark, d, "section", "tokens", "quality_score"))


def active_labs_summary(spark, d):
    return reports.active_summary(load(spark, d, "lab", once=True), _docs(spark, d, "lab_id", "quality_score", "embedding"))


def crawl_statistics(spark, d):
    return reports.crawl_statistics(load(spark, d, "crawl_log", once=True))


def store_stats(spark, d):
    return reports.store_stats(_docs(spark, d, "section", "lang", "quality_score"))


def docs_per_lab(spark, d):
    return reports.docs_per_lab(load(spark, d, "lab", ["lab_id"], once=True), _docs(spark, d, "lab_id"))


def tags_by_type(spark, d):
    return reports.tags_by_type(load(spark, d, "lab_tag", once=True))


def crawl_summary(spark, d):
    return reports.crawl_summary(load(spark, d, "crawl_log", once=True))


def crawl_response(spark, d):
    return reports.median_response(load(spark, d, "crawl_log", once=True))


def duplicate_texts(spark, d):
    docs = _docs(spark, d, "lab_id", "md5")
    many = docs.groupBy("lab_id", "md5").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept_doc_id"))
    return docs.join(many.filter("copies > 1"), ["lab_id", "md5"]).select("doc_id", "lab_id", "md5", "copies", "kept_doc_id")


def _split(spark, d):
    docs = _docs(spark, d, "lab_id", "md5", "created_at")
    at = F.lit(CUT).cast("timestamp_ntz")
    return docs.filter(F.col("created_at") < at), docs.filter(F.col("created_at") >= at)


def duplicate_check(spark, d):
    old, new = _split(spark, d)
    return store.is_stored(new, old, ["lab_id", "md5"]).select("doc_id", "lab_id")


def insert_new_docs(spark, d):
    old, new = _split(spark, d)
    return store.insert_new(new, old, ["lab_id", "md5"], ["created_at", "doc_id"]).select("doc_id", "lab_id", "md5")


def insert_new_labs(spark, d):
    labs = load(spark, d, "lab", ["lab_id", "kor_name", "created_at"], once=True).filter("kor_name IS NOT NULL")
    ids = labs.groupBy("kor_name").agg(F.min_by("lab_id", F.struct("created_at", "lab_id")).alias("stored_id"))
    return labs.join(ids, "kor_name").select("lab_id", "kor_name", "stored_id")


def _submissions(spark, d):
    p = load(spark, d, "student_profile", ["profile_id", "student_id", *PROFILE_FIELDS, "updated_at"], once=True)
    first = p.groupBy("student_id").agg(F.min_by(F.struct(*PROFILE_FIELDS), F.struct("profile_id")).alias("x")).select("student_id", "x.*")
    last = p.groupBy("student_id").agg(F.max_by(F.struct(*PROFILE_FIELDS), F.struct("profile_id")).alias("x")).select("student_id", "x.*")
    return first, last


def profile_changes(spark, d):
    first, last = _submissions(spark, d)
    return store.diff(first, last, "student_id", PROFILE_FIELDS)


def profile_upsert(spark, d):
    first, last = _submissions(spark, d)
    return store.upsert(first, last, "student_id", PROFILE_FIELDS)


def snapshot_changes(spark, d):
    labs = load(spark, d, "lab", ["lab_id", "contact_email", "contact_phone", "homepage", "created_at"], once=True)
    seen = load(spark, d, "crawl_log", ["lab_id"]).distinct()
    return store.diff(labs.drop("created_at"), labs.join(seen, "lab_id", "left_semi").withColumn("homepage", F.regexp_replace("homepage", "/+$", "")).drop("created_at"), "lab_id", ["contact_email", "contact_phone", "homepage"])


def cache_lookup(spark, d):
    log = load(spark, d, "crawl_log", ["log_id", "lab_id", "request_time", "success"], once=True)
    return store.cache_lookup(log, "lab_id", "request_time", F.col("success")).select("log_id", "lab_id", "cached_at", "age_s", "hit")


def soft_delete(spark, d):
    gone = load(spark, d, "lab_link", ["lab_id", "url", "is_active"])
    return gone.withColumn("is_active", F.coalesce("is_active", F.lit(True)) & ~F.col("url").startswith("http://"))


def misses_to_fetch(spark, d):
    """Labs whose latest success is older than a week at the last request: to be fetched again."""
    log = load(spark, d, "crawl_log", ["log_id", "lab_id", "request_time", "success"], once=True)
    now = log.agg(F.max("request_time").alias("now"))
    fresh = log.filter("success").join(F.broadcast(now)).filter("request_time >= now - INTERVAL 7 DAYS")
    return store.to_fetch(load(spark, d, "lab", ["lab_id"], once=True), fresh, "lab_id")


def crawl_status_update(spark, d):
    """The lab table after a crawl: homepage cleared where no request ever succeeded, time of the last request set on labs that were crawled."""
    labs = load(spark, d, "lab", ["lab_id", "homepage", "created_at"], once=True)
    seen = load(spark, d, "crawl_log", ["log_id", "lab_id", "request_time", "success"], once=True).groupBy("lab_id").agg(F.max(F.when(F.col("success"), F.col("request_time"))).alias("at"), F.max("request_time").alias("created_at"))
    changes = seen.join(labs.select("lab_id", "homepage"), "lab_id").withColumn("homepage", F.when(F.col("at").isNotNull(), F.col("homepage")))
    return store.changed(labs, changes, "lab_id", ["homepage", "created_at"])


def profile_clear(spark, d):
    """Submissions with the language score taken out where a later one of the student has one, and stamped."""
    p = load(spark, d, "student_profile", ["profile_id", "student_id", "toeic_score", "updated_at"], once=True)
    last = p.filter("toeic_score IS NOT NULL").groupBy("student_id").agg(F.max("profile_id").alias("last"))
    gone = p.join(last, "student_id").filter("profile_id < last").select("profile_id", F.lit(None).cast("string").alias("toeic_score"))
    return store.changed(p, gone, "profile_id", ["toeic_score"], F.lit(CUT).cast("timestamp_ntz"))


def soft_delete_by_id(spark, d):
    """Links of labs without any page switched off."""
    links = load(spark, d, "lab_link", ["lab_id", "url", "is_active"])
    empty = load(spark, d, "lab", ["lab_id"], once=True).join(load(spark, d, "lab_docs", ["lab_id"]), "lab_id", "left_anti")
    return store.switched_off(links, empty, "lab_id")


def name_lookup(spark, d):
    """Labs by either name: each distinct name with the ids that bear it."""
    labs = load(spark, d, "lab", ["lab_id", "kor_name", "eng_name"], once=True)
    names = labs.select("lab_id", F.explode(F.array_distinct(F.array(F.lower(F.trim("kor_name")), F.lower(F.trim("eng_name"))))).alias("name")).filter("name IS NOT NULL AND name <> ''")
    return names.groupBy("name").agg(F.count("*").alias("labs"), F.min("lab_id").alias("first_lab_id"))


def parsed_scores(spark, d):
    """Numbers out of text or null, a preview of the portfolio, the fields as JSON, and one of them by name with a default."""
    p = load(spark, d, "student_profile", ["profile_id", "toeic_score", "gpa", "portfolio", "major"], once=True)
    kept = F.filter(F.array(F.struct(F.lit("major").alias("k"), F.col("major").alias("v"))), lambda x: x["v"].isNotNull())
    by_name = F.map_from_entries(kept)
    return p.select(
        "profile_id", F.expr("try_cast(trim(toeic_score) AS INT)").alias("toeic"), F.expr("try_cast(split_part(trim(gpa), '/', 1) AS DOUBLE)").alias("gpa"),
        F.when(F.length("portfolio") > 50, F.concat(F.substring("portfolio", 1, 50), F.lit("..."))).otherwise(F.col("portfolio")).alias("preview"), F.coalesce(F.element_at(by_name, "major"), F.lit("-")).alias("major_or"),
    )


def unit_vectors(spark, d):
    """Stored vectors at unit length, one row for each number, and the page's quality between 30 and 90."""
    docs = _docs(spark, d, "embedding", "quality_score").filter("embedding IS NOT NULL")
    return docs.select("doc_id", F.round(vectors.clamp01(F.col("quality_score").cast("double"), F.lit(30.0), F.lit(90.0)), 6).alias("quality"), F.posexplode(vectors.normalised(F.col("embedding"))).alias("dim", "x")).select("doc_id", "quality", "dim", F.round("x", 6).alias("x"))


def vectors_from_provider(spark, d):
    """Missing vectors made by a provider (here: counts of the text's letters by remainder, no model), once for each distinct text."""
    docs = _docs(spark, d, "title", "embedding").filter("embedding IS NULL")
    made = store.filled(docs, "doc_id", "title", "embedding", lambda texts: [[sum(ord(c) % 4 == i for c in t) for i in range(4)] for t in texts], 4)
    return made.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("made"))


def packed_append_remove(spark, d):
    p = load(spark, d, "student_profile", ["profile_id", "certifications", "major"], once=True)
    return p.select("profile_id", store.append_item(F.col("certifications"), F.col("major")).alias("appended"), store.remove_item(F.col("certifications"), F.element_at(F.transform(F.split(F.coalesce("certifications", F.lit("")), ","), lambda x: F.trim(x)), 1)).alias("removed"))


def no_website(spark, d):
    return load(spark, d, "lab", ["lab_id", "homepage"], once=True).select("lab_id", (F.coalesce(F.trim("homepage"), F.lit("")).isin("", "해당없음", "없음", "-", "N/A", "none")).alias("no_website"))


def _visits(spark, d, budget=None):
    """The pages of each lab in the order of their visit, all of them unless there is a budget."""
    from pyspark.sql import Window

    links = load(spark, d, "lab_link", ["lab_id", "url"]).groupBy("lab_id", F.regexp_replace("url", r"^https?://(www\.)?", "").alias("page")).agg(F.count("*").alias("spellings"))
    w = Window.partitionBy("lab_id").orderBy("page")
    visits = links.withColumn("crawl_depth", (F.row_number().over(w) - 1).cast("int"))
    return visits if budget is None else visits.filter(F.col("crawl_depth") < budget)


def crawl_visit_order(spark, d):
    return _visits(spark, d, 5)


def crawl_visit_order_all(spark, d):
    return _visits(spark, d)


def linked_or_tagged(spark, d):
    a = load(spark, d, "lab_link", ["lab_id", "kind"]).select("lab_id", F.lower("kind").alias("label"))
    b = load(spark, d, "lab_tag", ["lab_id", "tag_type"]).select("lab_id", F.lower(F.trim("tag_type")).alias("label"))
    return a.unionByName(b).distinct()


def search_log(spark, d):
    from pyspark.sql import Window

    ev = load(spark, d, "events", ["event_id", "ts", "event_type", "value"]).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day", "event_type").orderBy(F.desc("value"), "event_id")
    best = ev.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")  # five rows of each group are kept before the shuffle
    ids = best.groupBy("day", "event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("top_ids"))
    return ev.groupBy("day", "event_type").agg(F.count("*").alias("results_count"), F.round(F.avg("value"), 6).alias("avg_score")).join(ids, ["day", "event_type"])


def recent_performance(spark, d):
    ev = load(spark, d, "events", ["ts", "event_type", "value"])
    last = ev.agg(F.max("ts").alias("now"))
    return ev.join(F.broadcast(last)).filter(F.expr("ts >= now - INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.max("value").alias("max_value"))


def docs_with_lab_name(spark, d):
    docs = _docs(spark, d, "lab_id", "title")
    names = load(spark, d, "lab", ["lab_id", "kor_name"], once=True)
    return docs.join(names, "lab_id", "left").select("doc_id", "lab_id", F.coalesce("kor_name", F.lit("Unknown")).alias("lab_name"), F.coalesce("title", F.lit("")).alias("title"))


def fill_vectors(spark, d):
    """Missing vectors from the first page with the same text and model, if there is one."""
    docs = _docs(spark, d, "md5", "emb_model", "embedding")
    known = docs.filter("embedding IS NOT NULL").groupBy("md5").agg(F.min_by(F.struct("embedding", F.col("doc_id").alias("from_doc")), "doc_id").alias("known"))
    missing = docs.filter("embedding IS NULL").select("doc_id", "md5")
    return missing.join(known, "md5", "left").select("doc_id", F.col("known.from_doc").alias("taken_from"), F.coalesce(F.size("known.embedding"), F.lit(0)).alias("dim"))


def lab_sections(spark, d):
    """Sections of each lab with the longest text of each, as one line of name=characters."""
    by = load(spark, d, "lab_docs", ["lab_id", "section", "text"]).select("lab_id", F.lower(F.trim("section")).alias("section"), F.length("text").alias("n")).groupBy("lab_id", "section").agg(F.max("n").alias("n"))
    return by.groupBy("lab_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "n"))), lambda x: F.concat(x["section"], F.lit("="), x["n"].cast("string"))), ";").alias("sections"))


def busiest_labs(spark, d):
    """The twenty labs with most pages, then best mean quality."""
    docs = _docs(spark, d, "lab_id", "quality_score").groupBy("lab_id").agg(F.count("*").alias("pages"), F.round(F.avg("quality_score"), 6).alias("quality"))
    return docs.orderBy(F.desc("pages"), F.desc("quality"), "lab_id").limit(20)


QUERIES = {f.__name__: f for f in (lab_stats, section_distribution, active_labs_summary, crawl_statistics, store_stats, docs_per_lab, tags_by_type, crawl_summary, crawl_response, duplicate_texts, duplicate_check, insert_new_docs, insert_new_labs, profile_changes, profile_upsert, snapshot_changes, cache_lookup, soft_delete, misses_to_fetch, crawl_status_update, profile_clear, soft_delete_by_id, name_lookup, parsed_scores, unit_vectors, vectors_from_provider, packed_append_remove, no_website, crawl_visit_order, crawl_visit_order_all, linked_or_tagged, search_log, recent_performance, docs_with_lab_name, fill_vectors, lab_sections, busiest_labs)}

_DOCS = "docs AS (SELECT DISTINCT ON (doc_id) * FROM lab_docs)"
_LABS = "labs AS (SELECT DISTINCT * FROM lab)"
_LOG = "log AS (SELECT DISTINCT * FROM crawl_log)"
_F = ", ".join(PROFILE_FIELDS)


def _picked(side: str) -> str:
    return f"SELECT student_id, {_F} FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY profile_id {side}) AS rn FROM (SELECT DISTINCT * FROM student_profile)) WHERE rn = 1"


def _diff_sql(before: str, after: str, key: str, columns: list[str]) -> str:
    parts = [f"SELECT b.{key}, 'modified' AS change_type, '{c}' AS field_name, b.{c} AS old_value, a.{c} AS new_value FROM b JOIN a USING ({key}) WHERE b.{c} IS DISTINCT FROM a.{c}" for c in columns]
    parts.append(f"SELECT coalesce(b.{key}, a.{key}) AS {key}, CASE WHEN b.{key} IS NULL THEN 'added' ELSE 'deleted' END, NULL, NULL, NULL FROM b FULL JOIN a ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL")
    return f"WITH b AS ({before}), a AS ({after}) " + " UNION ALL ".join(parts)


ORACLES = {
    "lab_stats": f"""WITH {_DOCS}, {_LABS}, tags AS (SELECT DISTINCT * FROM lab_tag)
SELECT l.lab_id, l.kor_name, l.professor,
 (SELECT count(*) FROM docs d WHERE d.lab_id = l.lab_id) AS total_docs, (SELECT count(DISTINCT section) FROM docs d WHERE d.lab_id = l.lab_id) AS sections_count,
 (SELECT round(avg(quality_score), 6) FROM docs d WHERE d.lab_id = l.lab_id) AS avg_doc_quality, (SELECT count(*) FROM tags t WHERE t.lab_id = l.lab_id) AS tags_count,
 (SELECT count(*) FROM lab_link k WHERE k.lab_id = l.lab_id) AS links_count, l.created_at AS last_crawled FROM labs l""",
    "section_distribution": f"WITH {_DOCS} SELECT section, count(*) AS doc_count, round(avg(tokens), 6) AS avg_tokens, round(avg(quality_score), 6) AS avg_quality FROM docs GROUP BY section",
    "active_labs_summary": f"""WITH {_DOCS}, {_LABS} SELECT l.lab_id, l.kor_name, count(DISTINCT d.doc_id) AS total_documents, count(DISTINCT CASE WHEN d.quality_score < 50 THEN d.doc_id END) AS docs_need_review,
 round(avg(d.quality_score), 6) AS avg_quality FROM labs l LEFT JOIN docs d ON l.lab_id = d.lab_id AND d.embedding IS NOT NULL GROUP BY l.lab_id, l.kor_name""",
    "crawl_statistics": f"""WITH {_LOG} SELECT CAST(request_time AS DATE) AS crawl_date, count(*) AS total_requests, sum(CASE WHEN success THEN 1 ELSE 0 END)::BIGINT AS successful,
 sum(CASE WHEN used_cache THEN 1 ELSE 0 END)::BIGINT AS from_cache, round(avg(response_time_ms), 6) AS avg_response_time_ms FROM log GROUP BY 1""",
    "store_stats": f"""WITH {_DOCS} SELECT 'all' AS metric, NULL::VARCHAR AS key, count(*) AS n, round(avg(quality_score), 2) AS mean FROM docs
 UNION ALL SELECT 'section', section, count(*), round(avg(quality_score), 2) FROM docs GROUP BY section UNION ALL SELECT 'lang', lang, count(*), round(avg(quality_score), 2) FROM docs GROUP BY lang""",
    "docs_per_lab": f"WITH {_DOCS}, {_LABS} SELECT l.lab_id, count(d.doc_id) AS doc_count FROM labs l LEFT JOIN docs d ON d.lab_id = l.lab_id GROUP BY l.lab_id",
    "tags_by_type": "SELECT lab_id, lower(trim(tag_type)) AS tag_type, count(*) AS n_tags, string_agg(trim(tag_value), '|' ORDER BY -coalesce(confidence, -1.0), trim(tag_value)) AS tag_values FROM (SELECT DISTINCT * FROM lab_tag) GROUP BY 1, 2",
    "crawl_summary": f"""WITH {_LOG} SELECT lab_id, count(*) AS requests, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(avg(CASE WHEN success THEN 100.0::DOUBLE ELSE 0 END), 6) AS success_pct,
 round(avg(CASE WHEN used_cache THEN 100.0::DOUBLE ELSE 0 END), 6) AS cache_pct, max(request_time) AS last_request FROM log GROUP BY lab_id""",
    "crawl_response": f"""WITH {_LOG} SELECT lab_id, count(*) AS n, round(avg(response_time_ms), 6) AS mean_ms, min(response_time_ms) AS min_ms, max(response_time_ms) AS max_ms, round(quantile_cont(response_time_ms::DOUBLE, 0.5), 6) AS median_ms
 FROM log WHERE response_time_ms IS NOT NULL GROUP BY lab_id""",
    "duplicate_texts": f"WITH {_DOCS} SELECT doc_id, lab_id, md5, copies, kept_doc_id FROM (SELECT *, count(*) OVER w AS copies, min(doc_id) OVER w AS kept_doc_id FROM docs WINDOW w AS (PARTITION BY lab_id, md5)) WHERE copies > 1",
    "duplicate_check": f"WITH {_DOCS} SELECT doc_id, lab_id FROM docs n WHERE created_at >= TIMESTAMP '{CUT}' AND EXISTS (SELECT 1 FROM docs o WHERE o.created_at < TIMESTAMP '{CUT}' AND o.lab_id = n.lab_id AND o.md5 = n.md5)",
    "insert_new_docs": f"""WITH {_DOCS} SELECT doc_id, lab_id, md5 FROM (SELECT *, row_number() OVER (PARTITION BY lab_id, md5 ORDER BY created_at, doc_id) AS rn FROM docs n
 WHERE created_at >= TIMESTAMP '{CUT}' AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.created_at < TIMESTAMP '{CUT}' AND o.lab_id = n.lab_id AND o.md5 = n.md5)) WHERE rn = 1""",
    "insert_new_labs": f"WITH {_LABS} SELECT lab_id, kor_name, first_value(lab_id) OVER (PARTITION BY kor_name ORDER BY created_at, lab_id) AS stored_id FROM labs WHERE kor_name IS NOT NULL",
    "profile_changes": _diff_sql(_picked("ASC"), _picked("DESC"), "student_id", PROFILE_FIELDS),
    "profile_upsert": f"WITH b AS ({_picked('ASC')}), a AS ({_picked('DESC')}) SELECT student_id, {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in PROFILE_FIELDS)} FROM b FULL JOIN a USING (student_id)",
    "snapshot_changes": _diff_sql("SELECT DISTINCT lab_id, contact_email, contact_phone, homepage FROM lab", "SELECT DISTINCT lab_id, contact_email, contact_phone, regexp_replace(homepage, '/+$', '') AS homepage FROM lab WHERE lab_id IN (SELECT lab_id FROM crawl_log)", "lab_id", ["contact_email", "contact_phone", "homepage"]),
    "cache_lookup": f"""WITH {_LOG}, c AS (SELECT *, max(CASE WHEN success THEN request_time END) OVER (PARTITION BY lab_id ORDER BY request_time, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached_at FROM log)
 SELECT log_id, lab_id, cached_at, (epoch_us(request_time) - epoch_us(cached_at)) // 1000000 AS age_s, coalesce(epoch_us(request_time) - epoch_us(cached_at) <= 604800000000, false) AS hit FROM c""",
    "soft_delete": "SELECT lab_id, url, coalesce(is_active, true) AND NOT starts_with(url, 'http://') AS is_active FROM lab_link",
    "misses_to_fetch": f"WITH {_LOG} SELECT DISTINCT lab_id FROM lab WHERE lab_id IS NOT NULL AND lab_id NOT IN (SELECT lab_id FROM log WHERE success AND request_time >= (SELECT max(request_time) FROM log) - INTERVAL 7 DAY AND lab_id IS NOT NULL)",
    "crawl_status_update": f"""WITH {_LOG}, {_LABS}, s AS (SELECT lab_id, max(CASE WHEN success THEN request_time END) AS ok, max(request_time) AS t FROM log GROUP BY lab_id)
 SELECT l.lab_id, CASE WHEN s.lab_id IS NOT NULL AND ok IS NULL THEN NULL ELSE homepage END AS homepage, coalesce(t, created_at) AS created_at FROM labs l LEFT JOIN s ON s.lab_id = l.lab_id""",
    "profile_clear": f"""WITH p AS (SELECT DISTINCT profile_id, student_id, toeic_score, updated_at FROM student_profile), m AS (SELECT student_id, max(profile_id) AS last FROM p WHERE toeic_score IS NOT NULL GROUP BY 1)
 SELECT p.profile_id, p.student_id, CASE WHEN p.profile_id < last THEN NULL ELSE toeic_score END AS toeic_score, CASE WHEN p.profile_id < last THEN TIMESTAMP '{CUT}' ELSE updated_at END AS updated_at FROM p LEFT JOIN m USING (student_id)""",
    "soft_delete_by_id": "SELECT lab_id, url, coalesce(is_active, true) AND NOT (lab_id IN (SELECT lab_id FROM lab) AND lab_id NOT IN (SELECT lab_id FROM lab_docs WHERE lab_id IS NOT NULL)) AS is_active FROM lab_link",
    "name_lookup": f"WITH {_LABS}, n AS (SELECT DISTINCT lab_id, name FROM (SELECT lab_id, lower(trim(kor_name, ' ')) AS name FROM labs UNION ALL SELECT lab_id, lower(trim(eng_name, ' ')) FROM labs) WHERE name <> '') SELECT name, count(*) AS labs, min(lab_id) AS first_lab_id FROM n GROUP BY name",
    "parsed_scores": """SELECT profile_id, TRY_CAST(CASE WHEN regexp_matches(trim(toeic_score), '^[+-]?[0-9]+$') THEN trim(toeic_score) END AS INTEGER) AS toeic, TRY_CAST(nullif(trim(split_part(trim(gpa), '/', 1)), '') AS DOUBLE) AS gpa,
 CASE WHEN length(portfolio) > 50 THEN substr(portfolio, 1, 50) || '...' ELSE portfolio END AS preview, coalesce(major, '-') AS major_or FROM (SELECT DISTINCT profile_id, toeic_score, gpa, portfolio, major FROM student_profile)""",
    "unit_vectors": f"""WITH {_DOCS}, x AS (SELECT doc_id, quality_score, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS dim FROM docs WHERE embedding IS NOT NULL)
 SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (quality_score - 30) / 60.0::DOUBLE)) + CASE WHEN quality_score IS NULL THEN NULL ELSE 0 END, 6) AS quality, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM x""",
    "vectors_from_provider": f"""WITH {_DOCS}, t AS (SELECT doc_id, title, list_transform(string_split(title, ''), lambda c: ascii(c) % 4) AS r FROM docs WHERE embedding IS NULL)
 SELECT doc_id, CASE WHEN title IS NOT NULL THEN array_to_string(list_transform(range(0, 4), lambda i: len(list_filter(r, lambda v: v = i))), ',') END AS made FROM t""",
    "packed_append_remove": """WITH p AS (SELECT DISTINCT profile_id, certifications AS c, major AS m FROM student_profile), s AS (SELECT *, list_transform(string_split(c, ','), lambda x: trim(x, ' ')) AS xs FROM p)
 SELECT profile_id, CASE WHEN c IS NULL OR trim(c, ' ') = '' THEN m WHEN m IS NULL THEN NULL ELSE c || ', ' || m END AS appended, nullif(array_to_string(list_filter(xs, lambda x: x <> xs[1] AND x <> ''), ', '), '') AS removed FROM s""",
    "no_website": f"WITH {_LABS} SELECT lab_id, coalesce(trim(homepage), '') IN ('', '해당없음', '없음', '-', 'N/A', 'none') AS no_website FROM labs",
    "crawl_visit_order": r"""WITH p AS (SELECT lab_id, regexp_replace(url, '^https?://(www\.)?', '') AS page, count(*) AS spellings FROM lab_link GROUP BY 1, 2)
 SELECT lab_id, page, spellings, crawl_depth FROM (SELECT *, (row_number() OVER (PARTITION BY lab_id ORDER BY page) - 1)::INTEGER AS crawl_depth FROM p) WHERE crawl_depth < 5""",
    "crawl_visit_order_all": r"""WITH p AS (SELECT lab_id, regexp_replace(url, '^https?://(www\.)?', '') AS page, count(*) AS spellings FROM lab_link GROUP BY 1, 2)
 SELECT lab_id, page, spellings, (row_number() OVER (PARTITION BY lab_id ORDER BY page) - 1)::INTEGER AS crawl_depth FROM p""",
    "linked_or_tagged": "SELECT lab_id, lower(kind) AS label FROM lab_link UNION SELECT lab_id, lower(trim(tag_type)) FROM lab_tag",
    "search_log": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS results_count, array_to_string(list_slice(list(event_id ORDER BY value DESC, event_id), 1, 5), ',') AS top_ids, round(avg(value), 6) AS avg_score FROM events GROUP BY 1, 2""",
    "docs_with_lab_name": f"WITH {_DOCS}, {_LABS} SELECT d.doc_id, d.lab_id, coalesce(l.kor_name, 'Unknown') AS lab_name, coalesce(d.title, '') AS title FROM docs d LEFT JOIN labs l USING (lab_id)",
    "fill_vectors": f"""WITH {_DOCS} SELECT doc_id, s AS taken_from, coalesce((SELECT len(embedding) FROM docs k WHERE k.doc_id = s), 0)::INTEGER AS dim
 FROM (SELECT m.doc_id, (SELECT min(k.doc_id) FROM docs k WHERE k.md5 = m.md5 AND k.embedding IS NOT NULL) AS s FROM docs m WHERE m.embedding IS NULL)""",
    "lab_sections": f"WITH {_DOCS} SELECT lab_id, string_agg(section || '=' || n, ';' ORDER BY section) AS sections FROM (SELECT lab_id, lower(trim(section)) AS section, max(length(text)) AS n FROM docs GROUP BY 1, 2) GROUP BY lab_id",
    "busiest_labs": f"WITH {_DOCS} SELECT lab_id, count(*) AS pages, round(avg(quality_score), 6) AS quality FROM docs GROUP BY lab_id ORDER BY pages DESC, quality DESC, lab_id LIMIT 20",
    "recent_performance": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type",
}
