"""Ingest and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import quality, text
from docweave.operators import chunking, pages, store
from docweave.sources.tables import load
from docweave.streaming import crawl


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _html(spark, d):
    """Pages of lab_docs written out as HTML by Spark: a menu, one paragraph for each line, a footer; in three ways, by id.

    Paragraphs and entries are closed, left open, or nested; menus hold links of the host, of other
    hosts, with queries, with repeated parts and with fragments.
    """
    docs = load(spark, d, "lab_docs", ["doc_id", "lab_id", "title", "text", "source_url"])
    way, host = F.col("doc_id") % 3, F.regexp_extract("source_url", "^https?://([^/?#]+)", 1)
    menu = (
        F.when(way == 0, "<nav><ul><li><a href='/research'>research</a><li><a href='/people/list?x=1'>people</a></ul></nav>")
        .when(way == 1, F.concat(F.lit("<div class='menu'><a href='//"), F.coalesce(host, F.lit("")), F.lit("/lab/people/lab/"), (F.col("doc_id") % 11).cast("string"), F.lit("'>x<a href='https://other.test/lab'>lab</div>")))
        .otherwise(F.concat(F.lit("<header><a href='?page="), (F.col("doc_id") % 5).cast("string"), F.lit("'>publication list</a> <a href='#top'>about</a></header>")))
    )
    lines = F.split(_esc(F.col("text")), "\n")
    body = F.when(way == 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")).when(way == 1, F.concat(F.lit("<p>"), F.array_join(lines, "<p>"))).otherwise(
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<div><span>"), x, F.lit("</span></div>"))), "")
    )
    region = F.when(way == 2, "<div class='page-content'>").otherwise("<main>")
    return docs.select("doc_id", "lab_id", "source_url", F.concat(F.lit("<html><body>"), menu, region, F.lit("<h1>"), _esc(F.coalesce("title", F.lit(""))), F.lit("</h1>"), body, F.when(way == 2, "</div>").otherwise("</main>"), F.lit("<div class='footer'><p>footer text of the site</div></body></html>")).alias("html"))


def main_content(spark, d):
    return pages.main_content(_html(spark, d), "doc_id", "html").select("doc_id", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5")).dropDuplicates(["doc_id"])


def discovered_links(spark, d):
    return pages.links(_html(spark, d).filter(F.col("source_url").rlike("^https?://[^/?#]")), "doc_id", "html", "source_url").distinct()


def _table_pages(spark, d):
    """A table of each submission as HTML: heads in a thead or a first row, cells closed or left open, with and without caption, by id."""
    p = load(spark, d, "student_profile", ["profile_id", "toeic_score", "major", "gpa", "opic_grade", "updated_at"], once=True)
    even, lazy = F.col("profile_id") % 2 == 0, F.col("profile_id") % 3 == 0
    cell = lambda c: F.concat(F.lit("<td>"), _esc(F.coalesce(c, F.lit(""))), F.when(lazy, "").otherwise("</td>"))
    row = lambda *cs: F.concat(F.lit("<tr>"), *[cell(c) for c in cs], F.when(lazy, "").otherwise("</tr>"))
    head = F.when(even, "<thead><tr><th>Title<th>Venue<th>Year</thead><tbody>").otherwise("<tr><th>Title</th><th>Venue</th><th>Year</th></tr>")
    caption = F.when(F.col("profile_id") % 5 == 0, "").otherwise(F.concat(F.lit("<caption>profile "), F.col("profile_id").cast("string"), F.lit("</caption>")))
    html = F.concat(F.lit("<div><table>"), caption, head, row(F.col("toeic_score"), F.col("major"), F.year("updated_at").cast("string")), row(F.col("gpa"), F.col("opic_grade"), F.lit(None).cast("string")), F.when(even, "</tbody>").otherwise(""), F.lit("</table>after it</div>"))
    return p.select("profile_id", html.alias("html"))


def html_tables(spark, d):
    t = pages.tables(_table_pages(spark, d), "profile_id", "html")
    return t.select("profile_id", "table_no", "caption", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), F.array_join("lab_tags", "|").alias("lab_tags"))


def table_lines(spark, d):
    t = pages.tables(_table_pages(spark, d), "profile_id", "html")
    return t.select("profile_id", pages.table_text(F.coalesce("caption", F.lit("")), F.col("headers"), F.col("rows")).alias("text"))


def table_records(spark, d):
    t = pages.tables(_table_pages(spark, d), "profile_id", "html")
    rows = t.select("profile_id", F.posexplode(pages.table_records(F.col("headers"), F.col("rows"))).alias("row_no", "record"))
    return rows.select("profile_id", "row_no", F.explode("record").alias("header", "cell"))


def lab_listing(spark, d):
    """Labs read back from listing pages, one page for each lab."""
    labs = load(spark, d, "lab", ["lab_id", "kor_name", "eng_name", "professor", "office_location", "contact_email", "contact_phone", "homepage"], once=True)
    dd = lambda name, c: F.concat(F.lit(f"<dd><span>{name}</span> "), _esc(F.coalesce(c, F.lit(""))), F.when(F.col("lab_id") % 2 == 0, "</dd>").otherwise(""))
    link = F.when(F.col("homepage").isNull(), "").otherwise(F.concat(F.lit("<dd><span>웹사이트</span><a href='"), _esc(F.col("homepage")), F.lit("'>go</a>")))
    html = F.concat(F.lit("<div class='labs'><dl><dt>"), _esc(F.coalesce("kor_name", F.lit(""))), F.lit("<small>"), _esc(F.coalesce("eng_name", F.lit(""))), F.lit("</small></dt>"), dd("지도교수", F.col("professor")), dd("연구실", F.col("office_location")), dd("연락처", F.col("contact_phone")), dd("이메일", F.col("contact_email")), link, F.lit("</dl></div>"))
    return pages.listing(labs.select(html.alias("html")), "html")


def form_fields(spark, d):
    """Input fields that ask for personal information, in forms whose fields differ by id."""
    p = load(spark, d, "student_profile", ["profile_id"], once=True)
    inputs = [F.when(F.col("profile_id") % k == 0, tag).otherwise("") for k, tag in ((2, "<input type='password'>"), (3, '<INPUT TYPE="email">'), (5, "<input name='home_phone_no'>"), (7, "<input id='new-password'>"))]
    html = F.concat(F.lit("<form><input type='text' name='q'>"), *inputs, F.lit("</form>"))
    return p.select("profile_id", F.array_join(F.array_sort(quality.form_fields(html)), ",").alias("asked"))


def chunk_documents(spark, d):
    return chunking.chunks(load(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text").drop("text")


def ingest_pages(spark, d):
    """Pages to chunks: main content, section, chunks, cleaning, quality, first of equal chunks within a lab."""
    main = pages.main_content(_html(spark, d), "doc_id", "html", ["lab_id", "source_url"]).filter(F.length("text") >= 100)
    cut = chunking.chunks(main, "doc_id", "text", "title", carry=["lab_id", "source_url"], normal_form=True)
    clean = cut.withColumn("cleaned", text.clean(F.col("text"))).filter(F.length("cleaned") >= 100)
    lang = text.language(F.col("cleaned"))
    scored = clean.select(
        "doc_id", "lab_id", "chunk_no", "title", "md5", lang.alias("lang"), text.section(F.col("cleaned"), F.col("source_url")).alias("section"),
        quality.ingest_score(F.length("cleaned"), lang, text.token_estimate(F.col("cleaned"), lang), F.col("title")).alias("quality"),
    )
    return store.first_of(scored, ["lab_id", "md5"], ["doc_id", "chunk_no"])


def word_packs(spark, d):
    p = load(spark, d, "student_profile", ["profile_id", "portfolio"], once=True).filter("portfolio IS NOT NULL")
    return p.select("profile_id", F.posexplode(chunking.word_packs(F.col("portfolio"), 64)).alias("piece_no", "piece"))


def normalised_text(spark, d):
    docs = load(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.md5(chunking.nfkc("text")).alias("md5"))


def stream_crawl_daily(spark, d):
    """Closed daily windows of the crawl log as a stream; the days within a week of the last request are still open."""
    log = crawl.read_log(spark, f"{d}/crawl_log.parquet", "request_time")
    return crawl.run_to_table(crawl.daily_windows(crawl.first_of_each(log, ["log_id"], "request_time"), "request_time"))


def stream_first_requests(spark, d):
    log = crawl.read_log(spark, f"{d}/crawl_log.parquet", "request_time")
    once = crawl.run_to_table(crawl.first_of_each(log, ["log_id"], "request_time"))
    return once.select("log_id", "lab_id", "success", "response_time_ms")


QUERIES = {f.__name__: f for f in (main_content, discovered_links, html_tables, table_lines, table_records, lab_listing, form_fields, chunk_documents, ingest_pages, word_packs, normalised_text, stream_crawl_daily, stream_first_requests)}

_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sq(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_BLANK}', ' ', 'g'), ' ')"


_TABLE = f"""p AS (SELECT DISTINCT profile_id, {_sq('toeic_score')} AS a, {_sq('major')} AS b, year(updated_at)::VARCHAR AS c, {_sq('gpa')} AS e, {_sq('opic_grade')} AS f FROM student_profile),
t AS (SELECT profile_id, CASE WHEN profile_id % 5 <> 0 THEN 'profile ' || profile_id END AS caption, list_filter([[a, b, coalesce(c, '')], [e, f, '']], lambda r: list_aggregate(r, 'string_agg', '') <> '') AS rs FROM p)"""

ORACLES = {
    "main_content": f"""WITH docs AS (SELECT DISTINCT ON (doc_id) * FROM lab_docs WHERE text IS NOT NULL), x AS (SELECT doc_id, {_sq('title')} AS title, list_filter(list_transform(list_prepend(coalesce(title, ''), string_split(text, chr(10))), lambda l: {_sq('l')}), lambda l: l <> '') AS ls FROM docs),
 k AS (SELECT *, list_transform(ls, lambda l: replace(lower(l), ' ', '')) AS ks FROM x), y AS (SELECT doc_id, title, array_to_string(list_filter(ls, lambda l, i: list_position(ks, ks[i]) = i), chr(10) || chr(10)) AS body FROM k)
 SELECT doc_id, title, length(body) AS n_chars, md5(body) AS md5 FROM y""",
    "discovered_links": r"""WITH docs AS (SELECT DISTINCT ON (doc_id) * FROM lab_docs WHERE regexp_matches(source_url, '^https?://[^/?#]')),
 h AS (SELECT doc_id, source_url, regexp_extract(source_url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(source_url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM docs),
 l AS (SELECT doc_id, source_url, host || '/research' AS url, 0 AS p FROM h WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source_url, host || '/people/list', 1 FROM h WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, source_url, host || '/lab/people/' || (doc_id % 11), 0 FROM h WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, source_url, host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/'), 0 FROM h WHERE doc_id % 3 = 2)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS position, url FROM l WHERE url <> source_url""",
    "html_tables": f"WITH {_TABLE} SELECT profile_id, 0 AS table_no, caption, 'Title|Venue|Year' AS headers, len(rs)::INTEGER AS n_rows, array_to_string(list_transform(rs, lambda r: r[2] || r[3]), '|') AS lab_tags FROM t WHERE len(rs) > 0",
    "table_lines": f"""WITH {_TABLE} SELECT profile_id, CASE WHEN caption IS NULL THEN '' ELSE '표: ' || caption || chr(10) || chr(10) END || 'Title | Venue | Year' || chr(10) || repeat('-', 50) || chr(10)
 || array_to_string(list_transform(rs, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM t WHERE len(rs) > 0""",
    "table_records": f"""WITH {_TABLE}, r AS (SELECT profile_id, unnest(rs) AS r, unnest(range(0, len(rs)))::INTEGER AS row_no FROM t)
 SELECT profile_id, row_no, 'Title' AS header, r[1] AS cell FROM r UNION ALL SELECT profile_id, row_no, 'Venue', r[2] FROM r UNION ALL SELECT profile_id, row_no, 'Year', r[3] FROM r""",
    "lab_listing": f"""SELECT {_sq('kor_name')} AS kor_name, {_sq('eng_name')} AS eng_name, {_sq('professor')} AS professor, '' AS description, {_sq('office_location')} AS location, {_sq('contact_phone')} AS phone, {_sq('contact_email')} AS email, coalesce(homepage, '') AS homepage FROM (SELECT DISTINCT * FROM lab)""",
    "form_fields": """SELECT profile_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN profile_id % 2 = 0 OR profile_id % 7 = 0 THEN 'password' END, CASE WHEN profile_id % 3 = 0 THEN 'email' END, CASE WHEN profile_id % 5 = 0 THEN 'phone' END], lambda x: x IS NOT NULL))), ',') AS asked FROM (SELECT DISTINCT profile_id FROM student_profile)""",
    "stream_first_requests": "SELECT DISTINCT log_id, lab_id, success, response_time_ms FROM crawl_log",
    "stream_crawl_daily": """WITH log AS (SELECT DISTINCT * FROM crawl_log) SELECT CAST(request_time AS DATE) AS crawl_date, count(*) AS total_requests, sum(success::BIGINT)::BIGINT AS successful, sum(used_cache::BIGINT)::BIGINT AS from_cache
 FROM log GROUP BY 1 HAVING CAST(request_time AS DATE) + INTERVAL 1 DAY <= (SELECT max(request_time) FROM log) - INTERVAL 7 DAY""",
}
