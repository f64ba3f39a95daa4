"""HTML pages: main content, links, tables and lab listings.

A page is read once from left to right; there is no tree. The reader keeps a stack of open elements,
with the end tags that HTML leaves out (a paragraph ends where the next block begins, an entry where
the next one begins), and hands each piece of text to the innermost open block, cell or field. So
each text is taken once, and pages of any nesting take linear time.

Defined results: null and empty pages give no links, tables or labs; unclosed elements end with what
holds them; end tags without a start are passed over; markup that breaks off at the end of a page is
text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is taken out of a page, where its content is looked for, and which blocks are read.
NOISE_TAGS = {"nav", "footer", "header", "aside", "script", "style", "iframe"}
NOISE_CLASSES = ("navigation", "nav", "menu", "sidebar", "footer", "header", "advertisement", "ad", "banner", "cookie", "popup", "breadcrumb", "social", "share", "comment")
NOISE_IDS = ("nav", "navigation", "menu", "sidebar", "footer", "header", "comments", "related", "advertisement")
CONTENT_CLASSES = ("content", "main-content", "page-content", "post-content")
BLOCKS = {"p", "div", "span", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre"}
LINK_WORDS = ("research", "publication", "people", "member", "about", "project", "lab", "연구", "논문", "구성원", "소개")
TABLE_COLUMNS = {"venue": r"venue|conference|journal|학회|저널|발표지", "year": r"year|date|년도|발표년도", "title": r"title|paper|제목|논문", "author": r"author|authors|저자"}
LISTING_FIELDS = (("지도교수", "professor"), ("연구내용", "description"), ("연구실", "location"), ("연락처", "phone"), ("이메일", "email"), ("웹사이트", "homepage"))
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# Which open elements a start tag ends, and which elements shield them.
_P_ENDS = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "main", "nav", "header", "footer", "aside", "form", "hr", "address"}
_ENDED = {
    "li": ({"li"}, {"ul", "ol", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"table", "td", "th"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
REGIONS = ("main", "article", *CONTENT_CLASSES, "body")


def _squeezed(parts: list[str], glue: str = " ") -> str:
    return " ".join(glue.join(parts).split())


class Reader(HTMLParser):
    """What a page holds: pieces of text with their block and regions, title, links, tables, labs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, frozenset]] = [("", 0, False, frozenset())]  # tag, block, noise, regions
        self.count: Counter = Counter()
        self.blocks = 0
        self.regions: set[str] = set()  # those that were begun
        self.pieces: list[tuple[int, frozenset, str]] = []
        self.titles: list[tuple[frozenset, list[str]]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.labs: list[dict] = []
        self.field: dict[str, list[str]] = {}  # parts of a listing that are being read

    def _end(self, tag: str, shields: set[str] = frozenset()) -> None:
        """End the innermost open ``tag`` and all within it, unless a shield stands before it."""
        if not self.count[tag]:
            return
        i = len(self.open) - 1
        while i and self.open[i][0] != tag:
            if self.open[i][0] in shields:
                return
            i -= 1
        for t, *_ in self.open[i:]:
            self.count[t] -= 1
            self._closed(t)
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in _P_ENDS:
            self._end("p", {"table", "td", "th", "li", "button"})
        targets, shields = _ENDED.get(tag, ((), frozenset()))
        for target in targets:
            self._end(target, shields)
        if tag == "tr":
            self._end("caption")
        _, block, noise, regions = self.open[-1]
        names = " ".join(attrs.get("class", "").split()).lower()
        ident = attrs.get("id", "").lower()
        noise = noise or tag in NOISE_TAGS or any(x in names for x in NOISE_CLASSES) or any(x in ident for x in NOISE_IDS)
        if not noise:
            begun = [tag] if tag in ("main", "article", "body") else [c for c in CONTENT_CLASSES if tag == "div" and c in names]
            new = [r for r in begun if r not in self.regions]
            if new:
                self.regions.update(new)
                regions = regions | frozenset(new)
        if tag in BLOCKS:
            self.blocks += 1
            block = self.blocks
        if tag == "h1" and not noise:
            self.titles.append((regions, []))
        self._begun(tag, attrs, names)
        if tag not in _VOID:
            self.open.append((tag, block, noise, regions))
            self.count[tag] += 1

    def handle_endtag(self, tag):
        self._end(tag, {"table"} if tag not in ("table", "body", "html", "div") else frozenset())

    def _begun(self, tag: str, attrs: dict, names: str) -> None:
        table = self.open_tables[-1] if self.open_tables else None
        if tag == "a":
            self.links.append((attrs["href"], [])) if "href" in attrs else None
            if "dd" in self.field and "href" not in self.field and attrs.get("href"):
                self.field["href"] = [attrs["href"]]
        elif tag == "table":
            self.open_tables.append({"caption": None, "head": None, "rows": [], "kinds": [], "cell": None, "row": None})
            self.tables.append(self.open_tables[-1])
        elif table is not None and tag == "caption":
            table["caption"] = table["caption"] if table["caption"] is not None else []
        elif table is not None and tag == "tr":
            table["rows"].append(([], self.count["thead"] > 0))
            table["kinds"].append([])
        elif table is not None and tag in ("td", "th"):
            if not table["rows"]:
                table["rows"].append(([], False))
                table["kinds"].append([])
            table["rows"][-1][0].append([])
            table["kinds"][-1].append(tag)
        elif tag == "div" and "labs" in names.split():
            self.labs.append({"kor_name": "", "eng_name": ""} | {k: "" for _, k in LISTING_FIELDS})
        elif self.labs and tag in ("dt", "dd"):
            self.field = {tag: []}
        elif tag == "small" and "dt" in self.field or tag == "span" and "dd" in self.field:
            self.field.setdefault(tag, [])

    def _closed(self, tag: str) -> None:
        if tag == "table" and self.open_tables:
            self.open_tables.pop()
        elif tag in ("dt", "dd") and tag in self.field and self.labs:
            lab, text = self.labs[-1], "".join(self.field[tag])
            if tag == "dt" and not lab["kor_name"]:
                lab["eng_name"] = _squeezed(self.field.get("small", []))
                lab["kor_name"] = _squeezed([text])
            elif tag == "dd" and "span" in self.field:
                name = "".join(self.field["span"])
                field = next((k for word, k in LISTING_FIELDS if word in name), None)
                if field and not lab[field]:
                    lab[field] = self.field["href"][0] if "href" in self.field else _squeezed([text])
            self.field = {}

    def handle_data(self, data):
        tag, block, noise, regions = self.open[-1]
        if data.strip() and not noise:
            self.pieces.append((block, regions, data))
            if self.titles and self.count["h1"]:
                self.titles[-1][1].append(data)
        if self.links and self.count["a"]:
            self.links[-1][1].append(data)
        if self.open_tables:
            table = self.open_tables[-1]
            if table["caption"] is not None and not table["rows"]:
                table["caption"].append(data)
            elif table["rows"] and table["rows"][-1][0] and (self.count["td"] or self.count["th"]):
                table["rows"][-1][0][-1].append(data)
        if self.field:
            inner = "small" if self.count["small"] and "small" in self.field else "span" if tag == "span" and "span" in self.field else None
            self.field[inner or next(iter(self.field))].append(data)


def read(html: str) -> Reader:
    reader = Reader()
    reader.feed(html)
    reader.close()
    for tag, *_ in reversed(reader.open[1:]):
        reader._closed(tag)
    return reader


def main_text(html: str, least: int = 0) -> tuple[str | None, str]:
    """(title, text): the first h1 and the distinct blocks, longer than ``least``, of the main content, blank lines between them."""
    page = read(html)
    region = next((r for r in REGIONS if r in page.regions), None)
    inside = lambda regions: region is None or region in regions
    title = next((_squeezed(parts) for regions, parts in page.titles if inside(regions)), None)
    found: list[tuple[int, list[str]]] = []
    for block, regions, text in page.pieces:
        if inside(regions):
            if not found or found[-1][0] != block:
                found.append((block, []))
            found[-1][1].append(text)
    kept: dict[str, str] = {}
    for _, parts in found:
        text = _squeezed(parts, "")
        if len(text) > least:
            kept.setdefault(text.lower().replace(" ", ""), text)
    return title, "\n\n".join(kept.values())


def page_links(html: str, url: str) -> list[str]:
    """Links of the same host whose address or text holds a word of interest, without query and repeated path parts."""
    own, out = urlparse(url).netloc, []
    for href, text in read(html).links:
        if any(w in href.lower() or w in "".join(text).lower() for w in LINK_WORDS):
            try:
                full = urlparse(urljoin(url, href))
            except ValueError:  # no address at all
                continue
            if full.netloc and full.netloc == own:
                parts: list[str] = []
                held = set()
                for p in full.path.split("/"):
                    if p and (p not in held or p in ("view", "page")):
                        parts.append(p)
                        held.add(p)
                out.append(f"{full.scheme}://{full.netloc}/{'/'.join(parts)}")
    return [x for x in dict.fromkeys(out) if x != url]


def page_tables(html: str) -> list[dict]:
    """caption, headers, rows and lab_tags (venue and year) of each table with rows; nested tables stand for themselves."""
    found = []
    for table in read(html).tables:
        rows = [([_squeezed(c, "") for c in cells], head) for cells, head in table["rows"]]
        headers = next((cells for cells, head in rows if head), [])
        if not headers and rows and table["kinds"][0].count("th") > len(table["kinds"][0]) / 2:
            headers = rows[0][0]
        body = [cells for cells, head in rows if not head and any(cells) and cells != headers]
        if not body:
            continue
        at = {k: i for i, h in enumerate(headers) for k, p in TABLE_COLUMNS.items() if re.search(p, h.lower())}
        tags = []
        if "venue" in at and "year" in at:
            for r in body:
                if max(at["venue"], at["year"]) < len(r):
                    year = re.search(r"\d{4}", r[at["year"]])
                    tags.append(r[at["venue"]] + (year[0] if year else r[at["year"]]))
        found.append({"caption": None if table["caption"] is None else _squeezed(table["caption"], ""), "headers": headers, "rows": body, "lab_tags": tags})
    return found


def lab_listing(html: str) -> list[dict[str, str]]:
    """Names and fields of each lab in a listing page; a link stands for the text of its field."""
    return [lab for lab in read(html).labs if any(lab.values())]


def main_content(pages: DataFrame, key: str, html: str, carry: list[str] | None = None, least: int = 0) -> DataFrame:
    """(key, *carry, title, text) of pages with at least 100 characters of HTML."""
    carry = carry or []
    base = pages.filter(F.length(html) >= 100).select(F.col(key).alias("_key"), F.col(html).alias("_html"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    held = [f"_c{i}" for i in range(len(carry))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [main_text(h, least) for h in pdf["_html"]]
            yield pdf[["_key", *held]].assign(title=[t for t, _ in got], text=[x for _, x in got])

    kind = lambda c: base.schema[c].dataType.simpleString()
    found = base.mapInPandas(run, ", ".join(f"{c} {kind(c)}" for c in ("_key", *held)) + ", title string, text string")
    return found.select(F.col("_key").alias(key), *[F.col(h).alias(c) for h, c in zip(held, carry)], "title", "text")


def links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, position, url) of the links of interest."""
    found = F.pandas_udf(lambda h, u: pd.Series([page_links(x, y) if x and y else [] for x, y in zip(h, u)]), "array<string>")
    return pages.select(key, F.posexplode(found(html, url)).alias("position", "url"))


def tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, caption, headers, rows, lab_tags) of the tables of each page."""
    kind = "array<struct<caption string, headers array<string>, rows array<array<string>>, lab_tags array<string>>>"
    found = F.udf(lambda h: page_tables(h) if h else [], kind, useArrow=True)
    return pages.select(key, F.posexplode(found(html)).alias("table_no", "t")).select(key, "table_no", "t.*")


def table_text(caption: Column, headers: Column, rows: Column) -> Column:
    """A table as lines: caption, headers over a rule, cells between bars."""
    bars = lambda cells: F.array_join(cells, " | ")
    head = F.when(F.size(headers) > 0, F.array(bars(headers), F.lit("-" * 50))).otherwise(F.array().cast("array<string>"))
    top = F.when(caption != "", F.array(F.concat(F.lit("표: "), caption, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, head, F.transform(rows, bars)), "\n")


def table_records(headers: Column, rows: Column) -> Column:
    """The rows of a table as maps of header to cell; of two equal headers the last one counts, a cell without header is left out."""
    def record(row: Column) -> Column:
        pairs = F.filter(F.zip_with(F.transform(headers, lambda h, i: F.struct(h.alias("k"), i.alias("i"))), row, lambda h, c: F.struct(h["k"].alias("k"), c.alias("v"), h["i"].alias("i"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
        last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))

    return F.when(F.size(headers) > 0, F.transform(rows, record)).otherwise(F.array().cast("array<map<string,string>>"))


def listing(pages: DataFrame, html: str) -> DataFrame:
    """One row for each lab of the listing pages."""
    fields = ["kor_name", "eng_name", *[k for _, k in LISTING_FIELDS]]
    found = F.udf(lambda h: lab_listing(h) if h else [], f"array<struct<{', '.join(f'{f} string' for f in fields)}>>", useArrow=True)
    return pages.select(F.explode(found(html)).alias("lab")).select("lab.*")
