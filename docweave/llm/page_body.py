"""Main body of a page, without the furniture of its site.

Wrapper induction. A page is a tree: root - lines - fields. Fields are what separators (bars, colons,
arrows, tabs) divide a line into; a node's label is its words with numbers and coined names as slots.
The pages of a host are folded, one after another, into a template that grows: the page's lines are
aligned with those of the template by simple tree matching, in order, where two lines match as far as
their labels and fields agree; met nodes are counted and new ones are put in between. The share of
the host's pages that meet a label is its support.

* A line whose label has the support ``support`` is a constant node, and so is a line of several or
  long fields half of which have the support ``part``: menus, paths, bylines, stamps, notices.
* Slots at the root are content. A slot within a list whose heading or neighbours are furniture
  belongs to that list (links to other pages).
* Furniture that differs in every word from page to page can't be told from a list of the body by
  alignment. There the *role* that a line shows by its surface is the prior: general cues of web
  pages, as tag and class would be in HTML, listed below as fixed values. Alignment overrules it: a
  role that the pages of a host show next to never is no furniture of that host.

Skew: the pages of a host are dealt to groups of about ``GROUP`` pages, so a large host is spread over
many tasks; each group sends only its template's counts, which are summed for the host; sizes and
templates go back to the pages of a host by group, never as one task.

Defined results: rows without id and null texts have no rows; blank lines are no case; null and unparsable urls form
one host; repeated rows count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.session import cut

GROUP = 64  # pages of a group, about
DEAL = 16  # parts in which the pages of a host learn its size
LEAST = 3  # pages that must meet a label
LONG = 16  # letters of a label that don't agree by chance

# Words of menus.
MENU_KO = "홈|강의|공지사항|모집|프로젝트|연구 성과|특허|연구실 소개|졸업생|게시판|사이트맵|논문|연구 분야|지도교수|자료실|장비 현황|갤러리|오시는 길|구성원|세미나|메인|소식|연락처"
MENU_EN = "Home|Main|About|About us|People|Faculty|Alumni|Research|Projects|Publications|Patents|Courses|Seminar|Seminars|News|Board|Gallery|Downloads|Facilities|Join us|Directions|Sitemap|Contact|Members|Notices?"
_MENU = rf"(?:{MENU_KO}|{MENU_EN})"
_SEP = r"(?:\s*(?:[|>»›·/•]|&gt;|&raquo;|::)\s*|\t+| {2,})"
# Tools of a page.
_TOOL = (
    "Skip to (?:main )?content|Back to top|Back to list|Log ?in|Log ?out|Sign in|Sign up|Register|Text size ?[+-]?|Search this site|Print this page|Print|Bookmark this (?:article|page|post)|Copy link|"
    "본문 ?바로가기|바로가기 메뉴|위로 가기|맨 위로|로그인|로그아웃|회원가입|글자 크기 ?[+-]?|검색어를 입력하세요|페이지 인쇄|인쇄하기|목록(?:으로)?|목록 보기|주소 복사"
)
_WHAT = "(?:stories|reading|entries|items|posts|pages|news|links|articles)"
# What shows the role of a line of furniture.
ROLES = {
    "menu": rf"{_MENU}(?:{_SEP}{_MENU})*(?:{_SEP}[A-Z][A-Za-z-]+)?",
    "path": rf"(?:(?:현재 위치|You are here|위치)\s*:\s*)(?:.+)|{_MENU}(?:\s*(?:[>»›/]|&gt;|&raquo;)\s*{_MENU})*\s*(?:[>»›/]|&gt;|&raquo;)\s*\S.{{2,80}}",
    "tool": rf"(?:{_TOOL})(?:{_SEP}|\s+)?(?:{_MENU})?(?:{_SEP}(?:{_TOOL}|{_MENU}))*",
    "pager": r"«\s*\d+(?:\s*[·|/]\s*\d+)*\s*»|(?:이전|Prev(?:ious)?|처음|First)\b[\s\d/·|]*(?:다음|Next)?\s*(?:마지막|Last)?|\d+쪽\s*/\s*전체 \d+쪽|Page \d+ of \d+",
    "neighbour": r"(?:이전|다음)\s?글\s*[▲▼:：].*|(?:Previous|Next|Newer|Older|Read next)\s*[:»].*|«\s*Older\s*:?.*",
    "list_head": rf"(?:Most read|This week's|Editor's) {_WHAT}\s*(?:»|:|\(\d+\))?|(?:관련|추천|최근|인기|많이 본|함께 보면 좋은|이번 주|새로 올라온|다른|놓치기 쉬운)\s?(?:글|게시글|게시물|페이지|링크|소식|자료|연구)\s*(?:»|:|\(\d+\))?|(?:Related|Popular|More|Recent|Suggested|Featured|Other|Latest|Recommended|Trending)\s{_WHAT}\s*(?:»|:|\(\d+\))?",
    "link": r"(?:추천\s?:|\[관련글\]|\[Related\]|인기글 \d+위|Popular #\d+|See also\s?:|▸|Recommended\s?:|Related\s?:).*|(?:·|Read more:?) .{3,90}",
    "byline": r"작성자\s*:.*|(?:글쓴이|등록자)\s*:.*|Posted by .*|Written by .*",
    "stamp": r"(?:최종 수정일|마지막 수정|수정일|등록일|게시일)\s.*|Last (?:updated|modified).*|(?:오늘|전체) 방문.*|(?:Visitors|Today's visitors|Visits).*|\d+ visit(?:or)?s today.*|\d+ min(?:ute)?s? read|읽는 시간 .*|조회\s?수?\s*:?\s*\d+",
    "legal": r"(?:Privacy (?:policy|notice)|Terms (?:of (?:use|service)|and conditions))\b.*|copyright\s*(?:©|\(c\)|ⓒ|\d{4}).*|(?:©|ⓒ|\(c\))\s*\d{4}.*",
    "consent": r"(?:Accept|Reject|Allow) all\b.{0,40}|모두 (?:수락|동의|거부).{0,40}",
    "share": r"Share (?:this|it|on|via|with)\b.*|(?:Tweet|Pin) (?:this|it)\b.*",
    "subscribe": r"(?:Subscribe|Sign up) (?:to|for) .*|Follow us\b.*|(?:구독하기|소식 받기)",
    "tags": r"(?:태그|키워드|Tags?|Keywords|Filed under)\s*[:：].*|#\S+(?:[\s,]+#\S+)+",
    "download": r"첨부(?:파일)? ?\d*개? ?(?:내려받기|다운로드).*|Downloads? \d+ (?:attachments?|files?).*",
    "comment": r"댓글 \d+.*|\d+ comments?\b.*|(?:Saved|Scrapped) \d+ times.*|스크랩 \d+.*|Leave a (?:comment|reply).*",
    "welcome": r"Welcome to .{3,60}",
    "footer": r"(?:주소|Address)\s*[:：|].*(?:전화|Tel|@).*",
}
# What shows the role of a line wherever it stands in it.
HOLDS = {
    "legal": r"개인정보 ?처리방침|이메일 ?무단 ?수집 ?거부|이용약관|All rights reserved|저작권자|무단 (?:전재|복제|배포)|Mentions légales|Politique de confidentialité|Impressum|Datenschutz(?:erklärung)?\b|版权所有|無断転載|\bmay not be (?:copied|reposted|redistributed|reproduced|reused)|저작권은 .{0,60} 없습니다|(?:허락|동의|승인) 없이 .{0,30}(?:복제|배포|전재|옮기|베끼|퍼갈)",
    "consent": r"\buses? cookies|\b(?:accept|reject|allow|manage|our) (?:all )?cookies|cookies? (?:settings|policy|preferences|notice|help|allow)|쿠키를 (?:사용|이용|저장|수집|활용|허용)|쿠키 (?:설정|정책)",
    "share": r"(?:공유하기|공유해 주세요)$",
    "link": r"(?<=...)(?:더보기|\b(?-i:NEW)|›|\bmore)$",
}
# A line that holds none of these, and doesn't end with one of the second list, has no such role.
_HINTS = ("방침", "수집", "약관", "저작권", "무단", "없이", "쿠키", "공유", "rights reserved", "légales", "confidentialité", "impressum", "datenschutz", "版权", "転載", "may not be", "cookie")
_HINT_ENDS = ("더보기", "new", "›", "more")
_HINTS_ASCII = tuple(x for x in _HINTS if x.isascii())
_ZERO = re.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad]+")
# Ornaments around a line.
_LEFT, _RIGHT = " \t\r\u00a0»*※▪■□◆◇★☆~=-–—", " \t\r\u00a0~=!.-–—"
_ENDS = _LEFT + _RIGHT
_ROLE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ROLES.items()), re.I)
_HOLDS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in HOLDS.items()), re.I)
# These begin with a class of signs, which is looked for much faster than alternatives are.
_FIELD = re.compile(r"[|>»›•▲▼:：/·\t &](?:(?<![ &])|(?<= ) |(?<=&)(?:gt|raquo);)")
_SIGN = re.compile(r"[|>»›•▲▼:：/·]")  # the same for a line without tabs, double blanks and entities
_BODY_ITEM = re.compile(r"\s*(?:[-*•○]|\(?\d{1,2}[.)])\s")
_PROSE = re.compile(r"[.!?。！？](?:(?<=[.!?])\s\S|(?<=[。！？])\S|$)")
_SLOT = re.compile(r"[\dA-Z](?:(?<=\d)\d*(?:[.,:/-]\d+)*|(?<=[A-Z])(?:[a-z]+-?[A-Z]\w*|[a-z]{3,}))")
_LETTER = re.compile(r"[^\W\d_]")
_LONG = re.compile(rf"(?:[^\W\d_][\W\d_]*+){{{LONG}}}")
_MENU_WORD = re.compile(_MENU, re.I)


def even(text: str) -> str:
    """All kinds of blanks as one space each, none at the ends."""
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " ")
    if not text.isascii() and _ZERO.search(text):
        text = _ZERO.sub(" ", text)
    return " ".join(text.split())


def _hinted(low: str) -> bool:
    if low.endswith(_HINT_ENDS):
        return True
    for x in _HINTS_ASCII if low.isascii() else _HINTS:
        if x in low:
            return True
    return False


def role_of(line: str, smooth: bool = False) -> str:
    """Role of one stripped line: one of ROLES, or item, prose, other; ``smooth``: ``even`` leaves the line as it is."""
    bare = line.lstrip(_LEFT).rstrip(_RIGHT)
    if not bare:
        return "blank"
    plain = bare if smooth else even(bare)
    m = _ROLE.fullmatch(plain) or (_ROLE.fullmatch(bare) if bare != plain else None) or (_ROLE.fullmatch(line) if bare != line else None)
    if not m:
        m = _HOLDS.search(plain) if _hinted(plain.lower()) else None
    if m and not (m.re is _HOLDS and m.lastgroup == "link" and len(plain) > 100):
        role = m.lastgroup
        return "prose" if role in ("link", "path", "list_head") and re.search(r"[.다요]$", bare) and len(bare) > 60 else role
    if _BODY_ITEM.match(line):
        return "item"
    return "prose" if len(bare) > 140 or _PROSE.search(line) else "other"


def _key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _slotted(text: str) -> str:
    """Numbers and names as slots, unless nothing else would be left."""
    slotted = _SLOT.sub("#", text)
    return (slotted if _LETTER.search(slotted) else text).casefold()


def nodes_of(line: str, smooth: bool = False) -> tuple[str, list[str]]:
    """The label of a line node and those of its fields that hold a letter; a single field only if it is long."""
    whole = line.strip(_ENDS)
    label = _slotted(whole if smooth else even(whole))
    parts = (_SIGN if smooth and "&" not in line else _FIELD).split(line)
    if len(parts) > 1:
        parts = [x for x in (x.strip(_ENDS) if smooth else even(x).strip(_ENDS) for x in parts) if _LETTER.search(x)]
    if len(parts) < 2:
        return label, [label] if len(label) >= LONG and _LONG.search(label) else []
    return label, [_slotted(x) for x in parts]


@lru_cache(maxsize=50_000)
def line_of(line: str) -> tuple[str, int, tuple[int, ...]]:
    """(role, label, fields) of a line; labels are hashes."""
    smooth = (line.isprintable() and "  " not in line and "&" not in line) or even(line) == line
    label, fields = nodes_of(line, smooth)
    return role_of(line, smooth), _key(label), tuple([_key("\t" + x) for x in fields])


def tree_of(text: str) -> list[tuple[int, str, int, list[int]]]:
    """(line_no, role, label, fields) of the line nodes of a page; labels are hashes."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if line:
            role, label, fields = line_of(line) if len(line) < 300 else line_of.__wrapped__(line)
            out.append((n, role, label, list(fields)))
    return out


def _lists(values: list, ends: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, roles, labels, sizes, fields, line_ends, field_ends = [], [], [], [], [], [0], [0]
        for text in batch.column("text").to_pylist():
            for n, role, label, own in tree_of(text):
                lines.append(n)
                roles.append(_KINDS[role])
                labels.append(label)
                sizes.append(len(own))
                fields += own
            line_ends.append(len(lines))
            field_ends.append(len(fields))
        trees = [_lists(lines, line_ends, pa.int32()), _lists(roles, line_ends, pa.int8()), _lists(labels, line_ends, pa.int64()), _lists(sizes, line_ends, pa.int32()), _lists(fields, field_ends, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("doc_id"), *trees], names=["host", "doc_id", "lines", "roles", "labels", "sizes", "fields"])


KINDS = (*ROLES, "item", "prose", "other", "blank")
_KINDS = {k: i for i, k in enumerate(KINDS)}
PAGE = "lines array<int>, roles array<tinyint>, labels array<long>, sizes array<int>, fields array<long>"


def _fields(sizes: list[int], flat: list[int]) -> list[list[int]]:
    """The flat fields of a page by its lines."""
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n])
        at += n
    return out


def match_nodes(weight: np.ndarray) -> list[tuple[int, int]]:
    """Simple tree matching of the children of two roots: pairs (i, j), in order, of the greatest total ``weight[i, j]``."""
    return match_points([(j, row[j]) for j in np.flatnonzero(row).tolist()] for row in weight)


def match_points(points: Iterable[list[tuple[int, float]]]) -> list[tuple[int, int]]:
    """``match_nodes`` by the pairs (j, weight), in order, of each row that have a weight.

    The best totals of a row are a staircase over j; only its steps are kept, and where each total was reached
    first, so long pages are matched like short ones. Of equal ways the one of the earliest rows is taken.
    """
    at: list[int] = []  # where the steps of the last row begin
    best: list[float] = []  # their totals
    reached: dict[float, list[tuple[int, int, float]]] = {}  # total: (j, i, weight) of each step with it, j falls
    for i, row in enumerate(points):
        new, k, top, size = [], 0, 0, len(at)
        for j, w in row:
            k = bisect_left(at, j, k)
            total = best[k - 1] + w if k else w
            if total > top and (k == size or at[k] > j or best[k] < total):
                new.append((j, w, total))
                top = total
        for j, w, total in new:
            k = bisect_left(at, j)
            end = bisect_right(best, total, k)
            at[k:end], best[k:end] = [j], [total]
            reached.setdefault(total, []).append((j, i, w))
    pairs = []
    total, before = best[-1] if best else 0, math.inf
    while total:
        steps = reached[total]
        j, i, w = steps[bisect_right(steps, -before, key=lambda step: -step[0])]
        pairs.append((i, j))
        total, before = total - w, j
    return pairs[::-1]


def _points(lines: list[set[int]], where: dict[int, list[int]], place: list[int]) -> Iterator[list[tuple[int, int]]]:
    """For each line the places in the template that share labels with it, in order, and how many."""
    last, row = None, []
    for line in lines:
        if line != last:
            weight: dict[int, int] = {}
            for x in line:
                for node in where.get(x, ()):
                    k = place[node]
                    weight[k] = weight.get(k, 0) + 1
            last, row = line, sorted(weight.items())
        yield row


def grow(pages: list[list[tuple[int, list[int]]]]) -> Counter:
    """How many of the ``pages`` (label and fields of each line, in order) meet each label in the template that they grow.

    Labels that stand on one page only can't meet and take no part.
    """
    held = Counter(x for page in pages for x in {y for label, fields in page for y in (label, *fields)})
    often = {x for x, n in held.items() if n > 1}
    template: list[int] = []  # its nodes in order
    met: list[dict[int, int]] = []  # by node: how often it met each label
    where: dict[int, list[int]] = {}  # the nodes that met a label
    for page in pages:
        lines = [x for x in (often.intersection((label, *fields)) for label, fields in page) if x]
        place = [0] * len(met)
        for k, node in enumerate(template):
            place[node] = k
        pairs = dict(match_points(_points(lines, where, place)))
        grown, at = [], 0
        for i, line in enumerate(lines):
            k = pairs.get(i)
            if k is None:
                node = len(met)
                met.append({})
                grown.append(node)
            else:
                node = template[k]
                grown += template[at : k + 1]
                at = k + 1
            counts = met[node]
            for x in line:
                if x in counts:
                    counts[x] += 1
                else:
                    counts[x] = 1
                    where.setdefault(x, []).append(node)
        template = grown + template[at:]
    total: Counter = Counter()
    for counts in met:
        for x, n in counts.items():
            if n > 1:
                total[x] += n
    return total


def _by_page(column: pa.ChunkedArray) -> list[list[int]]:
    lists = column.combine_chunks()
    flat, ends = lists.values.to_numpy().tolist(), lists.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _templates(group: pa.Table) -> pa.Table:
    """Counts of one group: labels met by more than one page, and the pages that show each role."""
    first: dict = {}
    for k, doc in enumerate(group["doc_id"].to_pylist()):
        first.setdefault(doc, k)
    once = [first[doc] for doc in sorted(first)]
    labels, sizes, fields, roles = (_by_page(group[x]) for x in ("labels", "sizes", "fields", "roles"))
    met = grow([list(zip(labels[k], _fields(sizes[k], fields[k]))) for k in once])
    shown = Counter(r for k in once for r in set(roles[k]) if r < len(ROLES))
    keys, kinds, n = [*met, *[0] * len(shown), 0], [*[""] * len(met), *(KINDS[r] for r in shown), ""], [*met.values(), *shown.values(), len(once)]
    return pa.table({"host": pa.array([group["host"][0].as_py()] * len(n), pa.string()), "key": pa.array(keys, pa.int64()), "role": pa.array(kinds, pa.string()), "n": pa.array(n, pa.int64())})


def furniture_of(lines: list[int], roles: list[str], labels: list[int], fields: list[list[int]], constant: set[int], partly: set[int], never: set[str]) -> list[int]:
    """Numbers of the lines that are furniture: constant nodes, then roles, then slots of furniture lists."""
    met = [x in constant or (len(f) > 0 and 2 * sum(y in partly for y in f) >= len(f)) for x, f in zip(labels, fields)]
    held = [("other" if r in never else r) for r in roles]
    gone = [m or r in ROLES for m, r in zip(met, held)]
    for n, k in enumerate(lines[:-1]):  # a menu word above entries of the body is its heading
        alone = n == 0 or not gone[n - 1] or k - lines[n - 1] > 1
        if held[n] == "menu" and alone and len(fields[n]) == 0 and not met[n] and held[n + 1] in ("item", "prose", "other") and not gone[n + 1] and lines[n + 1] - k == 1:
            gone[n] = False
    order = range(len(lines))
    for step in (list(order), list(order)[::-1]):  # short lines that touch a list of links belong to it
        for a, b in zip(step, step[1:]):
            listed = held[a] in ("link", "list_head", "listed") if a < b else held[a] in ("link", "listed")
            if listed and not gone[b] and held[b] == "other" and abs(lines[a] - lines[b]) == 1:
                held[b], gone[b] = "listed", True
    return [k for k, g in zip(lines, gone) if g]


def find_furniture(docs: DataFrame, doc_id: str, text: str, url: str, support: float = 0.2, part: float = 0.1, rare: float = 0.02) -> DataFrame:
    """Rows (doc_id, line_no) of the lines that are not body.

    A role counts for nothing on a host of whose pages surely fewer than ``rare`` show it.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1), F.lit(""))).alias("host"),
    ).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    kind = base.schema["doc_id"].dataType.simpleString()
    trees = cut(base.mapInArrow(_trees, f"host string, doc_id {kind}, {PAGE}"))
    # Dealing needs no exact group size: a host of n pages falls into about n / GROUP groups.
    groups = trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    spread = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    dealt = trees.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL)).cast("int")).join(spread, ["host", "deal"])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("groups")).cast("int")).drop("deal", "groups")
    counts = dealt.groupBy("host", "salt").applyInArrow(_templates, "host string, key long, role string, n long").groupBy("host", "key", "role").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    pages = counts.filter("key = 0 AND role = ''").select("host", F.col("n").alias("pages"))
    # One row for each host; no more keys than the pages of a host have nodes, divided by the support.
    wrapper = (
        counts.filter("NOT (key = 0 AND role = '')")
        .join(pages, "host")
        .groupBy("host")
        .agg(
            F.collect_list(F.when((F.col("key") != 0) & (F.col("n") >= LEAST) & (F.col("n") >= F.col("pages") * support), F.col("key"))).alias("constant"),
            F.collect_list(F.when((F.col("key") != 0) & (F.col("n") >= LEAST) & (F.col("n") >= F.col("pages") * part), F.col("key"))).alias("partly"),
            F.collect_list(F.when((F.col("key") == 0) & (F.col("n") + 2 * F.sqrt("n") + 3 < F.col("pages") * rare), F.col("role"))).alias("never"),
        )
    )
    wrapper = groups.join(wrapper, "host", "left").select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "constant", "partly", "never")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sets = None, (set(), set(), set())
        for pdf in frames:
            ids, numbers = [], []
            for host, doc, lines, roles, labels, sizes, fields, c, p, v in zip(*(pdf[x] for x in ("host", "doc_id", "lines", "roles", "labels", "sizes", "fields", "constant", "partly", "never"))):
                if host != last:
                    last, sets = host, tuple(set(x) if x is not None else set() for x in (c, p, v))
                gone = furniture_of(lines.tolist(), [KINDS[r] for r in roles.tolist()], labels.tolist(), _fields(sizes.tolist(), fields.tolist()), *sets)
                ids += [doc] * len(gone)
                numbers += gone
            yield pd.DataFrame({"doc_id": ids, "line_no": numbers})

    gone = dealt.join(wrapper, ["host", "salt"]).mapInPandas(decide, f"doc_id {kind}, line_no int")
    return gone.distinct().select(F.col("doc_id").alias(doc_id), "line_no")


def body_only(docs: DataFrame, doc_id: str, text: str, url: str) -> DataFrame:
    """(doc_id, body): the text of each page without furniture; blank lines stay."""
    gone = find_furniture(docs, doc_id, text, url).groupBy(doc_id).agg(F.collect_set("line_no").alias("gone"))
    keep = F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(F.col("gone"), (at + 1).cast("int")))
    once = docs.select(doc_id, text).dropDuplicates([doc_id])
    return once.join(gone, doc_id, "left").select(doc_id, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n")).alias("body"))
