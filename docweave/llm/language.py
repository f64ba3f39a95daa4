"""Language of a document and of the stretches of a mixed one.

Cross-parsing entropy: for each language a suffix automaton is built over labelled text. A sentence
is parsed greedily into the longest pieces that the automaton knows; the language that needs the
fewest pieces for its length wins. A parse is given up as soon as it needs twice the pieces of the
best one, which changes no winner. The confidence is how many more pieces the second language
needs, from 0 (as many) to 1 (twice as many or more).

The automata are fitted on a bounded sample: ``SAMPLE_DOCS`` documents for each language, those
with the lowest hash of their id, up to ``SAMPLE_CHARS`` characters. The labelled text may come from
a table whose labels are mostly right; sentences whose letter pairs speak against their label are
left out. The sample is
the only text that reaches the driver; every document is classified as a whole.

Only whole sentences of the main text count. Lines in a furniture role, list items, headings,
entries and notices say nothing about the language, unless a page has nothing else.

Defined results: rows without id and null or empty texts, and texts without letters, get no language; repeated rows
count once; an empty table, or one without any usable label, gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.page_body import ROLES, role_of

SAMPLE_DOCS = 160
SAMPLE_CHARS = 30_000
# How labels name a language, in lower case and without region.
NAMES = {
    "ko": ("ko", "kor", "korean", "한국어"),
    "en": ("en", "eng", "english", "영어"),
    "ja": ("ja", "jpn", "jp", "japanese", "일본어"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "중국어"),
    "de": ("de", "deu", "ger", "german", "독일어"),
    "fr": ("fr", "fra", "fre", "french", "프랑스어"),
    "mixed": ("mixed", "mul", "multi", "multiple", "혼합"),
}
_CODE_OF = {n: k for k, names in NAMES.items() for n in names}
_SENTENCE = re.compile(r"(?<![ .][A-Z]\.)(?<=[.!?])[\"')\]”’]*\s+|(?<=[。！？])")
_WHOLE = re.compile(r"[.!?。！？][\"')\]”’」』]*$")
_ENTRY = re.compile(r"[\"“«「].+[\"”»」].*\d{4}[.)]?$|^\[\d+\]|https?://|\bdoi\b|\bISSN\b")
# Sentences of a page's furniture, and shapes of titles; neither is main text.
_NOTICE = re.compile(
    r".*(?:소식방에 공유|공유해 주세요|Share it with|Share this|소식지를 받아|구독 단추|readers already did|Subscribe to the|Follow us on|누리집에 오신 것을 환영).*|Content of .* may not be .*|.{4,80}(?:연구실|연구소|센터)\s*\|.*(?:전화|Tel).*|.*(?:Laboratory|Lab|Center|Centre)\b.*,.*\bTel\b.*", re.I
)
_TITLE = re.compile(
    r"(?:[·▸◦]\s*)?(?:[A-Z][\w-]+ (?:프로젝트 개요|과제 요약)|.{2,40}(?:세미나 안내|참여 안내|실험 장비|소개|연구)|Seminar: .{3,60}|\d{4}년 .{2,30} 성과|The [\w-]+ project|Summary of the [\w-]+ study|About .{3,50}|Joining our work on .{3,50}|\d{4} results in .{3,50}|Research on .{3,60}|(?:Equipment|Instruments) for .{3,50}|Le projet \S+|À propos .{3,60}|Recherche .{3,60}|Das Vorhaben \S+|Forschung zu[rm]? .{3,60}|(?:关于|關於).{2,30}|.{2,30}(?:について|の紹介|研究|项目|プロジェクト|简介))(?:\s*\(\d+\))?"
)
_FOLD = re.compile(r"\d+")
_LATIN = re.compile(r"[a-z][a-z0-9@._+-]*")
_LETTER = re.compile(r"[^\W\d_]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣]")


def code_of(label: str | None) -> str | None:
    """The code that a label names, or None where it names none."""
    if not label:
        return None
    return _CODE_OF.get(re.split(r"[-_\s(]", label.strip().lower())[0])


_NOWHERE: dict = {}  # the state after a sign that a language does not know


def automaton(text: str) -> dict:
    """Suffix automaton of ``text``; each state is the dictionary of its transitions, the first one is returned."""
    nxt: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for state in nxt:  # numbers to the states themselves, for a fast parse
        for c, k in state.items():
            state[c] = nxt[k]
    return nxt[0]


def pieces(text: str, root: dict, limit: int) -> int:
    """Number of longest known pieces that ``text`` falls into; more than ``limit`` is not counted out."""
    n, state = 0, _NOWHERE
    for c in text:
        state = state.get(c)
        if state is None:
            n += 1
            if n > limit:
                return n
            state = root.get(c, _NOWHERE)
    return n


def fold(text: str) -> str:
    """Lower case without numbers; names in Latin letters inside other scripts fall together."""
    text = _FOLD.sub("0", text.lower())
    return _LATIN.sub("x", text) if _WIDE.search(text) else text


class Identifier:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.roots = {k: automaton(fold(v)) for k, v in samples.items() if v}

    def of(self, text: str, first: str | None = None) -> tuple[str, float]:
        """(language, confidence) of a piece of text; ``first`` is tried before the others."""
        text = fold(text)
        order = ([first] if first in self.roots else []) + [k for k in self.roots if k != first]
        best, second, winner = len(text) + 1, 2 * len(text) + 2, ""
        for k in order:
            n = pieces(text, self.roots[k], min(2 * best, second))
            if n < best:
                best, second, winner = n, best, k
            elif n < second:
                second = n
        return winner, round(min(1.0, second / best - 1.0), 4)


def main_sentences(text: str) -> tuple[list[str], list[str]]:
    """Whole sentences of the main text in order; and its other lines, for pages without sentences."""
    paragraphs: list[list[str]] = []
    other: list[str] = []
    open_line = False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            open_line = False
            continue
        role = role_of(line)
        if role in ROLES or _NOTICE.fullmatch(line):
            continue  # furniture may stand between the halves of a wrapped sentence
        if role == "item" or _TITLE.fullmatch(line) or _ENTRY.search(line):
            other.append(line)
            open_line = False
        elif open_line:
            paragraphs[-1].append((" " if not _WIDE.match(line) or _WIDE.match(line)[0] >= "가" else "") + line)
            open_line = not _WHOLE.search(line)
        else:
            paragraphs.append([line])
            open_line = not _WHOLE.search(line)
    whole = []
    for p in paragraphs:
        for s in _SENTENCE.split("".join(p)):
            if _WHOLE.search(s):
                whole.append(s)
            elif s:
                other.append(s)
    return whole, other


def enough(sentence: str) -> bool:
    """Long enough to be told apart: words, not a name or a term."""
    return len(_WIDE.findall(sentence)) >= 6 or (len(sentence) >= 20 and len(sentence.split()) >= 4)


def segments(text: str, ident: Identifier, sure: float = 0.7) -> list[tuple[str, float, int]]:
    """(language, confidence, characters) of the longest runs of sentences in one language, in reading order."""
    if not _LETTER.search(text):
        return []
    whole, other = main_sentences(text)
    runs: list[list] = []
    for s in whole:
        lang, conf = ident.of(s, runs[-1][0] if runs else None)
        if runs and (lang == runs[-1][0] or conf < sure or not enough(s)):
            runs[-1][1] += conf * len(s)
            runs[-1][2] += len(s)
        elif enough(s) or not runs:
            runs.append([lang, conf * len(s), len(s)])
    if not runs:
        rest = " ".join(other)
        rest = rest if _LETTER.search(rest) else text
        lang, conf = ident.of(rest)
        return [(lang, conf, len(rest))]
    if len(runs) > 1 and runs[0][1] < sure * runs[0][2]:  # an unsure beginning goes with what follows
        runs[1][1] += runs[0][1]
        runs[1][2] += runs[0][2]
        runs = runs[1:]
    merged: list[list] = []
    for r in runs:
        if merged and merged[-1][0] == r[0]:
            merged[-1][1] += r[1]
            merged[-1][2] += r[2]
        else:
            merged.append(r)
    return [(k, round(c / n, 4), n) for k, c, n in merged]


def sample_texts(docs: DataFrame, doc_id: str, text: str, label: str) -> dict[str, str]:
    """Labelled text for each language, at most SAMPLE_DOCS documents and SAMPLE_CHARS characters."""
    code = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([^-_\s(]+)", 1))
    lang = F.coalesce(*[F.when(code.isin(*names), F.lit(k)) for k, names in NAMES.items() if k != "mixed"])
    ids = (
        docs.select(F.col(doc_id).alias("doc_id"), lang.alias("lang"))
        .filter("doc_id IS NOT NULL AND lang IS NOT NULL")
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
        .filter(F.col("at") <= SAMPLE_DOCS)
        .select("doc_id", "lang")
        .distinct()
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        if r["text"]:
            by.setdefault(r["lang"], []).extend(fold(x) for x in main_sentences(r["text"])[0] if enough(x))
    return cleaned({k: v for k, v in by.items() if v})


def cleaned(by: dict[str, list[str]]) -> dict[str, str]:
    """Sample text for each language without the sentences that stand under a wrong label.

    A letter pair is more frequent among the sentences of its own language than among those of
    another one that hold some by mistake, as long as nearly all labels are right. A sentence stays
    if the frequencies of its letter pairs speak for its label.
    """
    pairs = {k: [{x[i : i + 2] for i in range(len(x) - 1)} for x in v] for k, v in by.items()}
    rate = {k: {p: log((n + 0.5) / (len(v) + 1)) for p, n in Counter(p for x in v for p in x).items()} for k, v in pairs.items()}
    none = {k: log(0.5 / (len(v) + 1)) for k, v in by.items()}
    out = {}
    for k, v in by.items():
        kept = [x for x, ps in zip(v, pairs[k]) if max(rate, key=lambda m: sum(rate[m].get(p, none[m]) for p in ps)) == k]
        out[k] = " ".join(dict.fromkeys(kept or v))[:SAMPLE_CHARS]
    return out


_ready: dict[int, Identifier] = {}  # of each Python worker


def identify(docs: DataFrame, doc_id: str, text: str, label: str, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, label, seg_no, lang_found, confidence, n_chars): seg_no 0 for each document, 1, 2, ... for the stretches of a mixed one.

    ``labelled`` holds the labelled text (columns of the same names); ``docs`` itself if not given.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sample_texts(docs if labelled is None else labelled, doc_id, text, label))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("doc_id IS NOT NULL")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(sorted(shared.value.items())))
        if key not in _ready:
            _ready.clear()
            _ready[key] = Identifier(shared.value)
        ident = _ready[key]
        for pdf in frames:
            rows = []
            for doc, t, lab in zip(pdf["doc_id"], pdf["text"], pdf["label"]):
                runs = segments(t, ident) if t and ident.roots else []
                if not runs:
                    continue
                total = sum(n for _, _, n in runs)
                rows.append((doc, lab, 0, runs[0][0] if len(runs) == 1 else "mixed", round(sum(c * n for _, c, n in runs) / total, 4), total))
                if len(runs) > 1:
                    rows += [(doc, lab, k, lang, conf, n) for k, (lang, conf, n) in enumerate(runs, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "lang_found", "confidence", "n_chars"])

    return base.mapInPandas(run, f"doc_id {kind}, label string, seg_no int, lang_found string, confidence double, n_chars int")


def find_wrong_labels(docs: DataFrame, doc_id: str, text: str, label: str, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, seg_no, lang_found) of the documents without a right label, and of the stretches of every mixed one."""
    code = F.lower(F.regexp_extract(F.trim(F.col("label")), r"^([^-_\s(]+)", 1))
    named = F.coalesce(*[F.when(code.isin(*names), F.lit(k)) for k, names in NAMES.items()])
    found = identify(docs, doc_id, text, label, labelled).withColumn("named", named)
    return found.filter((F.col("seg_no") > 0) | F.col("named").isNull() | (F.col("named") != F.col("lang_found"))).select(F.col("doc_id").alias(doc_id), "seg_no", "lang_found").distinct()
