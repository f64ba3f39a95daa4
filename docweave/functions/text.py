"""Text measures and cleaning as Column expressions.

Patterns use explicit character ranges, so that they mean the same in every engine. ``length`` and
positions count Unicode characters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of contacts and of text that is cleaned away.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
PHONES = (r"0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}", r"0[0-9]{9,10}", r"[0-9]{2,3}-[0-9]{3,4}-[0-9]{4}")
COPYRIGHT = (r"copyright\s+©?\s*[0-9]{4}", r"©\s*[0-9]{4}", r"all rights reserved", r"저작권")
NAVIGATION = (r"home\s*[|>]\s*about\s*[|>]", r"홈\s*[>|]\s*소개\s*[>|]")
# Words without meaning for a search.
STOPWORDS = (
    "연구", "개발", "시스템", "기술", "응용", "분석", "설계", "구현", "이론", "기반", "관련", "등", "및", "를", "을", "는", "은", "이", "가", "의", "에", "와", "과", "도", "로", "으로", "부터", "까지", "연구실", "랩", "lab", "그룹", "group", "research", "development", "system", "systems", "technology", "application", "applications", "analysis", "design", "implementation", "theory", "based", "and", "or", "the", "a", "an", "of", "for", "in", "on", "at", "to", "from", "with", "laboratory",
)
# First rule that fits wins; url rules come before text rules.
SECTION_BY_URL = {
    "research": ("research", "lab", "연구"),
    "publication": ("publication", "paper", "pub", "논문"),
    "project": ("project", "프로젝트", "proj"),
    "people": ("people", "member", "team", "구성원", "멤버"),
    "join": ("join", "recruit", "admission", "모집", "입학"),
    "about": ("about", "intro", "소개"),
}
SECTION_BY_TEXT = {
    "publication": ("publication", "paper", "논문", "journal", "conference"),
    "research": ("research area", "research interest", "연구분야", "연구주제"),
    "project": ("project", "프로젝트", "과제"),
    "people": ("professor", "phd", "master", "교수", "박사", "석사"),
    "join": ("recruit", "admission", "join us", "모집", "지원"),
    "about": ("about", "overview", "소개", "개요"),
}


def any_of(text: Column, terms) -> Column:
    """Whether one of ``terms`` stands in ``text``."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def hits(text: Column, terms) -> Column:
    """How many of ``terms`` stand in ``text``."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])


def hangul(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[가-힣]"))


def latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[a-zA-Z]"))


def language(text: Column) -> Column:
    """ko, en, mixed or unknown by the shares of Hangul and Latin letters among all characters."""
    n = F.length(text).cast("double")
    ko, en = hangul(text) / n, latin(text) / n
    return F.when(text.isNull() | (n == 0), "unknown").when(ko > 0.4, "ko").when(en > 0.6, "en").when((ko > 0.1) | (en > 0.1), "mixed").otherwise("unknown")


def emails(text: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))
    return F.array_sort(F.filter(found, lambda x: F.length(x) < 100))


def urls(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    return F.array_sort(F.filter(F.transform(found, lambda x: F.rtrim(x, F.lit(".,;:)"))), lambda x: F.length(x) < 500))


def phones(text: Column) -> Column:
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHONES]))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    return F.array_sort(F.filter(found, lambda x: (digits(x) >= 9) & (digits(x) <= 11)))


def squeeze(text: Column) -> Column:
    """Runs of spaces and of line feeds shortened, tabs as spaces, ends trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), r"^[ \n\r\t]+", ""), r"[ \n\r\t]+$", "")


def without(text: Column, patterns) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", "")
    return text


def clean(text: Column) -> Column:
    """Copyright and navigation phrases removed, white space squeezed. (Unicode forms: see operators.chunking.nfkc.)"""
    return squeeze(without(without(text, COPYRIGHT), NAVIGATION))


def without_numbering(text: Column) -> Column:
    """Decimal and Roman section numbers at line starts removed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[0-9]+\.[ \t]+", ""), r"(?m)^[IVX]+\.[ \t]+", "")


def without_signs(text: Column) -> Column:
    """Only letters, digits, common punctuation and everything beyond ASCII stay."""
    return F.regexp_replace(text, r"[^A-Za-z0-9\s.,!?;:()\-'\"\x{80}-\x{10FFFF}]", "")


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \n\r\t]+"), lambda t: t != "")


def search_tokens(text: Column) -> Column:
    """Lower-case words without stop words."""
    return F.filter(word_tokens(text), lambda t: ~t.isin(*STOPWORDS))


def plain_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits of any script, without any other sign."""
    return F.filter(F.transform(word_tokens(text), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")), lambda t: t != "")


def may_hold(text: Column, term: str) -> Column:
    """Whether one of ``plain_tokens`` can hold ``term``: its letters in a row, at most with other signs between. Cheaper than the tokens."""
    between = r"[^\p{L}\p{N}_ \n\r\t]*"
    return F.lower(text).rlike(between.join(re.escape(c) for c in term))


def token_estimate(text: Column, lang: Column) -> Column:
    """Estimated model tokens by language."""
    h, n = hangul(text), F.length(text)
    words = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    numbers = F.regexp_count(text, F.lit("[0-9]+"))
    mixed = F.greatest(F.floor(h * 1.5 + words * 0.25 + numbers * 0.3), F.floor(n / 4))
    return F.when(lang == "ko", F.floor(h * 1.5 + (n - h) * 0.5)).when(lang == "en", F.floor(F.regexp_count(text, F.lit("[A-Za-z0-9_]+")) * 0.25)).otherwise(mixed).cast("int")


def chunk_tokens(text: Column) -> Column:
    """Estimated tokens of a chunk: Hangul, Latin words and all other signs weighted."""
    other = F.length(text) - hangul(text) - F.regexp_count(text, F.lit(r"[a-zA-Z \t\n\r]"))
    return F.floor(hangul(text) * 1.5 + F.regexp_count(text, F.lit("[a-zA-Z]+")) * 0.25 + other * 0.5).cast("int")


def section(text: Column, url: Column) -> Column:
    """Section of a page by its url, then by its text."""
    low_url, low = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    out = None
    for source, rules in ((low_url, SECTION_BY_URL), (low, SECTION_BY_TEXT)):
        for name, terms in rules.items():
            fits = any_of(source, terms)
            out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("general")


def paragraphs(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n{2,}"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^[ \n\r\t]+", ""), r"[ \n\r\t]+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def is_heading(line: Column) -> Column:
    """Short, and with a colon at the end, a number at the start, or all in capitals."""
    return (F.length(line) < 100) & (line.endswith(":") | line.rlike(r"^[0-9]+\.?[ \t]") | ((F.upper(line) == line) & (F.lower(line) != line)))
