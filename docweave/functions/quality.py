"""Quality scores, exclusion rules and personal-information cues as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import hangul, hits, latin

# Urls that are not indexed, in the order in which they are tried.
EXCLUDED_URLS = (r"/login", r"/signin", r"/signup", r"/register", r"/admin", r"/portal", r"/mypage", r"/privacy", r"/personal", r"/auth", r"/password", r"\?(.*&)?(password|token|key|secret)=", r"/download/.*\.(exe|zip|rar)")
# Words that hint at personal information.
PII_KEYWORDS = (
    "login", "password", "signin", "signup", "register", "personal information", "credit card", "social security", "passport", "driver license", "authentication",
    "로그인", "비밀번호", "회원가입", "개인정보", "주민등록번호", "신용카드", "여권", "운전면허", "인증", "본인확인", "portal", "intranet", "인트라넷", "사내망", "vpn",
)
# Input fields that ask for personal information.
FORM_FIELDS = (
    (r"type=[\"']password[\"']", "password"), (r"type=[\"']email[\"']", "email"), (r"type=[\"']tel[\"']", "phone"), (r"name=[\"'].*password.*[\"']", "password"),
    (r"name=[\"'].*email.*[\"']", "email"), (r"name=[\"'].*phone.*[\"']", "phone"), (r"id=[\"'].*password.*[\"']", "password"),
)
# Words that a section's text should hold.
SECTION_WORDS = {
    "research": ("research", "study", "investigation", "연구", "학습", "ai", "ml", "deep learning", "algorithm", "알고리즘", "computer vision", "nlp", "robotics"),
    "publication": ("paper", "journal", "conference", "논문", "publication", "proc", "proceedings", "cvpr", "iccv", "neurips", "published", "게재", "accepted"),
    "project": ("project", "grant", "과제", "프로젝트", "funded", "funding", "지원금", "research grant", "nrf"),
    "people": ("professor", "student", "phd", "master", "교수", "학생", "박사", "석사", "학부생", "researcher", "postdoc"),
    "join": ("recruit", "admission", "apply", "모집", "지원", "입학", "application", "deadline", "마감", "requirement"),
    "about": ("about", "overview", "introduction", "소개", "개요", "mission", "vision", "goal", "목표", "established"),
}


def excluded_by(url: Column) -> Column:
    """The first exclusion pattern that fits a url, null where none does."""
    return F.coalesce(*[F.when(F.lower(url).rlike(p), F.lit(p)) for p in EXCLUDED_URLS])


def pii_keywords(text: Column) -> Column:
    """The cues that stand in a text, in the order in which they are declared."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(k) for k in PII_KEYWORDS]), lambda k: low.contains(k))


def form_fields(html: Column) -> Column:
    low = F.lower(html)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(kind)) for p, kind in FORM_FIELDS])))


def section_score(text: Column, section: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in SECTION_WORDS.items():
        score = F.least(hits(low, words) * 2.0 / len(words), F.lit(1.0))
        out = F.when(section == name, score) if out is None else out.when(section == name, score)
    return out.otherwise(0.5)


def length_score(n: Column) -> Column:
    return F.when(n.between(200, 400), 1.0).when(n.between(150, 500), 0.8).when(n.between(100, 600), 0.6).otherwise(0.3)


def language_score(text: Column, mixed: float = 0.6) -> Column:
    h, e = hangul(text), latin(text)
    share = F.greatest(h, e) / F.nullif(h + e, F.lit(0)).cast("double")
    return F.when(h + e == 0, 0.5).when(share >= 0.8, 1.0).when(share >= 0.6, 0.8).otherwise(mixed)


def duplicate_score(copies: Column) -> Column:
    return F.when(copies <= 1, 1.0).when(copies == 2, 0.5).otherwise(0.0)


def overall(section: Column, length: Column, language: Column, duplicate: Column) -> Column:
    return section * 0.3 + length * 0.25 + language * 0.25 + duplicate * 0.2


def reasons(section: Column, length: Column, language: Column, duplicate: Column, review: Column) -> Column:
    named = F.array_compact(F.array(F.when(section < 0.5, "섹션 불일치"), F.when(length < 0.5, "길이 부적절"), F.when(language < 0.5, "언어 불일관"), F.when(duplicate < 0.5, "중복 발견")))
    return F.when(~review, "").when(F.size(named) == 0, "복합 요인").otherwise(F.array_join(named, ", "))


def ingest_score(n: Column, lang: Column, tokens: Column, title: Column) -> Column:
    """0 to 100 by length, language, tokens and title."""
    score = F.lit(50) + F.when(n > 500, 20).when(n > 300, 10).otherwise(0) + F.when(lang.isin("ko", "en"), 15).otherwise(0) + F.when(tokens > 100, 10).otherwise(0) + F.when(title.isNotNull() & (title != ""), 5).otherwise(0)
    return F.least(score, F.lit(100))


def site_score(pages: Column) -> Column:
    """0 to 70 by the number of pages that a crawl brought."""
    return F.when(pages > 0, 30).otherwise(0) + F.when(pages >= 5, 40).when(pages >= 2, 20).otherwise(0)
