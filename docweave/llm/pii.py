"""Personal information in free text: finding it and putting typed placeholders in its place.

Bootstrapped contextual extraction. One pass over the texts writes down every *mention*: a span
that has the shape of an address, a number or a name, with the words around it as its *pattern*.
Shapes are loose, so most mentions are none. Mentions form a graph of patterns and instances, one for
all kinds, which is scored in turns from seeds:

* names that are known (a given list) or that e-mail users spell,
* e-mail addresses, phone numbers and street addresses in their full usual form,
* numbers whose digits can be a date of birth, and numbers under a label that names a document.

A pattern is good if enough of its distinct instances are known; good patterns make their other
instances known, known instances lead to further patterns, and so on for some rounds. Mentions of a
good pattern are taken. A mention in full form is taken as well, unless its pattern nearly always
stands at something else. Distinct instances are counted, so copies of a corpus change nothing.

The graph is combined to counted edges before it is joined, and rounds only touch edges. Patterns
and instances that are frequent are spread by salt. The mentions are written to the checkpoint folder once.

Defined results: rows without id and null or empty texts have no rows; a row that stands twice counts once; spans
never overlap, the one in full form or the longer one stays; ids that are equal in two tables are kept apart by
the table name; without seeds names are only found by e-mail users; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.session import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
SALTS = 16
_D = "0-9０-９"
# Latin letters with and without marks: capitals, small letters.
_U = "A-ZÀ-ÖØ-ÞĄĆČĎĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽ"
_L = "a-zß-öø-ÿāăąćčďēęěğīıłńňōőœřśşšťūůűźżž"
_USER = _U + _L + "0-9._%+-"
_AT = r"\s?(?:[@＠]|\(at\)|\[at\]|\{at\}|(?<=\s)AT(?=\s))\s?"
_HOST = rf"[{_U}{_L}0-9-]+(?:(?:\.|\s?[\[({{]dot[\])}}]\s?)[{_U}{_L}0-9-]+)*(?:\.|\s?[\[({{]dot[\])}}]\s?)[A-Za-z]{{2,}}"
EMAIL = re.compile(rf"[{_U}{_L}0-9][{_USER}]*{_AT}{_HOST}")
SPELLED_EMAIL = re.compile(rf"(?<![\w.])[{_U}{_L}0-9][{_USER}]*\s(?:at|AT|@|골뱅이)\s[{_U}{_L}0-9-]+(?:\s(?:dot|DOT|점)\s[{_U}{_L}0-9-]+)+")
# These begin with a class of signs, so that a search passes other signs fast; what may not stand before is asked after it.
PHONE = re.compile(
    rf"[+＋(（0０](?<![\w+＋.-].)(?:(?<=[+＋])[{_D}]{{1,3}}[-. \n－]?(?:[(（]0[)）])?[{_D}]{{1,3}}[-. \n－]?[{_D}]{{3,4}}[-. \n－]?[{_D}]{{4}}"
    rf"|(?:(?<=[(（])[0０][{_D}]{{1,2}}[)）]|(?<=[0０])[{_D}]{{1,2}}[)）]?)[-. \n－]?[{_D}]{{3,4}}[-. \n－]?[{_D}]{{4}}|(?<=[(（])[{_D}]{{3}}[)）] ?[{_D}]{{3}}[-. \n－][{_D}]{{4}})(?![{_D}])(?!-[{_D}])"
)
GROUPS = re.compile(r"[\d(](?<![\w+.,/-].)(?:(?<=\()\d{2,4}\)\s?|(?<=\d)\d{1,3}[-. ])(?:\d{2,4}[-. ]){1,3}\d{2,4}(?![\w%]|[-.,/]\d)")
NUMBER = re.compile(r"[\dA-Z](?<![\w.-].)(?:(?<=\d)(?:\d{5}\s?[-–]?\s?\d{7}|\d{2}-\d{2}-\d{4}|\d{6,11})|(?<=[A-Z])[A-Z]{0,2}\d{5,9})(?![0-9A-Za-z]|-\d|\.\d)")
ADDRESS_KO = re.compile(
    r"(?:[(（]\d{5}[)）]\s*|(?<!\d)\d{5},?\s+)?(?:(?:[가-힣]+[시도]\s+)?[가-힣]+[구군시]\s+(?:[가-힣]+[읍면동]\s+)?[가-힣]+[로길]\s?\d+(?:-\d+)?(?:번지)?|[가-힣]+[로길]\s?\d+(?:-\d+)?번지)(?:,?\s*\d+동)?(?:,?\s+[가-힣A-Za-z]+(?=,?\s+\d+[층호]))?(?:,?\s*\d+층)?(?:,?\s*\d+호)?"
)
ADDRESS_EN = re.compile(
    r"\d(?<![\w-].)\d{0,4}[ \n](?:[A-Z][a-z]+[ \n]){1,3}(?:Lane|Road|Avenue|Street|Drive|Way|Court|Place|Close|Boulevard|Terrace|Row|Crescent|Rd|St|Ave)\b(?:,[ \n](?:Apt|Suite|Unit|Floor|Room)\.?[ \n]\d+[A-Z]?)?(?:,[ \n][A-Z][a-z]+(?:[ \n][A-Z][a-z]+)?(?:,? \d{5})?)?"
)
_TOWN = rf",[ ]\d{{4,6}}[ ][{_U}][{_L}]+(?:[ -][{_U}][{_L}]+)*"
PLACE = re.compile(rf"\d(?<![\w-].)\d{{0,4}}[A-Za-z]?,?(?:(?:[ ][{_U}{_L}'’-]+){{1,6}}{_TOWN}|(?:[ ][{_U}][{_L}]+){{1,4}})")
TOWN_PLACE = re.compile(rf"[{_U}](?<![\w-].)[{_L}]+(?:[ -][{_U}{_L}]+){{0,4}}[ ]\d{{1,4}}[a-z]?{_TOWN}")
TOWN_SIGN = re.compile(rf",[ ]\d{{4,6}}[ ][{_U}]")
# The rare part of a pattern; the whole pattern is only tried around it.
EMAIL_SIGN = re.compile(r"[@＠([{\s](?:(?<=[@＠])|(?<=\()at\)|(?<=\[)at\]|(?<=\{)at\}|(?<=\s)AT\s)")
ROAD = re.compile(r"[로길]\s?\d")
SPELLED_SIGN = re.compile(r"\s(?:dot|DOT|점)\s")
# Family names as they begin a Korean name.
FAMILY = "김이박최정강조윤장임한오서신권황안송류홍유전고문양손배백허남심노하곽성차주우구민진지엄원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모"
FAMILY_LONG = "남궁|제갈|선우|황보|독고|사공|서문|동방"
HANGUL_NAME = re.compile(rf"(?<![가-힣A-Za-z0-9])(?:(?:{FAMILY_LONG}) ?[가-힣]{{2}}|[{FAMILY}] ?[가-힣][가-힣])(?<![를을에])(?=[^가-힣]|$|(?:이|은|는|가|의|과|와|을|를|도|님|씨|에게|이며|이고|입니다)(?![가-힣])|이며|입니다)")
_NAME = rf"(?:[OD]['’])?[{_U}][{_L}]+(?:[-'’][{_U}]?[{_L}]+)*"
LATIN_NAME = re.compile(rf"[{_U}](?<![{_U}{_L}0-9@.+/_-].)(?:[{_U}]+ {_NAME}|(?:['’][{_U}])?[{_L}]+(?:[-'’][{_U}]?[{_L}]+)*(?: [{_U}]\.)? {_NAME})(?![{_U}{_L}@_/-]|\.[{_U}{_L}])")
_GENERIC = re.compile(r"no\.?:?|:|number:?|ID:?|번호[은는:]*")  # says of a number nothing but that it is one
_TOKEN = re.compile(r"\S+")
_END = re.compile(r"[.!?。！？]$")


def valid_number(text: str) -> bool:
    """Whether a number can be a resident registration: a date of birth and a digit for the century."""
    digits = re.sub(r"\D", "", text)
    return len(digits) == 13 and 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= 31 and digits[6] in "1234"


@lru_cache(maxsize=100_000)
def name_key(text: str) -> str:
    """A name without spaces, marks and initials; in Latin letters given name first."""
    if text[0] >= "가":
        return re.sub(r"\s", "", text)
    words = [w for w in text.split() if not re.fullmatch(rf"[{_U}]\.", w)]
    if len(words) == 2 and words[0].isupper() and len(words[0]) > 1:
        words.reverse()
    plain = unicodedata.normalize("NFD", "".join(words).lower())
    return re.sub(r"[^a-z]", "", plain) or "".join(words).lower()


@lru_cache(maxsize=100_000)
def skeleton(token: str) -> str:
    """A neighbouring word with names and numbers as slots."""
    if "@" in token or "＠" in token:
        return "E"
    if _END.search(token):
        return "."
    token = re.sub(r"[A-Z][A-Za-z.-]*[a-z]|[A-Z]{2,}", "W", re.sub(r"\d+", "0", token))
    return re.sub(rf"(?<![가-힣])(?:{FAMILY_LONG}|[{FAMILY}])[가-힣]{{2}}(?=[,;·/]|$)", "N", token)


@lru_cache(maxsize=100_000)
def right_skeleton(token: str) -> str:
    """The word after a span with names and numbers as slots, its first signs only."""
    if re.match(r"[(（][A-Za-z0-9]", token):
        return "("
    return re.sub(r"\d+", "0", re.sub(r"[A-Z][A-Za-z-]+", "W", token))[: 2 if "ぁ" <= token[0] < "가" else 4]


def context(text: str, start: int, end: int, before_end: int) -> str:
    """The pattern of a span: the word before it and the word after it, within its line.

    ``before_end`` is the end of the span before; a span that follows it in a list has that as its left side.
    """
    a = text.rfind("\n", max(0, start - 24), start) + 1 or max(0, start - 24)
    left = text[a:start]
    before = left.split()
    left_key = "^" if not before and (a == 0 or text[a - 1] == "\n") else skeleton(before[-1])[-5:] if before else "."
    if before and left[-1:].strip():
        left_key += "_"
    joint = text[before_end:start].strip() if 0 <= start - before_end <= 6 else None
    if joint in (",", ";", "·", "/", "and", ", and", "&", "및"):
        left_key = "N" + joint
    right = text[end : end + 16].split("\n", 1)[0]
    m = _TOKEN.search(right)
    right_key = "$" if not m else (" " if m.start() else "") + right_skeleton(m[0])
    return left_key + "\t" + right_key


def _emails(text: str) -> Iterator[re.Match]:
    """Each address around its sign: from the sign to the left as far as a user name can reach."""
    if not any(x in text for x in ("@", "＠", "at", "AT")):
        return
    user, end = _CHARS, 0
    for s in EMAIL_SIGN.finditer(text):
        i = s.start()
        if i < end:
            continue
        if i > end and text[i - 1].isspace():
            i -= 1
        while i > end and text[i - 1] in user:
            i -= 1
        while i < s.start() and text[i] in "._%+-":
            i += 1
        m = EMAIL.match(text, i)
        if m and m.end() > s.start():
            end = m.end()
            yield m


_CHARS = frozenset(chr(c) for c in range(0x180) if re.match(f"[{_USER}]", chr(c)))


def _roads(text: str) -> Iterator[re.Match]:
    """Each Korean address around its road and number: at most four words and a postal code stand before them."""
    end = 0
    for s in ROAD.finditer(text):
        at = s.start()
        if at < end:
            continue
        starts = []
        while len(starts) < 6:
            i = at
            while i > end and text[i - 1].isspace():
                i -= 1
            j = i
            while j > end and "가" <= text[j - 1] <= "힣":
                j -= 1
            if j == i:  # no Hangul word: a postal code, or the beginning
                for k in range(max(end, i - 8), i):
                    m = _POSTAL.match(text, k)
                    if m and m.end() == i:
                        starts.append(k)
                        break
                break
            starts.append(j)
            at = j
        for k in reversed(starts):
            m = ADDRESS_KO.match(text, k)
            if m and m.end() > s.start() + 1:
                end = m.end()
                yield m
                break


_POSTAL = re.compile(r"(?<!\d)[(（]?\d{5}[)）]?,?")


def label_of(text: str, start: int) -> str:
    """The word before a span within its line, digits as a slot; '' at the line's beginning."""
    i = start
    while i and text[i - 1] in " \t":
        i -= 1
    j = i
    while j and not text[j - 1].isspace() and i - j < 40:
        j -= 1
    return re.sub(r"\d+", "0", text[j:i]).strip("([{<\"'“‘|·:：")[-20:].lower()


def number_label(text: str, start: int) -> str:
    """The words under which a number stands: the last one before it, and those before that as long as they say no more than "number"."""
    words: list[str] = []
    i = start
    while len(words) < 3:
        while i and text[i - 1].isspace():
            i -= 1
        j = i
        while j and not text[j - 1].isspace() and i - j < 40:
            j -= 1
        if j == i:
            break
        words.insert(0, text[j:i])
        if not _GENERIC.fullmatch(text[j:i]):
            break
        i = j
    return re.sub(r"[^\w]|(?:번?호)?[은는]$", "", " ".join(words)).lower()


COLUMNS = ["table_name", "doc_id", "start_pos", "end_pos", "pii_kind", "instance", "pattern", "evidence", "within"]


def mentions(text: str) -> list[tuple[int, int, str, str, str, int, int]]:
    """(start, end, kind, instance, pattern, evidence, within) of all spans that may be personal information.

    evidence is 2 where the form is the full usual one of its kind, 1 where a number can be valid, 0
    otherwise; ``within`` is the start of a loose span that a name stands in, -1 where there is none.
    """
    out: list[tuple[int, int, str, str, str, int, int]] = []
    taken = bytearray(len(text))  # 1 where a span in full form stands, 2 where a loose one does

    def free(m: re.Match) -> bool:
        return not any(taken[m.start() : m.end()])

    def take(m: re.Match, kind: str, instance: str, pattern: str, evidence: int) -> None:
        out.append((m.start(), m.end(), kind, instance, pattern, evidence, -1))
        taken[m.start() : m.end()] = (b"\x01" if evidence == 2 else b"\x02") * (m.end() - m.start())

    for kind, spans in (("email", _emails(text)), ("street_address", _roads(text)), ("street_address", ADDRESS_EN.finditer(text)), ("phone", PHONE.finditer(text))):
        for m in spans:
            if kind != "phone" or free(m):
                take(m, kind, m[0], label_of(text, m.start()), 2)
    for m in NUMBER.finditer(text):
        if free(m):
            t = m[0]
            shape = re.sub(r"[A-Z]+", "A", re.sub(r"\d", "0", re.sub(r"\s", "", t)))
            take(m, "id_number", re.sub(r"\W", "", t), shape + "\t" + number_label(text, m.start()), int(valid_number(t)))
    if SPELLED_SIGN.search(text):
        for m in SPELLED_EMAIL.finditer(text):
            if free(m):
                take(m, "email", m[0], label_of(text, m.start()), 0)
    loose = [("phone", GROUPS), *([("street_address", TOWN_PLACE)] if TOWN_SIGN.search(text) else []), ("street_address", PLACE)]
    for kind, shape in loose:
        for m in shape.finditer(text):
            if free(m):
                take(m, kind, m[0], label_of(text, m.start()), 0)
    last = -9
    for start, end, name in sorted((*m.span(), m[0]) for rx in (HANGUL_NAME, LATIN_NAME) for m in rx.finditer(text)):
        if taken.find(1, start, end) < 0:
            within = taken.find(2, start, end)
            while within > 0 and taken[within - 1] == 2:
                within -= 1
            out.append((start, end, "person_name", name_key(name), context(text, start, end, last), 0, within))
            last = end
    return out


def _mentions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), 1000):  # a text has many mentions
            part = pdf.iloc[at : at + 1000]
            yield pd.DataFrame([(n, d, *m) for n, d, t in zip(part["table_name"], part["doc_id"], part["text"]) if t for m in mentions(t)], columns=COLUMNS)


# Words that name a document in the label of its number.
ID_LABELS = ("학번", "여권", "주민", "passport", "studentid", "studentno", "studentnumber", "resident", "ssn", "socialsecurity")


def spread(left: DataFrame, right: DataFrame, keys: list[str], how: str, by: list[str]) -> DataFrame:
    """A join whose left side may have frequent keys: its rows are dealt by ``by``, the right side is repeated for each deal."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def find_pii(texts: DataFrame, seeds: DataFrame, rounds: int = 3) -> DataFrame:
    """Rows (table_name, doc_id, start_pos, end_pos, pii_kind) for ``texts`` (table_name, doc_id, text).

    ``seeds`` holds known names (column ``name``), in any spelling and with or without titles.
    """
    doc_kind = texts.schema["doc_id"].dataType.simpleString()
    found = cut(
        texts.select("table_name", "doc_id", "text")
        .filter("doc_id IS NOT NULL")
        .mapInPandas(_mentions, f"table_name string, doc_id {doc_kind}, start_pos int, end_pos int, pii_kind string, instance string, pattern string, evidence int, within int")
    )
    key = ["pii_kind", "pattern"]
    edges = cut(found.groupBy("pii_kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("evidence").alias("evidence")))

    # Seeds: known names, names that e-mail users spell, full forms, valid numbers, numbers under a label that names a document.
    part = r"^([a-z]+)[._]([a-z]+)\s?(?:@|＠|\(|\[|at)"
    users = (
        edges.filter("pii_kind = 'email'")
        .select(F.regexp_extract(F.lower("instance"), part, 1).alias("a"), F.regexp_extract(F.lower("instance"), part, 2).alias("b"))
        .filter("a <> '' AND b <> ''")
        .select(F.lit("person_name").alias("pii_kind"), F.concat("a", "b").alias("instance"))
    )
    name = F.pandas_udf(lambda names: names.map(lambda x: name_key(x) if x else ""), "string")
    bare = F.trim(F.regexp_replace("name", r"\(.*?\)|(?:교수|박사|연구원|님|씨|Prof\.?|Dr\.?|professor)\s*$|^(?:Prof\.?|Dr\.?|professor|교수)\s+", ""))
    given = seeds.select(F.lit("person_name").alias("pii_kind"), name(bare).alias("instance")).filter("instance <> ''")
    names_document = reduce(lambda a, b: a | b, [F.split("pattern", "\t")[1].contains(x) for x in ID_LABELS])
    labelled = (F.col("pii_kind") == "id_number") & names_document
    certain = edges.filter((F.col("evidence") > 0) | labelled).select("pii_kind", "instance")
    start = cut(given.unionByName(users).unionByName(certain).distinct())

    label = F.element_at(F.split("pattern", "\t"), -1)
    known, best = start, None
    for turn in range(rounds):
        least, share = [(2, 0.004), (3, 0.04), (3, 0.1)][min(turn, 2)]
        scored = (
            spread(edges, known.withColumn("known", F.lit(1)), ["pii_kind", "instance"], "left", ["pattern"])
            .groupBy(*key)
            .agg(F.count("*").alias("instances"), F.sum(F.coalesce("known", F.lit(0))).alias("known"), F.sum((F.col("evidence") > 0).cast("int")).alias("formed"))
        )
        n, k = F.col("instances"), F.col("known")
        good = (
            F.when(F.col("pii_kind") == "person_name", (k >= least) & (k >= n * share))
            .when(F.col("pii_kind") == "id_number", (k >= 1) & (k >= n * 0.5) & (label != ""))
            .otherwise((k >= 3) & (k >= n * 0.5) & label.rlike("[\\p{L}]"))
        )
        never = F.col("pii_kind").isin("phone", "email", "street_address") & (n >= 20) & (F.col("formed") < n * 0.05) & label.rlike("[\\p{L}]")
        best = cut(scored.select(*key, good.alias("good"), never.alias("never")).filter("good OR never"))
        known = spread(edges, best.filter("good").select(*key), key, "left_semi", ["instance"]).select("pii_kind", "instance").unionByName(start).distinct()

    columns = ["table_name", "doc_id", "start_pos", "end_pos", "pii_kind"]
    place = ["doc_id", "start_pos"]
    other = spread(found.filter("pii_kind <> 'person_name'"), best, key, "left", place)
    other = other.filter(F.when(F.col("evidence") == 2, ~F.coalesce("never", F.lit(False))).otherwise(F.coalesce("good", F.lit(False)))).select(*columns, "evidence")

    # A name known from several good patterns is taken in any place that is good for half of its names.
    names = found.filter("pii_kind = 'person_name'").select("table_name", "doc_id", "start_pos", "end_pos", "pii_kind", "instance", "pattern", "within")
    name_edges = edges.filter("pii_kind = 'person_name'").select("pattern", "instance", "n")
    patterns = best.filter("pii_kind = 'person_name' AND good").select("pattern")
    marked = spread(name_edges, patterns.withColumn("good", F.lit(1)), ["pattern"], "left", ["instance"])
    by_name = cut(
        marked.groupBy("instance")
        .agg(F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("in_good"), F.sum("n").alias("all"), F.sum(F.coalesce("good", F.lit(0))).alias("patterns"))
        .filter("in_good >= 0.3 * all")
        .select("instance", (F.col("patterns") >= 2).alias("sure"))
    )
    sure = by_name.filter("sure").select("instance", "sure")
    shares = spread(name_edges, sure, ["instance"], "left", ["pattern"]).groupBy("pattern").agg(F.avg(F.coalesce(F.col("sure").cast("int"), F.lit(0))).alias("share"))
    places = shares.filter("share >= 0.5").select("pattern", F.lit(True).alias("place")).join(patterns.withColumn("good", F.lit(True)), "pattern", "full_outer")
    people = spread(spread(names, places, ["pattern"], "inner", place), by_name, ["instance"], "inner", place).filter("good OR (place AND sure)")
    inside = other.filter("evidence < 2").select("table_name", "doc_id", F.col("start_pos").alias("within")).distinct()
    people = people.filter("within < 0").select(columns).unionByName(people.filter("within >= 0").join(inside, ["table_name", "doc_id", "within"], "left_anti").select(columns))
    return other.select(columns).unionByName(people).distinct()


def mask(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, doc_id, text, has_pii): ``texts`` with a placeholder such as [EMAIL] for each span found."""
    spans = found.groupBy("table_name", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "pii_kind"))).alias("spans"))

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans):
            if t is None or ss is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in ss:
                if s["start_pos"] >= at:
                    parts += [t[at : s["start_pos"]], f"[{s['pii_kind'].upper()}]"]
                    at = s["end_pos"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    once = texts.select("table_name", "doc_id", "text").dropDuplicates(["table_name", "doc_id"])
    return once.join(spans, ["table_name", "doc_id"], "left").select("table_name", "doc_id", masked("text", "spans").alias("text"), F.col("spans").isNotNull().alias("has_pii"))


def corpus(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """All texts of ``tables`` (doc_id, text) under their names."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "doc_id", "text") for name, df in tables.items()])
