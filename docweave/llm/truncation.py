"""Texts that stop before their end.

A stack automaton reads each text as a whole and holds what is open: brackets, quotation marks,
elements, code fences; it also sees a tag, an escape or a character that breaks off, a mark that a
loader left, and a last sentence without terminator. None of these means much by itself, so each is
weighed against a baseline counted over all documents:

* what is open at the end against the share of whole-looking texts of the same source that end so,
* a last sentence without terminator against the sentences and lines that begin with the same words
  (numbers, addresses and coined names as slots): if those end with a terminator, it was cut off,
* a beginning never seen before against how the inner lines of its source end.

The counts are combined within each task before they are shuffled. Only the ends that lack something
are joined to them, as narrow rows; the counts that no end asks for are dropped first and the others
are spread by salt, so neither a frequent beginning nor a large source gathers in one task.

Defined results: rows without id and null or blank texts are never cases; repeated texts are cases each time, a row
that stands twice counts once; null sources form one source; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.session import cut

LEVELS = 4  # words of a beginning that the baseline knows
LEAST = 3  # sentences that a beginning must have to be known, the asking one included
SALTS = 16

# Pairs that the automaton follows.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "‘": "’", "„": "“", "«": "»"}
CLOSERS = {b: a for a, b in PAIRS.items() if b not in PAIRS}
QUOTES = set("“‘„«「『\"")
# Elements that need no end tag.
UNCLOSED = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "p", "li", "td", "th", "tr", "dt", "dd", "option", "tbody", "thead", "tfoot", "body", "html", "head"}
# Marks that loaders leave where they cut.
CUT_MARK = re.compile(r"(?:\[\s?(?:\.{3}|…|more|truncated|잘림)\s?\]|\(\s?(?:\.{3}|…|more|계속|truncated)\s?\)|…|\.{3}|�|<truncated>|read more|더보기)$", re.I)
LONGEST_MARK = 14
# What ends a sentence, and what may follow it.
TERMINATORS = ".!?。！？．"
AFTER = "\"'”’»)]」』》】）`*_"
# How a Korean sentence ends where a mark took the place of its full stop.
WHOLE_VERB = re.compile(r"(?:니다|어요|아요|세요)$")
INNER_END = re.compile(r"(?<=[.!?])(?<!\b[A-Z]\.)\s+|(?<=[。！？])")
LIST_MARK = re.compile(r"\s*(?:[-*•▪◦○※▸·#]|\(?\d{1,3}[.)]|【|\[)\s*")
ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#\d*|#x[0-9a-fA-F]*|a|am|amp|l|lt|g|gt|q|qu|quo|quot|n|nb|nbs|nbsp)|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?|[\ud800-\udfff])$")
MARKUP = re.compile(r"<[A-Za-z/][^<>\n]*\Z")
_SIGN = re.compile(r"^[ \t]*(?:```|~~~)|\n[ \t]*\n|</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|[\"" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + "]", re.M)
_CAMEL = re.compile(r"[A-Z][a-z]+-?[A-Z][A-Za-z]*|[A-Z][a-z]+(?=[가-힣])")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_ADDRESS = re.compile(r"\S*(?:://|www\.|@\w)\S*|\S+\.[A-Za-z][A-Za-z0-9]{1,4}")
_NAME = re.compile(r"[A-Z][a-z]+(?:-?[A-Za-z]+)*[,;:]?")
_HANGUL = re.compile(r"[가-힣]")
_WIDE = re.compile(r"[぀-ヿ一-鿿]")


def words_of(fragment: str, most: int) -> list[str]:
    """The first words of a fragment as the baseline counts them: numbers, addresses and coined names are slots.

    In scripts without spaces every sign is a word. Names are words in Latin letters that begin with a
    capital elsewhere than at the beginning, and anywhere in a Hangul sentence.
    """
    raw = fragment.split(None, most)[:most]
    if raw and _WIDE.match(raw[0]) and not _HANGUL.search(raw[0]):
        return list("".join(raw)[:most])
    hangul = _HANGUL.search(" ".join(raw)) is not None
    return [slot(w, hangul or k > 0) for k, w in enumerate(raw)]


@lru_cache(maxsize=200_000)
def slot(word: str, names: bool) -> str:
    if len(word) > 64 or _ADDRESS.fullmatch(word):
        return "@"
    if names and _NAME.fullmatch(word):
        return "W"
    return _DIGITS.sub("0", _CAMEL.sub("W", word))


def terminated(line: str) -> bool:
    return line.rstrip().rstrip(AFTER)[-1:] in set(TERMINATORS)


def open_at_end(text: str) -> list[tuple[str, int]]:
    """What the stack automaton still holds at the end of the text: opening signs with their places.

    A straight quote closes the one before; a blank line drops it, as a paragraph was begun without
    its end. A fence hides all that is in it. An end tag or bracket takes what was left open within.
    """
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}

    def pop_to(sign: str) -> None:
        while held.get(sign):
            last = stack.pop()[0]
            held[last] -= 1
            if last == sign:
                return

    for m in _SIGN.finditer(text):
        c = m[0]
        fence = c.lstrip()[:3] if c[-1] in "`~" else ""
        if held.get("```") or held.get("~~~"):
            if fence and held.get(fence):
                pop_to(fence)
            continue
        if fence:
            sign = fence
        elif c[0] == "\n":
            pop_to('"')
            continue
        elif c[0] == "<" and len(c) > 1:
            name = re.match(r"</?([A-Za-z][\w-]*)", c)[1].lower()
            if c[1] == "/":
                pop_to("<" + name)
                continue
            if name in UNCLOSED or c[-2] == "/":
                continue
            sign = "<" + name
        elif c == '"':
            if m.start() and text[m.start() - 1].isdigit() and not held.get('"'):
                continue  # inches
            if held.get('"'):
                pop_to('"')
                continue
            sign = '"'
        elif c in CLOSERS:
            pop_to(CLOSERS[c])
            continue
        elif c == "“" and held.get("„"):
            pop_to("„")
            continue
        else:
            sign = c
        stack.append((sign, m.start()))
        held[sign] = held.get(sign, 0) + 1
    return stack


def kinds_open(text: str) -> list[str]:
    """The kinds of what is open: bracket, quote, element, fence, tag."""
    kinds = {"fence" if s[0] in "`~" else "element" if s[0] == "<" else "quote" if s in QUOTES else "bracket" for s, _ in open_at_end(text)}
    if MARKUP.search(text, text.rfind("\n") + 1):
        kinds.add("tag")
    return sorted(kinds)


def without_marks(text: str) -> tuple[str, str]:
    """The text without the marks that loaders left at its end, and the last of these."""
    text, mark = text.rstrip(), ""
    while m := CUT_MARK.search(text, max(0, len(text) - LONGEST_MARK)):
        mark = mark or m[0]
        text = text[: m.start()].rstrip()
    return text, mark


def keys_of(fragment: str) -> list[str]:
    """Probes of an unfinished fragment, most telling last: its words without the last one, which may be broken.

    One word alone is asked by its letters, as the beginning of a word.
    """
    words = words_of(fragment, LEVELS + 1)
    if not words:
        return []
    if len(words) == 1:
        return ["^" + words[0]] if words[0] != "@" else ["@"]
    if words[-1] == "@" and len(words) <= LEVELS:  # an address tells by itself
        return [" ".join(words[:k]) for k in range(1, len(words) + 1)]
    return [" ".join(words[:k]) for k in range(1, len(words))]


def ending(text: str) -> dict | None:
    """What the end of a text lacks, None where it lacks nothing.

    ``sure``: it breaks off within a mark, an escape or a character; ``fragment``: the sentence
    without terminator; ``keys``: its probes; ``running``: whether it follows another sentence in its
    line; ``own``: whether it looks like a name or a place after a comma; ``open``: kinds held by the
    automaton.
    """
    if not text or text.isspace():
        return None
    core, mark = without_marks(text)
    kinds = kinds_open(core)
    line = core[core.rfind("\n") + 1 :]
    m = LIST_MARK.match(line)
    bare = line[m.end() :] if m else line
    parts = [x for x in INNER_END.split(bare) if x.strip()]
    fragment = parts[-1] if parts else bare
    running = len(parts) > 1
    done = terminated(core) or not core
    found = {"sure": False, "fragment": "", "keys": [], "words": 0, "running": running, "soft": mark == "...", "own": False, "open": kinds}
    last = line.split()[-1] if line.split() else ""
    if mark and mark != "...":
        whole = done or WHOLE_VERB.search(core) is not None
        return found | {"sure": True, "fragment": fragment} if not whole else None
    if mark and (done or WHOLE_VERB.search(core)):
        return None
    if ESCAPE.search(line) and not _ADDRESS.fullmatch(last):
        return found | {"sure": True, "fragment": fragment}
    if done or (m and not running):
        return found | {"fragment": bare} if kinds else None
    words = fragment.split()
    own = 1 < len(words) <= 6 and "," in fragment and (words[-1][:1].isupper() or words[-1][:1].isdigit())
    return found | {"fragment": fragment, "keys": keys_of(fragment), "words": len(words), "own": own}


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Baseline counts of one task, combined: key, how many, how many of them with a terminator (or, of texts, open at their end)."""
    counts: dict[str, list[int]] = {}

    def add(key: str, done: bool) -> None:
        c = counts.get(key)
        if c is None:
            counts[key] = [1, int(done)]
        else:
            c[0] += 1
            c[1] += done

    for pdf in frames:
        for source, text in zip(pdf["source"], pdf["text"]):
            if not text:
                continue
            source = source or ""
            core, cut_mark = without_marks(text)
            lines = core.split("\n")
            for at, line in enumerate(lines):
                if not line or line.isspace():
                    continue
                mark = LIST_MARK.match(line)
                done = terminated(line) and not (cut_mark and at == len(lines) - 1)
                if at < len(lines) - 1 and not mark:
                    add("source\t" + source, done)
                parts = [x for x in INNER_END.split(line[mark.end() :] if mark else line) if x.strip()]
                if mark and len(parts) == 1:
                    continue  # entries of lists say nothing of sentences
                for k, part in enumerate(parts):
                    whole = k < len(parts) - 1 or done
                    words = words_of(part, LEVELS)
                    key = "start\t"
                    for n, w in enumerate(words):
                        key += " " + w if n else w
                        add(key, whole)
            if not cut_mark and terminated(core):
                add("texts\t" + source, False)
                for kind in kinds_open(core):
                    add("open\t" + kind + "\t" + source, True)
        if len(counts) > 200_000:
            yield pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["key", "n", "done"])
            counts.clear()
    yield pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["key", "n", "done"])


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        got = [ending(t) if t else None for t in pdf["text"]]
        rows = [(d, s or "", e["sure"], e["fragment"], e["keys"], e["words"], e["running"], e["soft"], e["own"], e["open"]) for d, s, e in zip(pdf["doc_id"], pdf["source"], got) if e]
        yield pd.DataFrame(rows, columns=["doc_id", "source", "sure", "fragment", "keys", "words", "running", "soft", "own", "open"])


def baseline(base: DataFrame) -> DataFrame:
    """(key, n, done) over all documents (text, source)."""
    counts = base.select("text", "source").mapInPandas(_scan, "key string, n long, done long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("done").alias("done"))
    counts = cut(counts)  # read twice
    # For a fragment of one, perhaps broken, word: all first words that begin with it.
    first = counts.filter(F.col("key").startswith("start\t") & ~F.col("key").contains(" ")).withColumn("word", F.substring_index("key", "\t", -1))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word"))), lambda i: F.concat(F.lit("start\t^"), F.substring(F.col("word"), F.lit(1), i)))
    return counts.unionByName(first.select(F.explode(letters).alias("key"), "n", "done").groupBy("key").agg(F.sum("n").alias("n"), F.sum("done").alias("done")))


def find_truncated(docs: DataFrame, doc_id: str, text: str, source: str, majority: float = 0.5, usual: float = 0.2) -> DataFrame:
    """Rows (doc_id, source, fragment) of the documents whose text was cut off.

    A beginning is taken as that of a sentence if the share ``majority`` of its sentences end with a
    terminator; what is open counts if at most ``usual`` of the other texts of the source end so.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")).filter("doc_id IS NOT NULL")
    kind = base.schema["doc_id"].dataType.simpleString()
    ends = cut(
        base.mapInPandas(_ends, f"doc_id {kind}, source string, sure boolean, fragment string, keys array<string>, words int, running boolean, soft boolean, own boolean, open array<string>").distinct()
    )
    probes = F.concat(
        F.transform("keys", lambda x, i: F.struct((i + 1).alias("level"), F.concat(F.lit("start\t"), x).alias("key"))),
        F.transform("open", lambda x: F.struct(F.lit(-1).alias("level"), F.concat(F.lit("open\t"), x, F.lit("\t"), F.col("source")).alias("key"))),
        F.array(F.struct(F.lit(-2).alias("level"), F.concat(F.lit("texts\t"), F.col("source")).alias("key")), F.struct(F.lit(-3).alias("level"), F.concat(F.lit("source\t"), F.col("source")).alias("key"))),
    )
    unsure = ends.filter("NOT sure")
    asked = unsure.select("doc_id", "source", "fragment", "words", "running", "soft", "own", F.size("open").alias("n_open"), F.explode(probes).alias("p")).select("*", "p.level", "p.key").drop("p")
    needed = baseline(base).join(asked.select("key").distinct(), "key", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "fragment"), F.lit(SALTS)).cast("int")).join(needed, ["key", "salt"], "left")
    known = (F.col("level") > 0) & (F.col("n") >= LEAST)
    row = met.groupBy("doc_id", "source", "fragment", "words", "running", "soft", "own", "n_open").agg(
        F.max("level").alias("top"),
        F.max_by(F.when(known, F.col("done") / F.col("n")), F.when(known, F.col("level"))).alias("share"),
        F.min(F.when(F.col("level") == -1, F.coalesce("n", F.lit(0)))).alias("open_so"),
        F.max(F.when(F.col("level") == -2, F.col("n"))).alias("texts"),
        F.max(F.when(F.col("level") == -3, F.col("done") / F.col("n"))).alias("source_share"),
    )
    unknown = F.when(F.col("running"), ~F.col("own")).otherwise((F.col("words") > 4) & ~F.col("soft") & ~F.col("fragment").rlike("[)）\\]】]$") & (F.coalesce("source_share", F.lit(1.0)) >= usual))
    unfinished = (F.col("top") > 0) & F.coalesce(F.col("share") >= majority, unknown)
    # A text that is open and otherwise whole stands among the counted ones, so it is taken off.
    whole = (F.col("top") < 0).cast("int")
    left_open = (F.col("n_open") > 0) & (F.col("open_so") - whole <= usual * F.greatest(F.coalesce("texts", F.lit(0)) - whole, F.lit(0)))
    cases = row.filter(unfinished | left_open).select("doc_id", "source", "fragment")
    return ends.filter("sure").select("doc_id", "source", "fragment").unionByName(cases).select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "fragment")


def truncation_rates(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(source, docs, truncated, rate) for each source; a null source stands as ''."""
    cut_off = find_truncated(docs, doc_id, text, source).groupBy(source).agg(F.countDistinct(doc_id).alias("truncated"))
    every = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias(source)).agg(F.countDistinct(doc_id).alias("docs"))
    return every.join(cut_off, source, "left").select(source, "docs", F.coalesce("truncated", F.lit(0)).cast("long").alias("truncated"), F.round(F.coalesce("truncated", F.lit(0)) / F.col("docs"), 6).alias("rate"))
