"""Several values packed in one field: one row for each value, with its place.

The string buffers of an Arrow batch are turned into one code-point buffer. Quote parity, bracket
depth and delimiter masks are computed over that buffer with numpy; the cut positions give the child
offsets of a list array, whose values are cleaned by Arrow kernels and flattened together with the
parent row numbers.

Two things can't be seen in a field alone and are learned from the whole column: whether a slash
belongs to a term, and whether spaces separate. The fields are split once, written to the checkpoint
folder as lists, and only the fields in question are joined with what was learned.

Defined results for odd input:

* rows without key, null, blank and "none"-like fields give no row; an empty table gives an empty result,
* empty entries are left out and do not count for the position,
* repeated entries count each time; a row that stands twice (equal key and fields) counts once,
* an unclosed quote or bracket is taken as an ordinary character,
* further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources.session import cut

# Words that stand for "no entry".
NONE_WORDS = ("", "-", "--", "none", "n/a", "na", "null", "nil", "없음", "해당없음", "해당 없음", "무")
# Well-known terms whose slash is no separator; more are learned from the column.
SLASH_TERMS = ("A/B", "PL/SQL", "HTML/CSS", "C/C++", "CI/CD", "TCP/IP", "ISO/IEC", "I/O", "OS/2", "N/A", "UI/UX", "S/W", "H/W", "AC/DC")
# Single characters that separate entries; "/" and "&" have rules of their own.
DELIMITERS = ",;|·、，；｜/\n\r\t"
# Words that join two entries when they stand between spaces.
JOINERS = ("및", "and", "&", "그리고")
SALTS = 16

_MARK = re.compile(r"(?<![^\s" + re.escape(DELIMITERS) + r"])(?:\((\d{1,3})\)|(\d{1,3})([.)]))\s+")
_TAG = re.compile(r"(?<!\S)#(?=\S)")
_NOTHING, _FEED = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
_BULLET = r"^[-*•▪◦○※]\s+"
_FIRST_BULLET = re.compile(r"[-*•▪◦○※]\s+")


def _code(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


def _parity(mask: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running count of ``mask`` within each row, the character itself included."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[1:] - total[starts][row]


def _prepared(column: pa.Array) -> pa.Array:
    """Trimmed fields, "" for none; the brackets of a JSON list taken off, its escaped quotes doubled."""
    column = pc.fill_null(pc.utf8_trim_whitespace(column.cast(pa.large_string())), _NOTHING)
    none = pc.is_in(pc.utf8_lower(column), pa.array(NONE_WORDS, pa.large_string()))
    column = pc.if_else(none, _NOTHING, column)
    column = pc.replace_substring_regex(column, r"(?s)^\[(\s*[\"'].*)\]$", r"\1")
    return pc.replace_substring(column, '\\"', '""')


def split_batch(column: pa.Array, slash_terms: tuple[str, ...] = SLASH_TERMS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Entries of all fields in order: the number of the field that each came from, whether only a bare slash parts it from the entry before, and the entries."""
    if len(column) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), pa.array([], pa.large_string())
    fields = pc.binary_join_element_wise(_prepared(column), _FEED, _NOTHING)  # a line feed closes each field
    lengths = pc.utf8_length(fields).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.frombuffer(fields.buffers()[1], dtype=np.int64)[fields.offset : fields.offset + len(fields) + 1]
    whole = str(memoryview(fields.buffers()[2])[bounds[0] : bounds[-1]], "utf-8")
    ends = np.cumsum(lengths)
    starts = ends - lengths
    code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    last = np.zeros(len(code), dtype=bool)
    last[ends - 1] = True
    place = np.arange(len(code))

    before = np.concatenate([[10], code[:-1]])
    after = np.concatenate([code[1:], [10]])
    edge = _code(DELIMITERS + " ")
    opens, closes = np.isin(before, edge), np.isin(after, edge) | last

    # Quotes. A straight quote toggles; a doubled one toggles twice and so changes nothing.
    straight = code == ord('"')
    odd = _parity(straight, starts, row)
    odd_rows = odd[ends - 1] % 2 == 1  # an unclosed quote does not count
    inside = (odd % 2 == 1) & ~odd_rows[row]
    single = ((code == ord("'")) | (code == ord("‘")) | (code == ord("’"))) & (opens | closes)
    once = _parity(single, starts, row)
    inside |= (once % 2 == 1) & (once[ends - 1] % 2 == 0)[row]
    curly = _parity((code == ord("“")).astype(np.int64) - (code == ord("”")), starts, row)
    inside |= (curly > 0) & (curly[ends - 1] == 0)[row]

    # List marks: (1), 1. or 1) at the beginning of a field, and the following numbers in the same style.
    cut_at = np.zeros(len(code), dtype=bool)
    skip = np.zeros(len(code), dtype=bool)  # list marks and joiners, no part of any entry
    numbered = np.zeros(len(code), dtype=bool)  # brackets of list marks
    n_marks = np.zeros(len(lengths), dtype=np.int64)
    style: dict[int, str] = {}
    for m in _MARK.finditer(whole):
        r = int(row[m.start()])
        kind = m[3] or "("
        if int(m[1] or m[2]) != n_marks[r] + 1 or (n_marks[r] == 0) != (m.start() == starts[r]) or style.setdefault(r, kind) != kind or inside[m.start()]:
            continue
        n_marks[r] += 1
        skip[m.start() : m.end()] = numbered[m.start() : m.end()] = True
        cut_at[m.start()] = True
    breaks = np.bincount(row[(code == 10) & ~last], minlength=len(lengths))
    listed = (n_marks > 1) | ((n_marks == 1) & (breaks == 0))  # only list marks or line ends separate entries
    first = code[starts]
    bullets = np.zeros(len(lengths), dtype=bool)
    for r in np.flatnonzero(np.isin(first, _code("-*•▪◦○※"))):
        bullets[r] = _FIRST_BULLET.match(whole, int(starts[r]), int(ends[r])) is not None
    listed |= bullets
    cut_at |= bullets[row] & (code == 10)
    tagged = first == ord("#")
    if tagged.any():
        for m in _TAG.finditer(whole):
            if tagged[row[m.start()]] and lengths[row[m.start()]] > 2 and not inside[m.start()]:
                skip[m.start()] = cut_at[m.start()] = True

    # Brackets, list marks aside; a row whose brackets do not balance has none.
    step = (((code == ord("(")) | (code == ord("[")) | (code == ord("（"))).astype(np.int64) - ((code == ord(")")) | (code == ord("]")) | (code == ord("）"))))
    step[numbered | inside] = 0
    depth = _parity(step, starts, row)
    inside |= (depth > 0) & (depth[ends - 1] == 0)[row]

    # Signs that belong to an entry: thousands marks, fractions and terms with a slash.
    digit = (code >= 48) & (code <= 57)
    ahead = [np.concatenate([digit[k:], np.zeros(min(k, len(digit)), dtype=bool)]) for k in range(5)]
    digit_before, digit_after = np.concatenate([[False], digit[:-1]]), ahead[1]
    three = ahead[1] & ahead[2] & ahead[3] & ~ahead[4]
    keep = (code == ord(",")) & digit_before & three
    slash = code == ord("/")
    keep |= slash & digit_before & digit_after
    for m in re.finditer("|".join(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])" for t in sorted(slash_terms, key=len, reverse=True)), whole) if slash_terms and slash.any() else ():
        keep[m.start() : m.end()] |= slash[m.start() : m.end()]

    cut_at |= np.isin(code, _code(DELIMITERS)) & ~inside & ~keep & ~listed[row]
    for m in re.finditer(r"(?<=\s)(?:" + "|".join(map(re.escape, JOINERS)) + r")(?=\s)", whole):
        if not inside[m.start()] and not listed[row[m.start()]]:
            cut_at[m.start()] = skip[m.start() : m.end()] = True
    cut_at[last] = True
    skip |= np.isin(code, _code(DELIMITERS)) & cut_at
    apart = _code(DELIMITERS + " \"'“”‘’")
    bare = slash & cut_at & ~np.isin(before, apart) & ~np.isin(after, apart)

    # Child offsets: an entry runs from one cut to the next, separators blanked out.
    chars = np.where(skip, np.uint32(32), code)
    data = chars.tobytes().decode("utf-32-le").encode()
    width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])
    rights = np.flatnonzero(cut_at)
    lefts = np.concatenate([[0], rights[:-1]])
    offsets = np.concatenate([[0], at[rights]]).astype(np.int64)
    entries = pa.Array.from_buffers(pa.large_string(), len(rights), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    entries = pc.utf8_trim_whitespace(pc.utf8_trim(pc.utf8_trim_whitespace(entries), characters=DELIMITERS))
    entries = pc.utf8_trim_whitespace(pc.replace_substring_regex(entries, _BULLET, ""))
    entries = pc.utf8_trim_whitespace(pc.replace_substring_regex(entries, r"(?s)^(?:\"(.*)\"|'(.*)'|“(.*)”|‘(.*)’)$", r"\1\2\3\4"))
    entries = pc.replace_substring(entries, '""', '"')
    whole_ones = pc.and_(pc.not_equal(entries, _NOTHING), pc.not_equal(entries, pa.scalar('"', pa.large_string()))).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(whole_ones)
    # Whether a bare slash and nothing else stands between an entry and the one before it.
    glued = bare[lefts][kept] & (np.concatenate([[-2], kept[:-1]]) == kept - 1)
    return row[place[rights]][kept], glued, entries.take(pa.array(kept))


def split_packed(df: DataFrame, key: str, fields: list[str], slash_terms: tuple[str, ...] = SLASH_TERMS) -> DataFrame:
    """One row (key, field_name, item_pos, item_value) for each entry of the packed ``fields``.

    A slash without spaces belongs to a term where the same two parts stand around a slash at least
    four times, in the other order at most a quarter as often, and the first part stands before
    other slashes at most twice as often; a quoted part is none. Separators part any entries in any order, terms don't.
    A field without any separator but spaces is split at them if each of its words also stands as an
    entry of its own in a separated field of the same name, or is a coined CamelCase word beside
    such an entry.
    """
    narrow = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).filter(F.col(key).isNotNull()).distinct()
    out = T.StructType([T.StructField(key, narrow.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("glued", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in fields:
                parents, glued, values = split_batch(batch.column(field), slash_terms)
                offsets = np.searchsorted(parents, np.arange(batch.num_rows + 1)).astype(np.int32)
                filled = pa.array(np.flatnonzero(np.diff(offsets)))
                lists = [pa.ListArray.from_arrays(pa.array(offsets), x).take(filled) for x in (values.cast(pa.string()), pa.array(glued))]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(filled), pa.array([field] * len(filled), pa.string()), *lists], names=out.names)

    lists = cut(narrow.mapInArrow(run, out))
    first = F.element_at("items", 1)
    slashed, spaced = F.exists("glued", lambda g: g), (F.size("items") == 1) & first.contains(" ")
    rest = lists.filter(~slashed & ~spaced).select(key, "field_name", "items")

    # Slashes: pairs of parts, counted over all fields.
    pairs = lists.filter(slashed).select(key, "field_name", F.posexplode(F.arrays_zip("items", "glued")).alias("at", "x"), "items").filter("x.glued").select(key, "field_name", "at", F.get("items", F.col("at") - 1).alias("a"), F.col("x.items").alias("b"))
    counts = pairs.groupBy("field_name", "a", "b").agg(F.count("*").alias("n"))
    of_first = counts.groupBy("field_name", "a").agg(F.sum("n").alias("of_a"))
    turned = counts.select("field_name", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("turned"))
    terms = (
        counts.filter("n >= 4")
        .join(of_first, ["field_name", "a"])
        .join(turned, ["field_name", "a", "b"], "left")
        .filter((F.col("n") >= 4 * F.coalesce("turned", F.lit(0))) & (3 * F.col("n") >= F.col("of_a")))
        .select("field_name", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")
    whole = pairs.select("*", salt).join(terms, ["field_name", "a", "b", "salt"], "left_semi").groupBy(key, "field_name").agg(F.collect_set("at").alias("joined"))
    joined = F.aggregate(
        F.transform("items", lambda v, i: F.struct(v.alias("v"), F.array_contains(F.coalesce("joined", F.array().cast("array<int>")), i).alias("j"))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x["j"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("/"), x["v"])))).otherwise(F.concat(done, F.array(x["v"]))),
    )
    with_terms = lists.filter(slashed).join(whole, [key, "field_name"], "left").select(key, "field_name", joined.alias("items"))

    # Spaces: words that stand as entries elsewhere.
    known = lists.filter(F.size("items") > 1).select("field_name", F.explode("items").alias("word")).filter(~F.col("word").contains(" ")).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    words = lists.filter(spaced).select(key, "field_name", F.explode(F.array_distinct(F.split(first, " +"))).alias("word"), salt)
    met = (
        words.join(known.withColumn("known", F.lit(1)), ["field_name", "word", "salt"], "left")
        .groupBy(key, "field_name")
        .agg(F.min(F.coalesce(F.col("known") == 1, F.lit(False)) | F.col("word").rlike("^[A-Z][a-z]+-?[A-Z][A-Za-z]*$")).alias("all_known"), F.max("known").alias("any_known"))
        .filter("all_known AND any_known = 1")
        .select(key, "field_name", F.lit(True).alias("parted"))
    )
    with_spaces = lists.filter(spaced).join(met, [key, "field_name"], "left").select(key, "field_name", F.when(F.col("parted"), F.split(first, " +")).otherwise(F.col("items")).alias("items"))
    every = rest.unionByName(with_terms).unionByName(with_spaces)
    return every.select(key, "field_name", F.posexplode("items").alias("at", "item_value")).select(key, "field_name", (F.col("at") + 1).cast("int").alias("item_pos"), "item_value")
