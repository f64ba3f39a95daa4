"""Texts cut into chunks, in one pass over Arrow batches. Each text is folded on its own; nothing is shuffled."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import chunk_tokens

LEAST, FULL, OVERLAP = 200, 400, 50
_GAP = re.compile(r"\n{2,}")
_NUMBERED = re.compile(r"\d+\.?\s")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form of Unicode text; plain ASCII passes unchanged."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def is_heading(line: str) -> bool:
    return len(line) < 100 and (line.endswith(":") or _NUMBERED.match(line) is not None or line.isupper())


def fold(text: str, title: str | None, least: int = LEAST, full: int = FULL, overlap: int = OVERLAP, keep_rest: bool = True) -> list[tuple[str | None, str]]:
    """(title, text) of each chunk.

    Paragraphs are gathered until ``full`` characters; the last ``overlap`` of them begin the next
    chunk. A heading ends a chunk of at least ``least`` characters, a shorter one goes on under the
    new title. A paragraph is never divided. A rest below ``least`` is a chunk of its own, unless
    ``keep_rest`` is off or the rest is no more than the overlap.
    """
    out: list[tuple[str | None, str]] = []
    held, new = "", False
    for p in (x.strip() for x in _GAP.split(text)):
        if not p:
            continue
        if is_heading(p):
            if len(held) >= least:
                out.append((title, held))
                held, new = "", False
            title = p
            continue
        held, new = f"{held}\n\n{p}" if held else p, True
        if len(held) >= full:
            out.append((title, held))
            held, new = held[-overlap:], False
    if len(held) >= least or (keep_rest and new):
        out.append((title, held))
    return [(t, " ".join(x.split())) for t, x in out]


def chunks(docs: DataFrame, doc_id: str, text: str, title: str | None = None, carry: list[str] | None = None, normal_form: bool = False, keep_rest: bool = True) -> DataFrame:
    """(doc_id, *carry, chunk_no, title, text, n_chars, n_tokens, md5). Null and empty texts give none.

    ``carry`` names columns that go along; with ``normal_form`` the chunks' text is in NFKC, while
    the md5 is that of the text as written. ``keep_rest`` as in ``fold``.
    """
    carry = carry or []
    held = [f"_c{i}" for i in range(len(carry))]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), *[F.col(c).alias(h) for c, h in zip(carry, held)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = zip(*(pdf[h] for h in held)) if held else ((),) * len(pdf)
            rows = [(d, *o, n, c[0], c[1]) for d, t, h, o in zip(pdf["doc_id"], pdf["text"], pdf["title"], own) if t for n, c in enumerate(fold(t, h, keep_rest=keep_rest), 1)]
            out = pd.DataFrame(rows, columns=["doc_id", *held, "chunk_no", "title", "raw"])
            out["text"] = out["raw"].map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t)) if normal_form else out["raw"]
            yield out

    kind = lambda c: base.schema[c].dataType.simpleString()
    cut = base.mapInPandas(run, f"doc_id {kind('doc_id')}, " + "".join(f"{h} {kind(h)}, " for h in held) + "chunk_no int, title string, raw string, text string")
    return cut.select(F.col("doc_id").alias(doc_id), *[F.col(h).alias(c) for h, c in zip(held, carry)], "chunk_no", "title", "text", F.length("raw").cast("long").alias("n_chars"), chunk_tokens(F.col("raw")).alias("n_tokens"), F.md5("raw").alias("md5"))


def word_packs(text: Column, size: int) -> Column:
    """A text's words gathered into pieces of at most ``size`` characters, as an array; a longer word stands alone."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None or len(t) <= size:
                return None if t is None else [t]
            out, held, n = [], [], 0
            for w in t.split():
                if held and n + len(w) + 1 > size:
                    out.append(" ".join(held))
                    held, n = [w], len(w)
                else:
                    held.append(w)
                    n += len(w) + 1
            return out + [" ".join(held)] if held else out

        return texts.map(one)

    return pack(text)
