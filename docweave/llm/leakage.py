"""Evaluation passages inside corpus texts.

Spaced-seed hashing: each mask picks five words of a window and leaves out at most one between
them. Only the picked words are hashed, so a window with a hole on one side meets a window without
on the other: a replaced, a missing and an added word are all tolerated. The evaluation side
fills a bitmap of about 512 bits for each of its hashes, ``MOST_BITS`` at most (beyond some 500,000
hashes, items of about 100,000 words, more corpus windows meet it by chance; the join that follows
sorts them out); corpus windows that meet it are gathered into stretches, and the hashes of the stretches are joined to the hashes of the
items. Each (stretch, item) pair is then verified by chaining equal words.

The stretches are written to the checkpoint folder once, as both the join and the verification read
them. Nothing of the corpus reaches the driver.

Defined results: rows without id are left out; null and empty texts hold no passage and items of fewer than ``min_words`` words
can't leak; repeated texts are reported each time; repeated items each; an empty table on either
side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.session import cut

#: Word offsets of the masks.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5))
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SALTS = 16
SPREAD = 18  # hits of one stretch lie at most so many words apart
RARE = 0.02  # a word is rare if at most this share of the items has it
MARGIN = 16  # words around the hits that the verification sees: as many as a passage of twelve words with edits can have
FENCE = chr(0xE000)  # stands before each text of a batch
_WORD = re.compile(rf"\w+(?:[.,]\d+)*|{FENCE}")
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 6)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold().replace(FENCE, " "))


def _windows(texts: list[str], known: dict[str, int]) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of all texts, the number of the text of each word, and (starts, hashes) for each mask."""
    whole = "".join(FENCE + unicodedata.normalize("NFKC", t.replace(FENCE, " ")).casefold() for t in texts)
    words = _WORD.findall(whole)
    if len(known) > 500_000:
        known.clear()
    codes = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = h
    fence = codes == np.uint64(xxhash.xxh64_intdigest(FENCE))
    owner = np.cumsum(fence) - 1
    found = []
    with np.errstate(over="ignore"):
        for mask in MASKS:
            n = len(words) - mask[-1]
            if n <= 0:
                continue
            acc = np.zeros(n, dtype=np.uint64)
            for factor, o in zip(_FACTORS, mask):
                acc += codes[o : o + n] * factor
            acc ^= acc >> np.uint64(29)
            ok = (owner[:n] == owner[mask[-1] : mask[-1] + n]) & ~fence[:n]
            starts = np.flatnonzero(ok)
            found.append((starts, acc[starts]))
    return words, owner, found


def _item_hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for pdf in frames:
        ids, texts = pdf["item_id"].to_numpy(), [t or "" for t in pdf["text"]]
        _, owner, found = _windows(texts, known)
        for starts, hashes in found:
            yield pd.DataFrame({"item_id": ids[owner[starts]], "hash": hashes.view(np.int64)}).drop_duplicates()


def _stretches(bitmap):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known = np.frombuffer(bitmap.value, dtype=np.uint8), {}
        mask = np.uint64(8 * len(bits) - 1)
        for pdf in frames:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                ids, texts = part["doc_id"].to_numpy(), [t or "" for t in part["text"]]
                words, owner, found = _windows(texts, known)
                at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for starts, h in found:
                    bit = h & mask
                    hit = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at.append(starts[hit])
                    hashes.append(h[hit])
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                if len(at) == 0:
                    continue
                new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > SPREAD) | (np.diff(owner[at]) > 0)]))
                rows = []
                for lo, hi in zip(new, np.concatenate([new[1:], [len(at)]])):
                    doc = owner[at[lo]]
                    first, last = max(at[lo] - MARGIN, 0), min(at[hi - 1] + 6 + MARGIN, len(words))
                    text = [w for w, o in zip(words[first:last], owner[first:last]) if o == doc and w != FENCE]
                    rows.append((ids[doc], int(lo) + (a << 32), " ".join(text), np.unique(hashes[lo:hi]).view(np.int64)))
                yield pd.DataFrame(rows, columns=["doc_id", "stretch", "words", "hashes"])

    return run


def holds_passage(doc: list[str], item: list[str], rare: set[str], min_words: int = 12, share: float = 0.75) -> bool:
    """Whether ``doc`` holds at least ``min_words`` words in a row of ``item``, single edits allowed.

    Of the item's ``rare`` words (those that few other items have) within the passage at least half
    must be there too, or else items written after one pattern would pass for each other.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    upto = np.concatenate([[0], np.cumsum([w in rare for w in item])]).tolist()
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for i, w in enumerate(doc):
        is_rare = w in rare
        for j in places.get(w, ()):
            top = (1.0, 1, j, is_rare)
            for di in (1, 2, 3):
                for dj in (1, 2, 3):
                    before = best.get((i - di, j - dj))
                    if before:
                        score = before[0] + 1 - 1.5 * (max(di, dj) - 1)
                        if score > top[0]:
                            top = (score, before[1] + 1, before[2], before[3] + is_rare)
            best[(i, j)] = top
            span, rares = j - top[2] + 1, upto[j + 1] - upto[top[2]]
            if span >= min_words and top[1] >= share * span and 2 * top[3] >= rares and (top[3] or not rare):
                return True
    return False


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12) -> DataFrame:
    """Rows (doc_id, item_id): the document holds a passage of at least ``min_words`` words of the item."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    evals = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    item_kind, doc_kind = evals.schema["item_id"].dataType.simpleString(), corpus.schema["doc_id"].dataType.simpleString()

    hashes = evals.mapInPandas(_item_hashes, f"item_id {item_kind}, hash long")
    hashes = cut(hashes.distinct())  # read three times
    bits, wanted = LEAST_BITS, min(MOST_BITS, 512 * hashes.count())
    while bits < wanted:
        bits *= 2
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    byte = f"cast(shiftright(hash & {bits - 1}, 3) as int) AS byte"
    for row in hashes.selectExpr(byte, "hash").groupBy("byte").agg(F.expr("bit_or(shiftleft(1, cast(hash & 7 as int)))").alias("bits")).toLocalIterator():
        bitmap[row["byte"]] = row["bits"]
    shared = spark.sparkContext.broadcast(bitmap.tobytes())  # MOST_BITS / 8 bytes at most

    stretches = cut(corpus.mapInPandas(_stretches(shared), f"doc_id {doc_kind}, stretch long, words string, hashes array<long>"))
    # A phrase that very many documents hold is one hash: the corpus side is dealt, the items' side repeated.
    dealt = stretches.select("doc_id", "stretch", F.explode("hashes").alias("hash")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "stretch"), F.lit(SALTS)).cast("int"))
    repeated = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = dealt.join(repeated, ["hash", "salt"]).select("doc_id", "stretch", "item_id").distinct()

    split_words = F.pandas_udf(lambda texts: texts.map(words_of), "array<string>")
    item_words = evals.select("item_id", split_words("text").alias("item_words"))
    n_items = evals.agg(F.countDistinct("item_id").alias("n_items"))
    spread = item_words.select("item_id", F.explode(F.array_distinct("item_words")).alias("word"))
    few = spread.groupBy("word").agg(F.countDistinct("item_id").alias("n")).join(n_items).filter(F.col("n") <= F.greatest(F.lit(1), F.col("n_items") * RARE)).select("word")
    rare = spread.join(few, "word").groupBy("item_id").agg(F.collect_set("word").alias("rare"))
    item_side = item_words.dropDuplicates(["item_id"]).join(rare, "item_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))

    @F.pandas_udf("boolean")
    def verified(doc: pd.Series, item: pd.Series, rare_words: pd.Series) -> pd.Series:
        return pd.Series([holds_passage(d.split(" "), list(i), set(r), min_words) for d, i, r in zip(doc, item, rare_words)])

    return (
        pairs.join(stretches.select("doc_id", "stretch", "words"), ["doc_id", "stretch"])
        .join(item_side, "item_id")
        .filter(verified("words", "item_words", "rare"))
        .select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
        .distinct()
    )
