"""Filling containers of fixed capacity with texts, sizes in tokens of a public tokenizer.

Documents are dealt at random (by a hash of their id) to groups of about ``group_docs`` documents.
Each group is packed on its own by first-fit decreasing; a tournament tree over the free space of
the group's containers finds the first one that fits in logarithmic time. Only ids and sizes are
shuffled, never texts, and the size of a group does not depend on the data.

Defined results: rows without id are left out; null and empty texts have no tokens and go into the first container of their
group; a text that alone exceeds the capacity is divided into full containers and a rest; a
repeated row is packed each time; equal sizes are placed in the order of their ids; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, built once in each Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, items taken in the order given."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    free = [capacity] * (2 * width)  # node k has children 2k and 2k + 1; leaves are the containers
    out = []
    for size in sizes:
        k = 1
        while k < width:
            k = 2 * k if free[2 * k] >= size else 2 * k + 1
        out.append(k - width)
        free[k] -= size
        k //= 2
        while k:
            top = free[2 * k] if free[2 * k] >= free[2 * k + 1] else free[2 * k + 1]
            if free[k] == top:
                break
            free[k] = top
            k //= 2
    return out


def pack(docs: DataFrame, doc_id: str, text: str, specs: DataFrame, tokenizer: str, group_docs: int = 4096, seed: int = 17) -> DataFrame:
    """Rows (pack_id, doc_id, piece_no, n_tokens, group_no, container_no) for each of ``specs`` (pack_id, capacity_tokens).

    A container is named by (pack_id, group_no, container_no). ``specs`` is a short list of
    container sizes and is broadcast.
    """
    groups = max(1, -(-docs.select(F.lit(1)).count() // group_docs))
    counts = token_counts(docs, doc_id, text, tokenizer)
    kind = counts.schema["doc_id"].dataType.simpleString()
    pieces = (
        counts.withColumn("group_no", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("int"))
        .crossJoin(F.broadcast(specs.select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity > 0").distinct()))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1))))
        .select("pack_id", "capacity", "group_no", "doc_id", (F.col("piece") + 1).cast("int").alias("piece_no"), F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n_tokens"))
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        pdf["container_no"] = first_fit(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        return pdf[["pack_id", "doc_id", "piece_no", "n_tokens", "group_no", "container_no"]]

    pack_kind = specs.schema["pack_id"].dataType.simpleString()
    return pieces.groupBy("pack_id", "group_no").applyInPandas(fill, f"pack_id {pack_kind}, doc_id {kind}, piece_no int, n_tokens long, group_no int, container_no int").withColumnRenamed("doc_id", doc_id)


def fill_rates(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, fill): share of the containers' capacity that is used."""
    used = packed.groupBy("pack_id", "group_no", "container_no").agg(F.sum("n_tokens").alias("tokens")).groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(specs.select("pack_id", "capacity_tokens").distinct()), "pack_id").select("pack_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


def broken_rules(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, docs, overfull, divided, lost): what is packed, and how often a rule is broken.

    ``overfull`` counts containers beyond their capacity, ``divided`` documents in several pieces
    that would have fitted into one container or whose pieces but the last aren't full, ``lost``
    documents whose pieces aren't numbered from 1 without gaps.
    """
    sized = packed.join(F.broadcast(specs.select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()), "pack_id")
    full = sized.groupBy("pack_id", "capacity", "group_no", "container_no").agg(F.sum("n_tokens").alias("n")).groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    by_doc = sized.groupBy("pack_id", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("top"), F.countDistinct("piece_no").alias("numbers"), F.sum("n_tokens").alias("n"))
    divided = (F.col("pieces") > 1) & (F.col("pieces") != F.ceil(F.col("n") / F.col("capacity")))
    lost = (F.col("numbers") != F.col("pieces")) | (F.col("top") != F.col("pieces"))
    docs = by_doc.groupBy("pack_id").agg(F.count("*").alias("docs"), F.count_if(divided).alias("divided"), F.count_if(lost).alias("lost"))
    return docs.join(full, "pack_id").select("pack_id", "docs", "overfull", "divided", "lost")
