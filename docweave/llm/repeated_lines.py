"""Lines repeated across the documents of one source.

Each line is reduced to its letters in lower case and hashed. Distinct documents are counted for
every (source, hash); a hash that stands in at least ``share`` of the source's documents is
frequent. The frequent hashes are joined back to the lines, and documents are rebuilt without them.

Skew: the first shuffle is on (source, hash, document), so neither a hot source nor a hot line
gathers in one task; the count by (source, hash) is combined before its shuffle; the join back is
salted by document.

Defined results: rows without id count for nothing; null texts and lines without a letter are no case; null sources form one source
of their own; a row that stands twice counts once; an empty table gives an empty result; further
columns are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def line_key(line: Column) -> Column:
    """The letters of a line in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]", "")


def find_repeated_lines(docs: DataFrame, source: str, doc_id: str, text: str, share: float = 0.2) -> DataFrame:
    """Rows (source, doc_id, line_no) of every line that stands in ``share`` of the source's documents."""
    base = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    totals = base.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    lines = (
        base.filter(F.col("text").isNotNull())
        .select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.col("key") != "")
        .select("source", "doc_id", F.xxhash64("key").alias("key"), (F.col("at") + 1).cast("int").alias("line_no"))
    )
    by_doc = lines.groupBy("source", "key", "doc_id").agg(F.collect_set("line_no").alias("line_nos"))
    frequent = (
        by_doc.groupBy("source", "key")
        .agg(F.count("*").alias("n"), F.max(F.size("line_nos")).alias("most"))
        .join(totals.withColumnRenamed("source", "total_of"), F.col("source").eqNullSafe(F.col("total_of")))
        .filter((F.col("n") >= F.col("docs") * F.lit(share)) & (F.col("most") > 0))  # with the line numbers both readers of by_doc share one shuffle
        .select(F.col("source").alias("f_source"), F.col("key").alias("f_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    )
    return (
        by_doc.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(frequent, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("key") == F.col("f_key")) & F.col("salt").eqNullSafe(F.col("f_salt")))
        .select(F.col("source").alias(source), F.col("doc_id").alias(doc_id), F.explode("line_nos").alias("line_no"))
    )


def remove_repeated_lines(docs: DataFrame, source: str, doc_id: str, text: str, share: float = 0.2) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; order and other lines stay as they are.

    An id that stands in two sources loses in each what is frequent there.
    """
    found = find_repeated_lines(docs, source, doc_id, text, share).select(F.col(source).alias("__source"), F.col(doc_id).alias("__doc"), "line_no")
    gone = found.groupBy("__source", "__doc").agg(F.collect_set("line_no").alias("__gone"))
    keep = F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains(F.col("__gone"), (at + 1).cast("int")))
    joined = docs.join(gone, F.col(source).eqNullSafe(F.col("__source")) & (F.col(doc_id) == F.col("__doc")), "left")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))).select(*docs.columns)
