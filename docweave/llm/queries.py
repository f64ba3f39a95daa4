"""Queries of the text-corpus operators over the tables of a data folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.language import find_wrong_labels, identify
from docweave.llm.leakage import find_leaks
from docweave.llm.packing import broken_rules, fill_rates, pack
from docweave.llm.page_body import body_only, find_furniture
from docweave.llm.pii import corpus, find_pii, mask
from docweave.llm.repeated_lines import find_repeated_lines, remove_repeated_lines
from docweave.llm.truncation import find_truncated, truncation_rates
from docweave.sources.tables import load


# The vocabulary file of a public tokenizer, on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang"]
    return find_wrong_labels(load(spark, sf_dir, "lab_docs", columns), "doc_id", "text", "lang", load(spark, sf_dir, "documents", columns))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang"]
    return identify(load(spark, sf_dir, "lab_docs", columns), "doc_id", "text", "lang", load(spark, sf_dir, "documents", columns)).drop("label").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "lab_docs", ["lab_id", "doc_id", "text"])
    return find_repeated_lines(docs, "lab_id", "doc_id", "text").select("doc_id", "line_no")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "lab_docs", ["lab_id", "doc_id", "text"])
    return remove_repeated_lines(docs, "lab_id", "doc_id", "text").dropDuplicates(["lab_id", "doc_id"])  # texts are dealt by these already


def _p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text"]
    return corpus(spark, documents=load(spark, sf_dir, "documents", columns), lab_docs=load(spark, sf_dir, "lab_docs", columns))


def _p4_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lab", ["professor"]).withColumnRenamed("professor", "name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_p4_texts(spark, sf_dir), _p4_seeds(spark, sf_dir))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_p4_texts(spark, sf_dir), p4_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_furniture(load(spark, sf_dir, "lab_docs", ["doc_id", "text", "source_url"]), "doc_id", "text", "source_url")


def p5_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body_only(load(spark, sf_dir, "lab_docs", ["doc_id", "text", "source_url"]), "doc_id", "text", "source_url")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", load(spark, sf_dir, "pack_spec"), TOKENIZER)


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_rates(p6_pack(spark, sf_dir), load(spark, sf_dir, "pack_spec"))


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing must keep to: every document once, no container overfull, none divided without need."""
    return broken_rules(p6_pack(spark, sf_dir), load(spark, sf_dir, "pack_spec"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    items = load(spark, sf_dir, "eval_item", ["item_id", "text"])
    return find_leaks(docs, "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(load(spark, sf_dir, "documents", ["doc_id", "text", "source"]), "doc_id", "text", "source").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(load(spark, sf_dir, "documents", ["doc_id", "text", "source"]), "doc_id", "text", "source")


_P3_LINES = r"""
docs AS (SELECT DISTINCT lab_id, doc_id, text FROM lab_docs WHERE text IS NOT NULL),
parts AS (SELECT lab_id, doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT lab_id, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM parts),
keyed AS (SELECT lab_id, doc_id, line, line_no::INTEGER AS line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS k FROM lines),
freq AS (
  SELECT k.lab_id, k.k FROM keyed k JOIN (SELECT lab_id, count(DISTINCT doc_id) AS n FROM lab_docs GROUP BY lab_id) t ON t.lab_id = k.lab_id
  WHERE k.k <> '' GROUP BY k.lab_id, k.k, t.n HAVING count(DISTINCT k.doc_id) >= t.n * 0.2::DOUBLE)
"""

P3_FOUND_SQL = f"WITH {_P3_LINES} SELECT k.doc_id, k.line_no FROM keyed k JOIN freq f ON f.lab_id = k.lab_id AND f.k = k.k"
P3_CLEAN_SQL = f"""WITH {_P3_LINES},
kept AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.line_no) AS text FROM keyed k ANTI JOIN freq f ON f.lab_id = k.lab_id AND f.k = k.k GROUP BY k.doc_id)
SELECT d.lab_id, d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM (SELECT DISTINCT lab_id, doc_id, text FROM lab_docs) d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


P6_RULES_SQL = "SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0::BIGINT AS overfull, 0::BIGINT AS divided, 0::BIGINT AS lost FROM pack_spec WHERE EXISTS (SELECT 1 FROM documents)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_masked": p4_masked, "p5_found": p5_found, "p5_body": p5_body, "p6_pack": p6_pack, "p6_rates": p6_rates, "p6_rules": p6_rules, "p7_found": p7_found, "p8_found": p8_found, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND_SQL, "p3_clean": P3_CLEAN_SQL, "p6_rules": P6_RULES_SQL}
