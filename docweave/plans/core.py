"""Queries of the core operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.packed import split_packed
from docweave.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = load(spark, sf_dir, "student_profile", ["profile_id", "certifications", "awards", "tech_stack"])
    return split_packed(profiles, "profile_id", ["certifications", "awards", "tech_stack"])


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
