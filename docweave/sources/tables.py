"""Parquet tables of one data folder.

Some tables hold about one row in a hundred twice, equal in every column. ``load(..., once=True)``
returns such a row once. The comparison is done on the columns that are asked for, so a narrow
projection stays a narrow shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows may stand twice, with the columns that identify a row.
REPEATED = {
    "lab": ["lab_id"],
    "lab_docs": ["doc_id"],
    "lab_tag": None,
    "crawl_log": ["log_id"],
    "student_profile": ["profile_id"],
}


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, once: bool = False) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; with ``once`` rows that are equal in every column count once.

    A Parquet file of one row group is one task, however long its texts take. Who knows that a table
    is stored so names a number of tasks in ``spark.docweave.textTasks``; texts are then dealt to so
    many. Unset, as it should be for tables of many files, nothing is moved.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns is not None:
        df = df.select(*columns)
        tasks = int(spark.conf.get("spark.docweave.textTasks", "0"))
        if tasks and "text" in columns and not once:
            df = df.repartition(tasks)
    if once and name in REPEATED:
        key = REPEATED[name]
        df = df.dropDuplicates(key if key and set(key) <= set(df.columns) else None)
    return df
