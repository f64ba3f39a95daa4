"""File and database sources and sinks of the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAB = T.StructType([T.StructField(n, T.StringType()) for n in ("kor_name", "eng_name", "professor", "homepage", "location", "contact_email", "contact_phone", "description")])
DOCUMENT = T.StructType(
    [T.StructField("lab_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("section", "title", "text", "lang", "source_url", "md5", "emb_model")]
    + [T.StructField("tokens", T.IntegerType()), T.StructField("emb_ver", T.IntegerType()), T.StructField("quality_score", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def read_keyed_json(spark: SparkSession, path: str, row: T.StructType, key: str = "id") -> DataFrame:
    """A JSON file that holds one object of rows by key; missing text fields become ''.

    Such a file is one value, so it is read by one task: a way in for small exports, not a store.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), row))).alias(key, "row"))
    filled = [F.coalesce(F.col(f"row.{f.name}"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"row.{f.name}") for f in row]
    return raw.select(key, *filled)


def read_labs(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_json(spark, path, LAB, "lab_id")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_json(spark, path, DOCUMENT, "doc_id")


def write_store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A store as Parquet, written once for a batch; ``by`` names partition columns of few values."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_store(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A JDBC table; pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_database(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their bytes (path, length, content), to be parsed by a mapInPandas of one's own."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
