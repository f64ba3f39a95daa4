"""Reporting views over labs, pages, tags, links and crawl requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lab_stats(lab: DataFrame, docs: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Counts for each lab. Every child is aggregated before it is joined, so nothing fans out."""
    by_doc = docs.groupBy("lab_id").agg(F.count("doc_id").alias("total_docs"), F.countDistinct("section").alias("sections_count"), F.avg("quality_score").alias("avg_doc_quality"))
    by_tag = tags.groupBy("lab_id").agg(F.count("*").alias("tags_count"))
    by_link = links.groupBy("lab_id").agg(F.count("*").alias("links_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        lab.join(by_doc, "lab_id", "left")
        .join(by_tag, "lab_id", "left")
        .join(by_link, "lab_id", "left")
        .select("lab_id", "kor_name", "professor", zero("total_docs"), zero("sections_count"), F.round("avg_doc_quality", 6).alias("avg_doc_quality"), zero("tags_count"), zero("links_count"), F.col("created_at").alias("last_crawled"))
    )


def section_distribution(docs: DataFrame) -> DataFrame:
    """Pages, mean tokens and mean quality of each section label as written."""
    return docs.groupBy("section").agg(F.count("*").alias("doc_count"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))


def active_summary(lab: DataFrame, docs: DataFrame, review_below: int = 50) -> DataFrame:
    """Labs with their embedded pages; the condition on pages stays in the join, so labs without any are kept."""
    counted = (
        docs.filter(F.col("embedding").isNotNull())
        .groupBy("lab_id")
        .agg(
            F.countDistinct("doc_id").alias("total_documents"),
            F.countDistinct(F.when(F.col("quality_score") < review_below, F.col("doc_id"))).alias("docs_need_review"),
            F.round(F.avg("quality_score"), 6).alias("avg_quality"),
        )
    )
    return lab.join(counted, "lab_id", "left").select(
        "lab_id", "kor_name", F.coalesce("total_documents", F.lit(0)).cast("long").alias("total_documents"), F.coalesce("docs_need_review", F.lit(0)).cast("long").alias("docs_need_review"), "avg_quality"
    )


def crawl_statistics(log: DataFrame) -> DataFrame:
    """Requests, successes, cache hits and mean response time of each day."""
    return log.groupBy(F.to_date("request_time").alias("crawl_date")).agg(
        F.count("*").alias("total_requests"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("long").alias("successful"),
        F.sum(F.when(F.col("used_cache"), 1).otherwise(0)).cast("long").alias("from_cache"),
        F.round(F.avg("response_time_ms"), 6).alias("avg_response_time_ms"),
    )


def store_stats(docs: DataFrame) -> DataFrame:
    """(metric, key, n, mean): totals and distributions of a store in one pass over two grouping sets."""
    return (
        docs.groupingSets([[], ["section"], ["lang"]], "section", "lang")
        .agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 2).alias("mean"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "section").otherwise("lang").alias("metric"),
            F.when(F.col("level") == 1, F.col("section")).when(F.col("level") == 2, F.col("lang")).alias("key"),
            "n",
            "mean",
        )
    )


def docs_per_lab(lab: DataFrame, docs: DataFrame) -> DataFrame:
    counts = docs.groupBy("lab_id").agg(F.count("*").alias("doc_count"))
    return lab.join(counts, "lab_id", "left").select("lab_id", F.coalesce("doc_count", F.lit(0)).cast("long").alias("doc_count"))


def tags_by_type(tags: DataFrame) -> DataFrame:
    """For each lab and tag type the values by falling confidence, joined with '|'; unknown confidence comes last."""
    value = F.trim("tag_value")
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), value.alias("v"))))
    return tags.groupBy("lab_id", F.lower(F.trim("tag_type")).alias("tag_type")).agg(F.count("*").alias("n_tags"), F.array_join(F.transform(ordered, lambda x: x["v"]), "|").alias("tag_values"))


def crawl_summary(log: DataFrame) -> DataFrame:
    """Counters of each lab's requests with success and cache rates in percent."""
    pct = lambda c: F.round(F.avg(F.when(F.col(c), 100.0).otherwise(0.0)), 6)
    return log.groupBy("lab_id").agg(
        F.count("*").alias("requests"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        pct("success").alias("success_pct"),
        pct("used_cache").alias("cache_pct"),
        F.max("request_time").alias("last_request"),
    )


def median_response(log: DataFrame) -> DataFrame:
    """Count, mean, extremes and exact median of the response times of each lab."""
    return log.filter(F.col("response_time_ms").isNotNull()).groupBy("lab_id").agg(
        F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 6).alias("mean_ms"), F.min("response_time_ms").alias("min_ms"), F.max("response_time_ms").alias("max_ms"), F.round(F.expr("percentile(response_time_ms, 0.5)"), 6).alias("median_ms")
    )
