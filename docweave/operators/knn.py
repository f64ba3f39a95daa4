"""Exact nearest neighbours of a stated set of query vectors among all rows.

Each task multiplies its rows with a block of queries and keeps the best k of each query, so the
last shuffle carries k rows for each task and query, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.blocks import meet

BLOCK_BYTES = 16_000_000  # of the vectors of a block of queries
PART_ROWS = 65_536
CELLS = 4_000_000  # scores that a task holds at a time


def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _cut(df: pd.DataFrame, k: int) -> pd.DataFrame:
    return df.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def nearest(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, query_col: str | None = None, at_least: float | None = None, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows (query_id, id, score, rank) of the k most similar rows by cosine, ``at_least`` so similar; ties by id.

    ``query_col`` is the id of the queries where it is not that of the rows; else a query does not
    find itself. Null vectors are left out on both sides.
    """
    base = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("vec IS NOT NULL")
    asked = queries.select(F.col(query_col or id_col).alias("query_id"), F.col(vec_col).alias("query_vec")).filter("query_vec IS NOT NULL")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("query_vec")).alias("dim")).first()
    same = query_col is None

    def best_of(mine: pd.DataFrame, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = mine["query_id"].to_numpy(), _matrix(mine["query_vec"])
        top: list[pd.DataFrame] = []
        step = max(64, CELLS // len(ids))
        for pdf in frames:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                own = part["id"].to_numpy()
                score = m @ _matrix(part["vec"]).T
                if same:
                    score[ids[:, None] == own[None, :]] = -np.inf
                if at_least is not None:
                    score[score < at_least] = -np.inf
                keep = min(k, score.shape[1])
                floor = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                q, c = np.nonzero((score >= floor[:, None] - 1e-12) & np.isfinite(score))
                top.append(pd.DataFrame({"query_id": ids[q], "id": own[c], "score": score[q, c]}))
                if len(top) > 16:
                    top = [_cut(pd.concat(top), k)]
        if top:
            yield _cut(pd.concat(top), k)

    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, score double"
    found = meet(base, "id", asked, "query_id", best_of, schema, size["n"], max(1, block_bytes // (8 * (size["dim"] or 1))), part_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")
