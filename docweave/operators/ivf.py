"""An inverted-file index of vectors: every row stands in the cell of its nearest centroid, a query looks into a few cells.

The centroids are fitted by spherical k-means on a bounded sample (``SAMPLE`` rows, those with the
lowest hash of their id); every row is indexed. The number of cells to look into is chosen on the
sample for a wanted recall; vectors without clusters need many. The answer is approximate: recall
against the exact search of ``operators.knn`` is measured in the tests. Hot cells are spread by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.vectors import dot

SAMPLE = 20_000
SALTS = 8


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def fit(rows: DataFrame, id_col: str, vec_col: str, cells: int, k: int = 10, target: float = 0.95, rounds: int = 12) -> tuple[np.ndarray, int]:
    """(centroids, probes): at most ``cells`` unit centroids, and how many cells a query has to look into.

    ``probes`` is the least number that finds the share ``target`` of the ``k`` nearest rows, for
    200 rows of the sample against all of it.
    """
    taken = rows.filter(F.col(vec_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(vec_col).alias("vec")).orderBy("h").limit(SAMPLE).toPandas()
    if taken.empty:
        return np.zeros((0, 0)), 1
    m = _unit(taken["vec"])
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    asked = m[:: max(1, len(m) // 200)]
    near = np.argsort(-(asked @ m.T), axis=1)[:, 1 : k + 1]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # place of each cell for each query
    places = np.sort(np.take_along_axis(order, np.argmax(m @ centres.T, axis=1)[near], axis=1).ravel())
    return centres, int(places[min(len(places) - 1, int(target * len(places)))]) + 1 if len(places) else 1


def _cells_of(centres, probes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        for pdf in frames:
            if pdf.empty:
                continue
            m = _unit(pdf["vec"])
            near = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, : min(probes, len(c))]
            yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "id": np.repeat(pdf["id"].to_numpy(), near.shape[1]), "vec": [v for v in m for _ in range(near.shape[1])]})

    return run


def build(rows: DataFrame, id_col: str, vec_col: str, centres: np.ndarray) -> DataFrame:
    """(cell, id, vec) for every row with a vector; write it partitioned or bucketed by cell to keep it."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("vec IS NOT NULL")
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    return base.mapInPandas(_cells_of(shared, 1), f"cell int, id {base.schema['id'].dataType.simpleString()}, vec array<double>")


def search(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """Rows (query_id, id, score, rank): the best k of each query within its ``probes`` nearest cells; ties by id, itself left out."""
    base = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("vec IS NOT NULL")
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    asked = base.mapInPandas(_cells_of(shared, probes), f"cell int, id {base.schema['id'].dataType.simpleString()}, vec array<double>")
    asked = asked.select("cell", F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = index.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    scored = salted.join(asked, ["cell", "salt"]).filter("id <> query_id").select("query_id", "id", dot(F.col("vec"), F.col("query_vec")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")
