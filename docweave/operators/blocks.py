"""A stated set of queries against all rows, in blocks of bounded size.

Queries that fit into one block are broadcast, behind a check of their size, and the rows stay where
they are. Beyond that both sides are dealt: queries to blocks, rows to parts, and each (block, part)
meets once in a task, so that neither the driver nor a task ever holds more than one block and one
part, and the rows are read once. The work of an exact answer is the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Score = Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def meet(rows: DataFrame, row_id: str, queries: DataFrame, query_id: str, score: Score, schema: str, n_queries: int, block: int, part: int) -> DataFrame:
    """What ``score(queries of a block, frames of rows)`` yields for every block and all rows.

    ``block`` is the most queries that may stand together, ``part`` the same of the rows; all rows of
    one query id stay together in a block.
    """
    if n_queries <= block:
        shared = rows.sparkSession.sparkContext.broadcast(queries.toPandas())  # at most ``block`` queries

        def with_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if len(shared.value):
                yield from score(shared.value, frames)

        return rows.mapInPandas(with_all, schema)
    blocks, parts = -(-n_queries // block), max(1, -(-rows.count() // part))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select("*", number(query_id, blocks).alias("_block"), every(parts, "_part"))
    held = rows.select("*", number(row_id, parts).alias("_part"), every(blocks, "_block"))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(score(right.drop(columns=["_block", "_part"]), iter([left]))) if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame()

    return held.groupBy("_block", "_part").cogroup(asked.groupBy("_block", "_part")).applyInPandas(both, schema)
