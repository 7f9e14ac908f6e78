"""Exact top-k by inner product with a vector-approximation file.

Each dimension's range is cut into ``2**bits`` equal cells (ranges from one aggregate over all
rows). A partition keeps the cell numbers of its vectors, one byte a dimension, and scans them
first: the cells bound every score from above. Exact vectors are then read in blocks, best bound
first, until the k-th exact score of every query is at least the best bound not yet read. The k
best of each partition meet in a top-k by query. Queries go out in blocks of a stated size, so what
a task holds doesn't grow with their number; candidates stream by partition.

Scores are integer inner products of the vectors given as longs. Bounds are widened by their
rounding error, so they are never too small and the result is exact.

Edge cases: a vector that is null, empty, or holds a null takes no part (callers turn non-finite
components into nulls); vectors of other lengths than a query's are no candidates of it; ties go
to the smaller id; a repeated row is a candidate by itself, but no row of the query's own id is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import ship

BLOCK = 512  # queries of one block
ROWS = 4096  # candidates scanned together
READ = 64  # exact vectors of a query read together


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<long>) of the rows whose vector is there and without nulls."""
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(
        "id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)")


class Cells:
    """The grid of one vector length: ``low`` and ``width`` of each dimension's cells."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = 6):
        self.low, n = low.astype(np.float64), 1 << bits
        self.width = np.maximum((high.astype(np.float64) - self.low) / n, 1e-300)
        self.top = n - 1

    def codes(self, vecs: np.ndarray) -> np.ndarray:
        return np.clip((vecs - self.low) / self.width, 0, self.top).astype(np.uint8)

    def upper(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, queries x vectors."""
        q = queries.astype(np.float64)
        mid = q @ (self.low + (codes + 0.5) * self.width).T
        half = np.abs(q) @ (self.width / 2)
        size = np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.low + self.width * (self.top + 1)))
        return mid + (half + 1e-9 * (1 + size))[:, None]


def best_of(queries: np.ndarray, query_ids: np.ndarray, vecs: np.ndarray, ids: np.ndarray, cells: Cells, k: int,
            kept: list[list[tuple[int, int]]]) -> int:
    """Merge the candidates into ``kept`` (per query, up to k of (-score, id)); returns the exact
    vectors read."""
    bound = cells.upper(queries, cells.codes(vecs))
    read = 0
    for i, q in enumerate(queries):
        best, mine = kept[i], bound[i]
        open_ = np.flatnonzero(mine >= -best[-1][0]) if len(best) == k else np.arange(len(ids))
        if not len(open_):
            continue
        order = open_[np.argsort(-mine[open_], kind="stable")]
        for at in range(0, len(order), READ):
            if len(best) == k and mine[order[at]] < -best[-1][0]:
                break
            part = order[at:at + READ]
            part = part[ids[part] != query_ids[i]]
            read += len(part)
            scores = vecs[part] @ q  # longs: exact
            best = sorted([*best, *zip((-scores).tolist(), ids[part].tolist(), strict=True)])[:k]
        kept[i] = best
    return read


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec", bits: int = 6,
          block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates among ``rows`` of every query."""
    ship(rows.sparkSession)
    spark, cand, asked = rows.sparkSession, valid_vectors(rows, id_col, vec_col), valid_vectors(queries, id_col, vec_col)
    ranges = (cand.select(F.size("vec").alias("d"), F.posexplode("vec")).groupBy("d", "pos")
              .agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("d", "pos").collect())  # d x d rows
    grids = {}
    for d in {r["d"] for r in ranges}:
        own = [r for r in ranges if r["d"] == d]
        grids[d] = Cells(np.array([r["low"] for r in own]), np.array([r["high"] for r in own]), bits)
    n_blocks = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    found = []
    for number in range(n_blocks):
        held = [(r["id"], r["vec"]) for r in numbered.where(F.col("block") == number).select("id", "vec").collect()]  # about `block` rows
        found.append(cand.mapInPandas(scan_with(held, grids, k), "query_id long, vec_id long, score long"))
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan_with(held: list[tuple[int, list[int]]], grids: dict[int, Cells], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = {}
        for d, cells in grids.items():
            own = [(i, v) for i, v in held if len(v) == d]
            if own:
                blocks[d] = (np.array([v for _, v in own], np.int64), np.array([i for i, _ in own], np.int64), cells, [[] for _ in own])
        for b in batches:
            lengths = b["vec"].map(len).to_numpy()
            for d, (qs, qids, cells, kept) in blocks.items():
                own = b[lengths == d]
                for at in range(0, len(own), ROWS):
                    part = own.iloc[at:at + ROWS]
                    best_of(qs, qids, np.stack(part["vec"].to_numpy()).astype(np.int64), part["id"].to_numpy(np.int64), cells, k, kept)
        for _, qids, _, kept in blocks.values():
            out = [(q, v, -s) for q, best in zip(qids.tolist(), kept, strict=True) for s, v in best]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run
