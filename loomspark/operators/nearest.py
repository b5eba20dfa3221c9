"""Nearest rows by cosine for a stated set of queries, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

BLOCK = 4096
# Queries and rows whose products a task holds at once.
QUERY_TILE, ROW_TILE = 512, 2048
# How far a matrix product may be from the cosine itself.
SLACK = 1e-11


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _squares(columns: np.ndarray) -> np.ndarray:
    out = np.zeros(columns.shape[1])
    for x in columns:
        out += x * x
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, key, cosine: for each query (query_id, vector) its k nearest other rows, ties by key.

    Queries are sent in blocks of at most ``block`` vectors, so what is broadcast never
    grows; each task keeps k rows a query, so what is shuffled grows with tasks, not rows.
    Products are made in tiles, so a task's memory depends on neither table.
    """
    spark = ship_package(rows.sparkSession)
    asked, parts = iter(queries.select("query_id", vector).toLocalIterator()), []
    while held := list(islice(asked, block)):
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)))
        parts.append(_pass(rows.select(key, vector), sent, k, key))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query_id long, {key} long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key))
    found = reduce(DataFrame.union, parts).withColumn("_rank", rank)
    return found.where(F.col("_rank") <= k).drop("_rank")


def _pass(rows: DataFrame, sent, k: int, key: str) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in best_rows(batches, *sent.value, k):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", key, "cosine"])

    return rows.mapInArrow(best, f"query_id long, {key} long, cosine double")


def best_rows(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, keys, cosines) of the k nearest rows of all batches (key, vector), for one tile of queries after the other."""
    tiles = [_Tile(ids[i : i + QUERY_TILE], vectors[i : i + QUERY_TILE], k) for i in range(0, len(ids), QUERY_TILE)]
    for batch in batches:
        whole = batch.filter(batch.column(1).is_valid())
        for i in range(0, len(whole), ROW_TILE):
            part = whole.slice(i, ROW_TILE)
            n = part.column(1).value_lengths().to_numpy()
            if (n != vectors.shape[1]).any():
                raise ValueError(f"vectors of {n.min()} to {n.max()} numbers, queries of {vectors.shape[1]}")
            m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), vectors.shape[1])
            keys, unit, columns = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _unit(m), np.ascontiguousarray(m.T)
            squares = _squares(columns)
            for tile in tiles:
                tile.meet(keys, unit, columns, squares)
    for tile in tiles:
        yield tile.ids[tile.top_q], tile.top_k, tile.top_s


class _Tile:
    """Some queries and the k best rows each has met, as flat columns in order: place of the query, key, cosine."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.unit, self.columns = ids, k, _unit(vectors), np.ascontiguousarray(vectors.T)
        self.squares, self.least = _squares(self.columns), np.full(len(ids), -np.inf)
        self.top_q, self.top_k, self.top_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, keys: np.ndarray, unit: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> None:
        s = self.unit @ unit.T
        s[self.ids[:, None] == keys[None, :]] = -np.inf
        least = self.least
        if len(keys) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(np.where(np.isnan(s), -np.inf, s), -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
        if not len(q):
            return
        # A matrix product sums in an order of its own, which parts equal vectors; what may count is summed term by term.
        dot = np.zeros(len(q))
        for a, b in zip(self.columns, columns, strict=True):
            dot += a[q] * b[r]
        norm = np.sqrt(self.squares[q] * squares[r])
        cosine = np.clip(np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), -1.0, 1.0)
        q, key, cosine = np.concatenate([self.top_q, q]), np.concatenate([self.top_k, keys[r]]), np.concatenate([self.top_s, cosine])
        order = np.lexsort((key, -cosine, q))
        q, key, cosine = q[order], key[order], cosine[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.top_q, self.top_k, self.top_s = q[keep], key[keep], cosine[keep]
        full = place == self.k - 1
        self.least[q[full]] = cosine[full]
