"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; a cell of the index is a pair of
centroids. For a query the cells come from a heap in order of the summed nearness of both halves (here minus
the inner product, which is a sum over the halves), until the cells taken hold enough entries; these are reranked by
their original vectors in double precision. How many are enough is measured: a bounded sample of queries is searched
in full, and the share of entries that holds ``recall`` of their neighbours is taken for all.

Equal vectors are one entry with the smallest ids of its copies, as no more of them can be among the nearest. The
entries lie in blocks of bounded size in order of cell; a query goes once to every block that has cells
of its own, in groups of bounded size, so a crowded cell is spread over several tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import stored


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector: the nearest centroid of either half."""
        cut = self.first.shape[1]
        one, two = (((c * c).sum(1) - 2 * h @ c.T).argmin(1) for c, h in ((self.first, x[:, :cut]), (self.second, x[:, cut:])))
        return one * len(self.second) + two

    def order(self, query: np.ndarray):
        """All cells, nearest first."""
        cut = self.first.shape[1]
        one, two = -(self.first @ query[:cut]), -(self.second @ query[cut:])
        by_one, by_two = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two = one[by_one].tolist(), two[by_two].tolist()
        heap = [(one[0] + two[0], 0, 0)]
        while heap:
            _, i, j = heap[0]
            yield int(by_one[i]) * len(self.second) + int(by_two[j])
            if j + 1 < len(two):
                heapq.heapreplace(heap, (one[i] + two[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))

    def nearest_cells(self, query: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Cells with entries, until they hold ``enough``."""
        out, held = [], 0
        for cell in self.order(query):
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
                if held >= enough:
                    break
        return out


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; empty centroids stay where they were."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = ((out * out).sum(1) - 2 * x @ out.T).argmin(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(out))
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles): vectors that are not null, not zero and of finite numbers only, of the commonest length.
    Rows equal in both count once."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where("v IS NOT NULL AND vec_id IS NOT NULL AND exists(v, x -> x != 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0)).distinct()


def entries_of(rows: DataFrame, copies: int) -> DataFrame:
    """One row per different vector with the ``copies`` smallest ids that have it."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= copies).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_cell(entries: DataFrame, books: Codebooks) -> DataFrame:
    shipped = entries.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.cell(matrix(batch.column("v"))), pa.int32())], names=[*batch.schema.names, "cell"])

    return entries.mapInArrow(run, "v array<double>, ids array<long>, cell int")


class Index:
    """Codebooks (at most ``most`` centroids a half), entries per cell, and the entries in blocks."""

    def __init__(self, rows: DataFrame, k: int, block: int, sample: int, most: int = 32):
        entries = stored(entries_of(rows, k + 1), "entries")
        self.size, self.k, self.session = entries.count(), k, rows.sparkSession
        if not self.size:
            return
        drawn = entries.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(sample).select("v").toPandas()  # the documented bound
        x = np.stack(drawn["v"].to_numpy())
        most = int(min(most, max(4, 2 ** round(np.log2(np.sqrt(self.size) / 4)))))
        cut = max(1, x.shape[1] // 2)
        halves = (x[:, :cut], x[:, cut:]) if x.shape[1] > 1 else (x, np.zeros((len(x), 1)))
        self.books = Codebooks(*(centroids(h, most) for h in halves))
        self.pad = x.shape[1] == 1
        celled = stored(with_cell(entries if not self.pad else entries.withColumn("v", F.concat("v", F.array(F.lit(0.0)))), self.books), "celled")
        counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per cell
        self.counts = np.zeros(self.books.cells, np.int64)
        for r in counts:
            self.counts[r["cell"]] = r["n"]
        # Blocks hold ``block`` entries on average: a cell has so many of its own, or shares one with its neighbours.
        ends = np.cumsum(self.counts)
        self.first_block = (ends - self.counts) // block
        self.blocks_of = np.maximum(1, (ends - 1) // block - self.first_block + 1)
        place = self.session.createDataFrame(pd.DataFrame({"cell": np.arange(len(ends), dtype=np.int32), "base": self.first_block, "spread": self.blocks_of}))
        self.blocks = stored(celled.join(F.broadcast(place), "cell").selectExpr("v", "ids", "cell", "base + pmod(xxhash64(v), spread) AS block"), "blocks")  # one row per cell


def search_blocks(index: Index, queries: DataFrame, enough: int, group: int) -> DataFrame:
    """Best ``k`` entries' copies of every query (by number) and block: query, query_id, vec_id, score, cell."""
    books, counts, base, spread, k = index.books, index.counts, index.first_block, index.blocks_of, index.k
    shipped = index.session.sparkContext.broadcast((books, counts, base, spread))

    def probe(batches):
        books, counts, base, spread = shipped.value
        for batch in batches:
            for query, query_id, vector in zip(batch.column("query").to_pylist(), batch.column("vec_id").to_pylist(), matrix(batch.column("v")) if batch.num_rows else [], strict=True):
                cells: dict[int, list[int]] = {}
                for c in books.nearest_cells(vector, counts, enough):
                    for b in range(int(base[c]), int(base[c] + spread[c])):
                        cells.setdefault(b, []).append(c)
                n = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * n, pa.int64()), pa.array([query_id] * n, pa.int64()), pa.array([vector.tolist()] * n, pa.list_(pa.float64())), pa.array(list(cells), pa.int64()),
                     pa.array(list(cells.values()), pa.list_(pa.int32()))], names=["query", "query_id", "query_v", "block", "cells"])

    groups = max(1, -(-queries.count() // group))
    sent = queries.mapInArrow(probe, "query long, query_id long, query_v array<double>, block long, cells array<int>")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    held = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(entries) and len(asked):
            x, cells = np.stack(entries["v"].to_numpy()), entries["cell"].to_numpy()
            smallest = np.array([i[0] for i in entries["ids"]])
            every, place = np.unique(cells, return_inverse=True)
            q = np.stack(asked["query_v"].to_numpy())
            for a in range(0, len(asked), 64):
                scores = q[a:a + 64] @ x.T
                for r, row in enumerate(scores):
                    own = np.isin(every, asked["cells"].iat[a + r])[place]
                    near = np.flatnonzero(own)
                    if len(near) > k + 1:
                        cut = np.partition(row[near], len(near) - k - 1)[len(near) - k - 1]
                        near = near[row[near] >= cut - 1e-9 * (1 + abs(cut))]
                    exact = (x[near] * q[a + r]).sum(1)
                    best = np.lexsort((smallest[near], -exact))[:k + 1]
                    found = sorted((-s, i, cells[near[b]]) for b, s in zip(best, exact[best], strict=True) for i in entries["ids"].iat[near[b]])
                    query_id = asked["query_id"].iat[a + r]
                    rows += [(asked["query"].iat[a + r], query_id, i, -s, c) for s, i, c in found if i != query_id][:k]
        return pd.DataFrame(rows, columns=["query", "query_id", "vec_id", "score", "cell"])

    return held.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInPandas(rerank, "query long, query_id long, vec_id long, score double, cell int")


def best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def enough_for(index: Index, queries: DataFrame, recall: float, sample: int, group: int) -> int:
    """Entries to take so that ``recall`` of the true neighbours of at most ``sample`` queries are among them."""
    drawn = stored(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "drawn")
    true = best(search_blocks(index, drawn, index.size, group), index.k).select("query", "cell").toPandas()  # sample * k rows
    vectors, needed = {r["query"]: np.array(r["v"]) for r in drawn.collect()}, []
    for query, rows in true.groupby("query"):
        held = dict(zip(order := index.books.nearest_cells(vectors[query], index.counts, index.size), np.cumsum(index.counts[order]), strict=True))
        needed += [held[c] for c in rows["cell"]]
    return int(np.quantile(needed, recall, method="higher")) if needed else index.size


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, block: int = 16_000, sample: int = 20_000,
            query_sample: int = 60, group: int = 2_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for every row whose id is divisible by ``every``, ties to the smaller id.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Vectors that are null, zero, hold null or
    non-finite numbers or have not the commonest length take no part, nor do rows without an id; a row is never its
    own neighbour; an id with two different vectors is searched for both. Codebooks are fitted to at most ``sample``
    entries, the share to rerank to at most ``query_sample`` queries; every row is indexed. Other columns are
    left behind; an empty table gives no rows.
    """
    rows = stored(usable(vectors, id_column, vector_column), "vectors")
    index = Index(rows, k, block, sample)
    queries = rows.where(F.col("vec_id") % every == 0)
    if not index.size:
        return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0.0D AS score").limit(0)
    if index.pad:
        queries = queries.withColumn("v", F.concat("v", F.array(F.lit(0.0))))
    queries = stored(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    enough = max(k + 1, enough_for(index, queries, recall, query_sample, group))
    return best(search_blocks(index, queries, enough, group), k).select("query_id", "rank", "vec_id", "score")
