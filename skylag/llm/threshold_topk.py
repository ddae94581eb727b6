"""Exact top-k inner products by the three-phase uniform threshold algorithm (operator 13).

A vector's components are dealt to ``nodes``; a node knows its slice of every vector, and a score is the sum of the nodes'
partial scores.

1. Each node gives its ``depth * k`` highest partial scores per query. What the other nodes add to these is asked
   for, and the k-th of the sums is the cutoff: the k-th best score overall cannot be lower.
2. The cutoff goes to all nodes. Each gives every partial score of at least cutoff / nodes. A vector that no node gives
   stays below the cutoff in total, whatever the signs.
3. Vectors whose given partial scores, with the most that silent nodes can add (just under cutoff / nodes each), fall short
   of the cutoff go; for the others the silent nodes are asked, which makes all scores exact.

A node's work is a grid of cells (group of vectors, block of queries), each one matrix product in one task; cells
have about ``GROUP_ROWS`` vectors and ``QUERY_ROWS`` queries, whatever the input. Of equal vectors only the k + 1 smallest
ids can be among the best k of any query, itself left out; the others are not searched, so that large groups of copies make
no pairs.

Components become floor(1024 * x). Products are exact: in doubles where all sums stay below 2 ** 53, else in 64-bit
integers, which also bound the scores. Vectors that are null or hold null, NaN or infinite components take no part, rows
without vec_id neither. Shorter vectors count as followed by zeros. Rows that repeat a vec_id are vectors and queries
of their own. Ties go to the smaller vec_id. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skylag.llm.tables import written

K = 10
NODES = 2
DEPTH = 5
GROUP_ROWS = 2048
QUERY_ROWS = 1024

PARTIAL = "query bigint, row bigint, vec_id bigint, node int, partial bigint"
CELL = ["node", "g", "b"]


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("bigint"))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("vector")))


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("part").combine_chunks()
    return values.flatten().to_numpy().reshape(table.num_rows, -1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, as 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2.0 ** 53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _given(queries: pa.Table, vectors: pa.Table, q: np.ndarray, v: np.ndarray, partial: np.ndarray) -> pa.Table:
    node = queries.column("node")[0].as_py() if queries.num_rows else 0
    return pa.table([pa.array(queries.column("query").to_numpy()[q]), pa.array(vectors.column("row").to_numpy()[v]),
                     pa.array(vectors.column("vec_id").to_numpy()[v]), pa.array(np.full(len(q), node, np.int32)),
                     pa.array(partial, pa.int64())], names=["query", "row", "vec_id", "node", "partial"])


def _others(queries: pa.Table, vectors: pa.Table) -> np.ndarray:
    """Which pairs are not a query with its own row."""
    return queries.column("query").to_numpy()[:, None] != vectors.column("row").to_numpy()[None, :]


def _highest(limit: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Phase 1 in a cell: the ``limit`` highest of each query."""
        if not queries.num_rows or not vectors.num_rows:
            return _given(queries, vectors, *[np.empty(0, np.int64)] * 3)
        scores = np.where(_others(queries, vectors), products(_matrix(queries), _matrix(vectors)), np.iinfo(np.int64).min)
        n = min(limit, scores.shape[1])
        v = np.argpartition(scores, -n, axis=1)[:, -n:].reshape(-1)
        q = np.repeat(np.arange(len(scores)), n)
        real = _others(queries, vectors)[q, v]
        return _given(queries, vectors, q[real], v[real], scores[q, v][real])
    return run


def _sufficient(nodes: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Phase 2 in a cell: all of at least cutoff / nodes; everything for a query without a cutoff."""
        if not queries.num_rows or not vectors.num_rows:
            return _given(queries, vectors, *[np.empty(0, np.int64)] * 3)
        least = np.array([-(-c // nodes) if c is not None else np.iinfo(np.int64).min for c in queries.column("cutoff").to_pylist()])
        scores = products(_matrix(queries), _matrix(vectors))
        q, v = np.nonzero((scores >= least[:, None]) & _others(queries, vectors))
        return _given(queries, vectors, q, v, scores[q, v])
    return run


def _asked(queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """The partial scores of the rows that each query names."""
    rows = vectors.column("row").to_numpy()
    order = np.argsort(rows)
    named = [np.asarray(x, np.int64) for x in queries.column("rows").to_pylist()]
    q = np.repeat(np.arange(len(named)), [len(x) for x in named])
    if not len(q):
        return _given(queries, vectors, *[np.empty(0, np.int64)] * 3)
    v = order[np.searchsorted(rows[order], np.concatenate(named))]
    a, b = _matrix(queries), _matrix(vectors)
    step = 1 << 16
    sums = [np.einsum("ij,ij->i", a[q[s:s + step]], b[v[s:s + step]]) for s in range(0, len(q), step)]
    return _given(queries, vectors, q, v, np.concatenate(sums))


class Grid:
    """Vectors in groups and queries in blocks, both by hash of their row, seen through the nodes' slices."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, dims: int, nodes: int, group_rows: int, query_rows: int):
        self.nodes, self.width = nodes, -(-dims // nodes)
        self.groups = max(1, -(-vectors.count() // group_rows))
        self.blocks = max(1, -(-queries.count() // query_rows))
        padded = F.concat("vector", F.array_repeat(F.lit(0).cast("bigint"), F.lit(self.width * nodes) - F.size("vector")))
        self.vectors = vectors.select("row", "vec_id", padded.alias("vector"))
        self.queries = queries.select(F.col("row").alias("query"), padded.alias("vector"))

    def group_of(self, row: str) -> Column:
        return F.pmod(F.xxhash64(F.col(row)), F.lit(self.groups)).cast("int")

    def _slices(self, frame: DataFrame, node: Column | None = None) -> DataFrame:
        every = F.explode(F.array(*[F.lit(n) for n in range(self.nodes)])) if node is None else node
        return (frame.withColumn("node", every).withColumn("part", F.slice("vector", F.col("node") * self.width + 1, F.lit(self.width)))
                .drop("vector"))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("query", F.lit(1)), F.lit(self.blocks)).cast("int")

    def run(self, work, queries: DataFrame) -> DataFrame:
        """``work`` in every cell that has queries; ``queries`` have node, g, b and part."""
        vectors = (self._slices(self.vectors).withColumn("g", self.group_of("row"))
                   .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))))
        return queries.groupBy(*CELL).cogroup(vectors.groupBy(*CELL)).applyInArrow(work, PARTIAL)

    def all_cells(self, queries: DataFrame) -> DataFrame:
        return (self._slices(queries).withColumn("b", self._block())
                .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))))

    def ask(self, pairs: DataFrame) -> DataFrame:
        """Partial scores for (query, row, node)."""
        wanted = (pairs.withColumn("g", self.group_of("row")).groupBy("query", "node", "g")
                  .agg(F.collect_list("row").alias("rows")))
        known = self._slices(wanted.join(self.queries, "query"), F.col("node")).withColumn("b", self._block())
        return self.run(_asked, known)


def _silent(seen: DataFrame, nodes: int) -> DataFrame:
    """(query, row, node) for the nodes that are not in the array ``given``."""
    every = F.array(*[F.lit(n) for n in range(nodes)])
    return seen.select("query", "row", F.explode(F.array_except(every, "given")).alias("node"))


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("query", "row").agg(F.first("vec_id").alias("vec_id"), F.sum("partial").alias("score"),
                                               F.collect_list("node").alias("given"))


def search(vectors: DataFrame, is_query: Column, k: int = K, nodes: int = NODES, depth: int = DEPTH,
           group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k highest scores of each row that ``is_query`` (over vec_id) selects, against every other row."""
    rows = written(quantized(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or nodes
    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id", "row")
    candidates = written(rows.withColumn("again", F.row_number().over(same)).filter(F.col("again") <= k + 1).drop("again"), "candidates")
    queries = rows.filter(is_query)
    grid = Grid(candidates, queries, dims, nodes, group_rows, query_rows)

    best = Window.partitionBy("query", "node").orderBy(F.desc("partial"))
    lists = grid.run(_highest(depth * k), grid.all_cells(grid.queries))
    lists = written(lists.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= depth * k).drop("n"), "lists")
    answered = lists.unionByName(grid.ask(_silent(_summed(lists), nodes)))
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    cutoffs = written(_summed(answered).withColumn("n", F.row_number().over(order)).filter(F.col("n") == k)
                      .select("query", F.col("score").alias("cutoff")), "cutoffs")

    given = grid.run(_sufficient(nodes), grid.all_cells(grid.queries.join(cutoffs, "query", "left")))
    seen = written(_summed(given), "seen")
    # A silent node is below cutoff / nodes, so adds at most the whole number before its ceiling.
    most = F.expr(f"(cutoff - 1 - pmod(cutoff - 1, {nodes})) div {nodes}")
    open_ = (seen.filter(F.size("given") < nodes).join(cutoffs, "query")
             .filter(F.col("score") + (nodes - F.size("given")) * most >= F.col("cutoff")).drop("cutoff"))
    asked = grid.ask(_silent(open_, nodes)).groupBy("query", "row").agg(F.sum("partial").alias("more"))
    scores = (seen.filter(F.size("given") == nodes).select("query", "vec_id", "score")
              .union(open_.join(asked, ["query", "row"]).select("query", "vec_id", (F.col("score") + F.col("more")).alias("score"))))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return (scores.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).join(names, "query")
            .select("query_id", "rank", "vec_id", "score"))
