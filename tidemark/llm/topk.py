"""Exact top-k by inner product, with a uniform threshold in three phases.

Rows and queries are dealt into blocks, and each pair of a query block and a row
block is one group of a shuffle. The dimensions are cut into ``parts``; a list of
local scores belongs to a row block and a part.

1. Each list gives its k best local scores per query; the k-th best whole score of
   the vectors named this way is a safe cutoff: no vector below it can be among the k best.
2. The cutoffs go to every block with the queries. A vector that reaches the cutoff
   has a part of at least cutoff / parts, so each list collects its entries from there on.
3. The whole score of each collected vector is resolved exactly. Of a row block the k
   best per query suffice; the last k are taken over all of them.

Scores are sums of products of integers, exact in 64-bit floats while every sum stays
below 2^53; larger vectors go by Python integers, and a score beyond 64 bits is an error.

Defined results: ties go to the smaller ``vec_id``; a vector that is null, or holds a
null, NaN or infinity, takes no part, nor does a row without ``vec_id``; a query meets
all rows but those of its own id; vectors of other lengths than the query's are skipped
for it (they have no inner product); an empty vector scores 0 with empty ones; rows
that repeat an id are candidates each, and ask once; fewer candidates than k give
fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_EXACT = 2.0**53


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``dims`` and ``x``: floor(``scale`` * component) as doubles, of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    return embeddings.where(ok & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((len(column), 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= _EXACT:
        whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
        return whole(q) @ whole(x).T
    return q @ x.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _pairs(rows: DataFrame, queries: DataFrame, row_block: int, query_block: int) -> tuple[DataFrame, DataFrame]:
    """Each side with the number of its block and one copy for each block of the other side."""
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"))
    asked = queries.groupBy("dims").agg(F.count("*").alias("m"))
    blocks = counts.join(asked, "dims").select("dims", F.ceil(F.col("n") / row_block).alias("rows_in"), F.ceil(F.col("m") / query_block).alias("queries_in"))

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        place: Column = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col(own))
        side = side.join(blocks, "dims").withColumn(names[0], place)
        return side.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("rows_in", "queries_in")

    return dealt(rows, "rows_in", "queries_in", ("r", "s")), dealt(queries, "queries_in", "rows_in", ("s", "r"))


def _local_lists(k: int, parts: int):
    """Phase 1 in one pair of blocks: the whole scores of the k best of each part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for q, query, x, ids in _sides(left, right):
            cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
            local = [_products(q[:, a:b], x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            for i, one in enumerate(query):
                free = np.flatnonzero(ids != one)
                at = np.unique(np.concatenate([free[_best(p[i, free], ids[free], k)] for p in local])) if len(free) else free
                # Python integers stay exact beyond 2^53.
                out.append((np.full(len(at), one), ids[at], sum(p[i, at] for p in local)))
        return _table(out)

    return run


def _collect(k: int, parts: int):
    """Phases 2 and 3 in one pair of blocks: what reaches the cutoff in some part, resolved."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        cutoff = dict(zip(right.column("vec_id").to_pylist(), right.column("cutoff").to_pylist()))
        for q, query, x, ids in _sides(left, right):
            cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
            local = [_products(q[:, a:b], x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            for i, one in enumerate(query):
                keep = ids != one
                if (least := cutoff[one]) is not None:
                    keep &= np.any([p[i] * parts >= least for p in local], axis=0)
                at = np.flatnonzero(keep)
                whole = sum(p[i, at] for p in local)
                best = _best(whole, ids[at], k)
                out.append((np.full(len(best), one), ids[at][best], whole[best]))
        return _table(out)

    return run


def _sides(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query matrix and ids, row matrix and ids of a pair of blocks, a few queries at a time."""
    if not left.num_rows or not right.num_rows:
        return
    dims = left.column("dims")[0].as_py()
    x, ids = _matrix(left.column("x").combine_chunks(), dims), left.column("vec_id").to_numpy()
    q, query = _matrix(right.column("x").combine_chunks(), dims), right.column("vec_id").to_numpy()
    step = max(1, 4_000_000 // max(1, len(ids)))
    for start in range(0, len(query), step):
        yield q[start : start + step], query[start : start + step], x, ids


def _table(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
    scores = pa.array([int(s) for s in joined[2]], pa.int64())
    return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": scores})


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int = 2, row_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` best of ``vectors`` for each of ``queries``.

    Both have ``vec_id``, ``dims`` and ``x`` as ``quantised`` gives them.
    """
    # Both may come from one table: the queries get columns of their own.
    asked = queries.select("vec_id", "dims", "x").dropDuplicates(["vec_id"]).toDF("vec_id", "dims", "x")
    rows, wanted = _pairs(vectors, asked, row_block, query_block)
    by = ["dims", "r", "s"]
    first = rows.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(_local_lists(k, parts), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    cutoffs = cutoffs.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    cutoffs = stored(cutoffs.select("query_id", F.when(F.col("n") == k, F.col("low")).alias("cutoff")), "cutoffs")
    bounded = asked.join(cutoffs, asked["vec_id"] == cutoffs["query_id"], "left").select("vec_id", "dims", "x", "cutoff")
    rows, wanted = _pairs(vectors, bounded, row_block, query_block)
    found = rows.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(_collect(k, parts), _FOUND)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` best vectors for each one whose ``vec_id`` is divisible by ``every``."""
    vectors = stored(quantised(embeddings.select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
