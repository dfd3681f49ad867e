"""Nearest neighbours by a block matrix join in int8 with error bounds.

Vectors are dealt to blocks of bounded size, and each block of queries meets each block of candidates. In such a tile
the vectors are quantised to int8 and their products taken as one matrix; what quantising leaves bounds every product
from both sides. A candidate stays in the tile if its upper bound reaches the k-th largest lower bound, so nothing that
belongs to the k nearest is lost. Products of the pairs that stay are computed anew in double precision, and heaps merge
the k nearest of the tiles, a bounded number of tiles at a time. Before quantising, each vector is scaled by a power of
two, which changes no digit of it; bounds are scaled back, so vectors of every finite magnitude take part.

Vectors travel in their own type and are recomputed within the tile: ties (copies of one vector) are decided there by
vec_id, so a tile never returns more than k candidates of a query.

Defined cases: a product that overflows on the way, though its terms are finite, is that of the scaled vectors, scaled
back, which may be infinite; vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows
without a vec_id; only vectors of equal length are compared; a query's own vec_id is no candidate, and of several
queries with one vec_id the least vector counts; equal products go to the smaller vec_id; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _spark as S

#: Vectors of a block of queries and of candidates; tiles merged at once.
QUERY_ROWS, ROWS, FAN = 2048, 16384, 64
_CELLS = 2_000_000


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    element = vectors.schema[column].dataType.elementType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<float>" if element == "float" else "array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine & F.exists("vector", lambda x: x != 0))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two so that the largest component lies in [0.5, 1), and the exponents that scale them back."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64)
    # in two steps, as one power may be beyond what a number can hold
    half = -exponent // 2
    return np.ldexp(np.ldexp(x, half[:, None]), (-exponent - half)[:, None]), exponent


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, the norm of what they stand for and the norm of what is lost, of each row of scaled vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    about = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((about * about).sum(axis=1)), np.sqrt(((x - about) ** 2).sum(axis=1))


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
    return total


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last in double precision."""
    total = _sum(x, y)
    odd = np.flatnonzero(~np.isfinite(total))
    if len(odd):
        (a, e), (b, f) = scaled(x[odd]), scaled(y[odd])
        with np.errstate(over="ignore"):
            total[odd] = np.ldexp(_sum(a, b), e + f)
    return total


#: Exponents up to which bounds can be scaled by plain factors.
_PLAIN = 400


def nearest_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, product) of each query's k nearest candidates, all of them if fewer."""
    (qx, qp), (cx, cp) = scaled(q), scaled(c)
    qi, qs, qn, qe = quantised(qx)
    ci, cs, cn, ce = quantised(cx)
    norm = np.sqrt((cx * cx).sum(axis=1))
    left, right = qi.astype(np.float32), ci.astype(np.float32).T  # whole numbers, exact up to 1040 components
    exact = q.shape[1] * 127 * 127 < 1 << 24
    plain = max(np.abs(qp).max(), np.abs(cp).max()) <= _PLAIN
    power = np.ldexp(1.0, cp) if plain else None  # a query's own power changes no order
    least_step = q.shape[1] * 5e-324  # what products lose below the smallest numbers
    out = []
    step = max(1, _CELLS // max(len(cid), 1))
    for a in range(0, len(qid), step):
        b = min(a + step, len(qid))
        dot = (left[a:b] @ right).astype(np.float64) if exact else qi[a:b].astype(np.float64) @ ci.T.astype(np.float64)
        about = dot * qs[a:b, None] * cs
        bound = (qe[a:b, None] * norm + qn[a:b, None] * ce) * (1 + 1e-9) + 1e-12 * q.shape[1] * (qn[a:b, None] + qe[a:b, None]) * (cn + ce)
        low, high = about - bound, about + bound
        if plain:
            low *= power
            high *= power
        else:  # rounding to a number, or to none that can be held, keeps the order
            exponent = qp[a:b, None] + cp
            with np.errstate(over="ignore"):
                low, high = np.ldexp(low, exponent) - least_step, np.ldexp(high, exponent) + least_step
        own = qid[a:b, None] == cid
        low[own] = -np.inf
        least = np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k] if len(cid) > k else np.full(b - a, -np.inf)
        i, j = np.nonzero((high >= least[:, None]) & ~own)
        score = np.concatenate([products(q[a + i[s : s + 100_000]], c[j[s : s + 100_000]]) for s in range(0, len(i), 100_000)]) if len(i) else np.zeros(0)
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        out.append((qid[a + i[top]], cid[j[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND = "q long, c long, query_id long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _tile(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return pa.Table.from_arrays([pa.array([], f.type) for f in _FOUND], schema=_FOUND)
        q, c = queries.column("q")[0].as_py(), queries.column("c")[0].as_py()
        query, candidate, score = nearest_in_tile(np.asarray(queries.column("query_id")), _matrix(queries.column("query")), np.asarray(vectors.column("vec_id")), _matrix(vectors.column("vector")), k)
        n = len(query)
        return pa.Table.from_arrays([pa.array(np.full(n, q)), pa.array(np.full(n, c)), pa.array(query), pa.array(candidate), pa.array(score)], schema=_FOUND)

    return run


def _merged(k: int):
    """The k nearest of each query from several tiles, by a heap of k."""

    def run(table: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[float, int]]] = {}
        q, c = table.column("q")[0].as_py(), table.column("to")[0].as_py()
        for query, vec, score in zip(*[table.column(n).to_pylist() for n in ("query_id", "vec_id", "score")], strict=True):
            heap = best.setdefault(query, [])
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        rows = [(q, c, query, -v, s) for query, heap in best.items() for s, v in heap]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its k candidates of largest inner product.

    vectors and queries: (vec_id, vector), as from usable(). The result of a query is complete: recall is 1.
    """
    queries = S.cut(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    many, few = vectors.count(), queries.count()
    by_rows, by_queries = max(1, -(-many // ROWS)), max(1, -(-few // QUERY_ROWS))
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(by_queries)).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by_rows - 1).cast("long"))).alias("c"))
    # candidates with one vec_id may be many: they are dealt by their vectors too
    right = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(by_rows)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by_queries - 1).cast("long"))).alias("q"))
    found = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInArrow(S.frugal_pair(_tile(k)), FOUND)
    while by_rows > 1:
        found = found.withColumn("to", F.floor(F.col("c") / FAN).cast("long")).groupBy("q", "to").applyInArrow(_merged(k), FOUND)
        by_rows = -(-by_rows // FAN)
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("all"))  # k at most
    return best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


OP9_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
