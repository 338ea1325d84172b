"""Vector search: exact (flat), inverted lists (IVF), navigable small worlds (NSW).

A search joins a batch of queries with all vectors. Queries under a checked bound are broadcast;
above it, blocks of queries meet blocks of vectors in a co-grouped shuffle. Either way products are
made tile by tile, so that a block's scores are never held at once. Only each part's best k leave it;
a window merges them. An index is built once and stored whole: vectors, or centroids and lists by
cell, or graphs by shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import cut

#: Queries that may be broadcast; queries and vectors of a block otherwise.
BROADCAST_QUERIES, QUERY_BLOCK, VECTOR_BLOCK = 4096, 2048, 100_000
#: Queries of a block of the exact search, where all vectors are shuffled once a block.
FLAT_QUERIES = 16_384
#: Queries and vectors whose scores are held at once.
TILE = 128, 8192
#: Similarities are ranked at this many decimals, ties by the vector's id.
DECIMALS = 9


class Index(Protocol):
    """What every index offers: build from vectors, search a batch of queries, be stored."""

    def build(self, vectors: DataFrame) -> "Index": ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def store(self, path: str) -> None: ...

    def restore(self, spark: SparkSession, path: str) -> "Index": ...


def matrix(vectors, unit: bool) -> np.ndarray:
    if isinstance(vectors, pa.Array):
        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    else:
        m = np.array([np.asarray(v, np.float64) for v in vectors])
    if unit and len(m):
        n = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, n, out=m.copy(), where=n > 0)
    return m


def _merge(best: np.ndarray, at: np.ndarray, s: np.ndarray, first: int) -> None:
    """Puts a tile's scores, of the vectors from ``first`` on, among each query's best so far, in place."""
    k, unit = best.shape[1], 10.0**-DECIMALS
    # what rounds to no more than the last of a full list is out, as it has the higher id
    limit = best[:, -1] + 0.4 * unit
    if s.shape[1] > k and len(new := np.flatnonzero(np.isneginf(limit))):
        limit[new] = np.partition(s[new], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1.1 * unit
    row, col = np.divmod(np.flatnonzero(s > limit[:, None]), s.shape[1])
    if not len(row):
        return
    n = np.bincount(row, minlength=len(best))
    some = np.flatnonzero(n)
    row = np.concatenate([np.repeat(some, k), row])
    score = np.concatenate([best[some].ravel(), np.round(s[row[len(some) * k :], col], DECIMALS)])
    where = np.concatenate([at[some].ravel(), first + col])
    starts = np.cumsum(n[some] + k) - n[some] - k
    top = np.lexsort((where, -score, row))[starts[:, None] + np.arange(k)]
    best[some], at[some] = score[top], where[top]


def _best(q: np.ndarray, v: pa.Table, scores: Callable, unit: bool, k: int) -> tuple[pa.Array, pa.ChunkedArray, np.ndarray]:
    """Each query's best k of ``v`` (item_id, embedding): the query's row, item, score; ties by id.
    Beside its arguments it holds one tile and k rows a query."""
    v = v.sort_by("item_id")
    k = min(k, v.num_rows)
    best, at = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
    for b in range(0, v.num_rows, TILE[1]):
        x = matrix(pa.concat_arrays(v["embedding"].slice(b, TILE[1]).chunks), unit)
        for a in range(0, len(q), TILE[0]):
            some = slice(a, a + TILE[0])
            _merge(best[some], at[some], scores(q[some], x), b)
    row, col = np.nonzero(best > -np.inf)
    return pa.array(row), v["item_id"].take(pa.array(at[row, col])), best[row, col]


def ranked(found: DataFrame, k: int, by: str = "query_id", item: str = "item_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _schema(queries: DataFrame, vectors: DataFrame) -> str:
    q_type, v_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["item_id"].dataType.simpleString()
    return f"query_id {q_type}, item_id {v_type}, score double"


def _few(queries: DataFrame, unit: bool) -> tuple[list, np.ndarray] | None:
    """Ids and matrix of the queries, if they are few enough to broadcast."""
    head = queries.select("query_id", "embedding").limit(BROADCAST_QUERIES + 1).collect()
    return ([r["query_id"] for r in head], matrix([r["embedding"] for r in head], unit)) if len(head) <= BROADCAST_QUERIES else None


def _blocks(column: str, n: int):
    return F.pmod(F.hash(column), F.lit(n))


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _met(left: DataFrame, right: DataFrame, keys: list[str], found: Callable[[pd.DataFrame, list, np.ndarray], pd.DataFrame], unit: bool, schema: str) -> DataFrame:
    """``found(vectors, query ids, query matrix)`` of every block of queries and of vectors that
    share their keys."""

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        return found(v, q["query_id"].tolist(), matrix(q["embedding"], unit))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)


def _inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return q @ v.T


def _from_distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = (-2 * q) @ v.T
    d += (q * q).sum(1)[:, None]
    d += (v * v).sum(1)
    np.maximum(d, 0, out=d)
    d += 1
    return np.reciprocal(d, out=d)


def _kinds(queries: DataFrame, vectors: DataFrame) -> tuple:
    return to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["item_id"].dataType), pa.float64()


def _found(ids: pa.Array | pa.ChunkedArray, best: tuple, kinds: tuple) -> pa.Table:
    """Rows of the queries of these ids from what :func:`_best` gives."""
    row, items, score = best
    return pa.table([ids.take(row).cast(kinds[0]), items.cast(kinds[1]), pa.array(score, kinds[2])], ["query_id", "item_id", "score"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to blocks of vectors."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= VECTOR_BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _met_exact(left: DataFrame, right: DataFrame, keys: list[str], scores: Callable, unit: bool, k: int) -> DataFrame:
    """The best k of every block of queries and of vectors that share their keys."""
    kinds = _kinds(left, right)

    def pair(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table([pa.array([], t) for t in kinds], ["query_id", "item_id", "score"])
        x = matrix(pa.concat_arrays(q["embedding"].chunks), unit)
        return _found(q["query_id"], _best(x, v.select(["item_id", "embedding"]), scores, unit, k), kinds)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, _schema(left, right))


class Flat:
    """Exact search. ``metric``: ``ip`` on unit vectors (cosine) or ``l2`` (score 1 / (1 + d²))."""

    def __init__(self, metric: str = "ip"):
        self.metric = metric

    def build(self, vectors: DataFrame) -> "Flat":
        """``vectors``: item_id, embedding."""
        self.vectors = vectors.select("item_id", "embedding")
        return self

    def store(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    def restore(self, spark: SparkSession, path: str) -> "Flat":
        return self.build(spark.read.parquet(f"{path}/vectors"))

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """``queries``: query_id, embedding. Returns query_id, item_id, score, rank."""
        schema, unit = _schema(queries, self.vectors), self.metric == "ip"
        scores = _inner if unit else _from_distance
        if few := _few(queries, unit):
            if not few[0]:
                return ranked(queries.sparkSession.createDataFrame([], schema), k)
            shared, kinds = queries.sparkSession.sparkContext.broadcast(few), _kinds(queries, self.vectors)

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                for v in _gathered(batches):
                    yield from _found(pa.array(ids, kinds[0]), _best(q, v, scores, unit, k), kinds).to_batches()

            return ranked(self.vectors.mapInArrow(near, schema), k)
        n_q = -(-queries.count() // FLAT_QUERIES)
        # no block above the bound, and work for all cores
        n_v = max(1, -(-self.vectors.count() // VECTOR_BLOCK), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // n_q))
        left = queries.withColumn("qb", _blocks("query_id", n_q)).withColumn("vb", _every(n_v))
        right = self.vectors.withColumn("vb", _blocks("item_id", n_v)).withColumn("qb", _every(n_q))
        return ranked(_met_exact(left, right, ["qb", "vb"], scores, unit, k), k)


def ivf_cells(n: int, wanted: int = 100) -> int:
    """Cells for n vectors: as wanted, but at most the root of n, at least one."""
    return min(wanted, max(1, int(n**0.5)))


class IVF:
    """Inverted lists: each vector in the cell of its nearest centroid, ``probes`` cells a query."""

    def __init__(self, cells: int = 100, probes: int = 1, seed: int = 42):
        self.cells, self.probes, self.seed = cells, probes, seed

    def train(self, vectors: DataFrame) -> list[tuple[int, list[float]]]:
        """Centroids by k-means over unit vectors."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        from ..functions.vectors import l2_normalize

        k = ivf_cells(vectors.count(), self.cells)
        unit = vectors.select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
        if k == 1:
            return [(0, [0.0] * len(vectors.select("embedding").first()[0]))]
        model = KMeans(k=k, seed=self.seed, maxIter=10).fit(unit)
        return [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]

    def build(self, vectors: DataFrame, centroids: list[tuple[int, list[float]]] | None = None) -> "IVF":
        self.centroids = centroids or self.train(vectors)
        self.lists = assign(vectors.select("item_id", "embedding"), self.centroids)
        return self

    def _blocks_a_cell(self) -> int:
        """Blocks into which cells are cut, by the largest of them."""
        return max(1, -(-(self.lists.groupBy("cell").count().agg(F.max("count")).first()[0] or 0) // VECTOR_BLOCK))

    def store(self, path: str) -> None:
        """Lists by cell, a large cell in several files; centroids last, as the mark of a whole index."""
        dealt = self.lists.repartition("cell", _blocks("item_id", self._blocks_a_cell()))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
        rows = self.lists.sparkSession.createDataFrame(self.centroids, "cell int, centroid array<double>")
        rows.write.mode("overwrite").parquet(f"{path}/centroids")

    def restore(self, spark: SparkSession, path: str) -> "IVF":
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.centroids = [(r["cell"], list(r["centroid"])) for r in rows]
        self.lists = spark.read.parquet(f"{path}/lists")
        return self

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """As ``Flat``; a query meets the rows of its cells only, cells that none asks are not read."""
        schema = _schema(queries, self.lists)
        if few := _few(queries, True):
            if not few[0]:
                return ranked(queries.sparkSession.createDataFrame([], schema), k)
            asked = _cells(few[1], self.centroids, self.probes)
            shared, kinds = queries.sparkSession.sparkContext.broadcast((*few, asked)), _kinds(queries, self.lists)

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q, cells = shared.value
                for b in batches:
                    at = b.column(2).to_numpy()
                    for c in np.unique(at):
                        rows, who = pa.array(np.flatnonzero(at == c)), np.flatnonzero((cells == c).any(1))
                        if len(who):
                            v = pa.Table.from_batches([b.select([0, 1]).take(rows)])
                            yield from _found(pa.array([ids[i] for i in who], kinds[0]), _best(q[who], v, _inner, True, k), kinds).to_batches()

            lists = self.lists.where(F.col("cell").isin(np.unique(asked).tolist()))
            return ranked(lists.select("item_id", "embedding", "cell").mapInArrow(near, schema), k)
        n_q, n_v = -(-queries.count() // QUERY_BLOCK), self._blocks_a_cell()
        q = assign(queries.select("query_id", "embedding"), self.centroids, self.probes)
        left = q.withColumn("qb", _blocks("query_id", n_q)).withColumn("vb", _every(n_v))
        right = self.lists.withColumn("vb", _blocks("item_id", n_v)).withColumn("qb", _every(n_q))
        return ranked(_met_exact(left, right, ["cell", "qb", "vb"], _inner, True, k), k)


def _cells(unit: np.ndarray, centroids: list[tuple[int, list[float]]], probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of every row."""
    s = np.round(unit @ np.array([v for _, v in centroids], np.float64).T, DECIMALS)
    return np.array([i for i, _ in centroids], np.int32)[np.argsort(-s, axis=1, kind="stable")[:, :probes]]


def assign(vectors: DataFrame, centroids: list[tuple[int, list[float]]], probes: int = 1) -> DataFrame:
    """Adds ``cell``: the ``probes`` centroids of greatest inner product with the unit vector
    (ties to the lower cell), one row each. The centroids are a fixed number of rows."""

    @F.arrow_udf("array<int>")
    def of(arrays: pa.Array) -> pa.Array:
        return pa.array(_cells(matrix(arrays, True), centroids, probes).tolist() if len(arrays) else [], pa.list_(pa.int32()))

    return vectors.withColumn("cell", F.explode(of("embedding")))


class NSW:
    """Small-world graphs, one per shard, searched greedily with a beam; shards' bests are merged.
    A graph is built once and kept as a table: node, item, vector and edges by shard."""

    def __init__(self, m: int = 32, beam_build: int = 40, beam_search: int = 96, shard_rows: int = 20_000):
        self.m, self.beam_build, self.beam_search, self.shard_rows = m, beam_build, beam_search, shard_rows

    def build(self, vectors: DataFrame) -> "NSW":
        n = max(1, -(-vectors.count() // self.shard_rows))
        dealt = vectors.select("item_id", "embedding").withColumn("shard", _blocks("item_id", n))
        kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("item_id", "embedding")}
        graph, m, beam = self.graph, self.m, self.beam_build

        def made(v: pd.DataFrame) -> pd.DataFrame:
            v = v.sort_values("item_id").reset_index(drop=True)
            return v.assign(node=range(len(v)), edges=graph(matrix(v["embedding"], True), m, beam))[["shard", "node", "item_id", "embedding", "edges"]]

        schema = f"shard int, node int, item_id {kinds['item_id']}, embedding {kinds['embedding']}, edges array<int>"
        self.graphs = cut(dealt.groupBy("shard").applyInPandas(made, schema), "graphs")
        return self

    def store(self, path: str) -> None:
        self.graphs.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/graphs")

    def restore(self, spark: SparkSession, path: str) -> "NSW":
        self.graphs = spark.read.parquet(f"{path}/graphs")
        return self

    @staticmethod
    def _walk(x: np.ndarray, edges: list[list[int]], q: np.ndarray, beam: int, upto: int) -> list[tuple[float, int]]:
        first = float(x[0] @ q)
        seen, heap, best = {0}, [(-first, 0)], [(first, 0)]
        while heap:
            s, i = heapq.heappop(heap)
            if len(best) >= beam and -s < best[0][0]:
                break
            fresh = [j for j in edges[i] if j not in seen and j < upto]
            seen.update(fresh)
            if fresh:
                for sim, j in zip((x[fresh] @ q).tolist(), fresh, strict=True):
                    if len(best) < beam:
                        heapq.heappush(best, (sim, j))
                        heapq.heappush(heap, (-sim, j))
                    elif sim > best[0][0]:
                        heapq.heapreplace(best, (sim, j))
                        heapq.heappush(heap, (-sim, j))
        return sorted(best, reverse=True)

    @classmethod
    def graph(cls, x: np.ndarray, m: int, beam: int) -> list[list[int]]:
        edges: list[list[int]] = [[] for _ in x]
        for i in range(1, len(x)):
            for _, j in cls._walk(x, edges, x[i], beam, i)[:m]:
                edges[i].append(j)
                edges[j].append(i)
        return edges

    def search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        schema, beam, walk = _schema(queries, self.graphs), max(self.beam_search, k), self._walk

        def found_in(v: pd.DataFrame, ids: list, q: np.ndarray) -> pd.DataFrame:
            v = v.sort_values("node")
            x, edges, items = matrix(v["embedding"], True), [e.tolist() for e in v["edges"]], v["item_id"].tolist()
            rows = [(qi, items[j], round(s, DECIMALS)) for qi, vec in zip(ids, q, strict=True) for s, j in walk(x, edges, vec, beam, len(x))[:k]]
            return pd.DataFrame(rows, columns=["query_id", "item_id", "score"])

        if few := _few(queries, True):
            shared = queries.sparkSession.sparkContext.broadcast(few)
            return ranked(self.graphs.groupBy("shard").applyInPandas(lambda v: found_in(v, *shared.value), schema), k)
        n_q = -(-queries.count() // QUERY_BLOCK)
        n = 1 + (self.graphs.agg(F.max("shard")).first()[0] or 0)
        left = queries.select("query_id", "embedding", _blocks("query_id", n_q).alias("qb")).withColumn("shard", _every(n))
        right = self.graphs.withColumn("qb", _every(n_q))
        return ranked(_met(left, right, ["qb", "shard"], found_in, True, schema), k)


INDEXES = {"flat": Flat, "ivfflat": IVF, "hnsw": NSW}


def _place(path: str, encoder: str, kind: str) -> str:
    return f"{path}/encoder={encoder}/index={kind}"


def save_index(index: Index, path: str, encoder: str) -> None:
    """A built index under ``path/encoder=../index=..`` as Parquet."""
    index.store(_place(path, encoder, next(k for k, c in INDEXES.items() if type(index) is c)))


def load_index(spark: SparkSession, path: str, encoder: str, kind: str = "flat", **options) -> Index:
    """The stored index of this kind (``options`` are its constructor's), else the exact one;
    neither: FileNotFoundError."""
    for name, made in ((kind, lambda: INDEXES[kind](**options)), ("flat", Flat)):
        try:
            return made().restore(spark, _place(path, encoder, name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no index for {encoder} under {path}")
