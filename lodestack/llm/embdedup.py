"""Embedding near-duplicates by NN-descent.

Equal vectors are one class. Neighbour lists start from random-hyperplane buckets and are refined
through neighbours-of-neighbours joins: the vectors of a node's neighbours, forward and reverse,
meet and are compared, and a pair enters a list where it improves it. Rounds go on until no new
link appears. Every compared pair at the threshold counts, whether a list has room for it or not:
a bucket and a meeting report links that span all of theirs, and the links give components. A node
has two lists, the nearest in its component and the nearest outside, so that links known fill
the first only and the second goes on past them, however large the component. Link counts come
from all pairs of a component, compared in blocks. The number of bucket tables grows with the input,
so that a pair at the threshold meets in one of them with probability ``RECALL``. The mean recall of
rows that have links is audited against brute force for a sample that grows too; below the target
the lists are doubled and refined again, and if that does not help, all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, discard
from .components import connected_components

#: Length of the lists, least buckets in which a vector starts, mean vectors in a bucket.
NEIGHBOURS, TABLES, BUCKET = 8, 8, 48
#: Vectors compared at once; reverse neighbours of a node in a meeting (more meet in further ones,
#: each with the node's own lists).
BLOCK, REVERSE = 512, 16
#: Recall wanted, times the lists may be doubled before all vectors are compared.
RECALL, DOUBLINGS = 0.99, 2
#: Least vectors audited and how many a root of the classes; rows with links that an audit should
#: meet, times it grows fourfold to meet them; vectors broadcast at once.
AUDIT, AUDIT_ROOT, AUDIT_LINKED, AUDIT_GROWS, AUDIT_BLOCK = 2000, 8, 50, 2, 8192


def n_tables(bits: int, threshold: float) -> int:
    """Tables in which a pair at the threshold shares a bucket once with probability RECALL."""
    one = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return TABLES if one >= 1 else max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-one))))


def valid(e: str) -> Column:
    c = F.col(e)
    fine = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0)


def _units(bodies: list[bytes], dtype) -> np.ndarray:
    """Unit vectors (double) of packed vectors of one length."""
    x = np.frombuffer(b"".join(bodies), dtype).astype(np.float64).reshape(len(bodies), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the links in a symmetric matrix."""
    a, b, rest = [], [], near.any(1)
    for first in np.flatnonzero(rest).tolist():
        front = [first] if rest[first] else []
        rest[first] = False
        while front:
            x = front.pop()
            got = np.flatnonzero(near[x] & rest)
            rest[got] = False
            a += [x] * len(got)
            b += got.tolist()
            front += got.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first ``n_keys`` columns, regrouped: one batch per key."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(n_keys))

    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            part = b.slice(a, z - a)
            if held and key(held[0], 0) != key(part, 0):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _out(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c)) for c in columns], names)


#: A pair for a list or (``link``) one that joins two components.
_EDGE = "node long, nbr long, sim double, link int"
_NAMES = ["node", "nbr", "sim", "link"]


def _pairs(node: np.ndarray, sims: np.ndarray, a: np.ndarray, b: np.ndarray, link: int) -> pa.RecordBatch:
    return _out(_NAMES, node[a], node[b], sims[a, b], np.full(len(a), link, np.int32))


class Descent:
    """NN-descent over a table of classes: ``node``, ``v`` (packed vector), ``n``."""

    def __init__(self, classes: DataFrame, dtype, threshold: float):
        self.classes, self.dtype, self.threshold = classes, dtype, threshold
        self.size = classes.count()
        self.roots: DataFrame | None = None

    def start(self, k: int) -> DataFrame:
        """Lists from random-hyperplane buckets."""
        bits = int(np.clip(np.ceil(np.log2(max(self.size, 1) / BUCKET)), 0, 22))
        dtype, threshold, tables = self.dtype, self.threshold, n_tables(bits, self.threshold)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bodies = _bytes(b.column(1))
                sizes = np.array(list(map(len, bodies)))
                for s in np.unique(sizes):
                    at = np.flatnonzero(sizes == s)
                    x = _units([bodies[i] for i in at], dtype)
                    planes = np.random.default_rng([7, int(s)]).standard_normal((x.shape[1], tables * bits))
                    signs = (x @ planes > 0).reshape(len(at), tables, bits).astype(np.int64)
                    code = (signs << np.arange(bits)).sum(2) + (np.arange(tables) << 56) + (int(s) << 24)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(code[:, t]), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["key", "node", "v"])

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches, 1):
                for a in range(0, g.num_rows, BLOCK):
                    part = g.slice(a, BLOCK)
                    if part.num_rows > 1:
                        node, x = part.column(1).to_numpy(), _units(_bytes(part.column(2)), dtype)
                        sims = x @ x.T
                        np.fill_diagonal(sims, -2)
                        top = _top(sims, min(k, part.num_rows - 1))
                        yield _pairs(node, sims, np.repeat(np.arange(len(node)), top.shape[1]), top.ravel(), 0)
                        yield _pairs(node, sims, *_spanning(sims >= threshold), 1)

        dealt = self.classes.select("node", "v").mapInArrow(keys, "key long, node long, v binary")
        # by a hash of both, as the blocks of a large bucket should differ from table to table
        dealt = dealt.withColumn("at", F.xxhash64("key", "node")).repartitionByRange("key", "at").sortWithinPartitions("key", "at")
        return self.best(dealt.select("key", "node", "v").mapInArrow(tops, _EDGE).withColumn("new", F.lit(1)), k)

    def with_same(self, edges: DataFrame) -> DataFrame:
        """Adds ``root`` of the node and ``same``: whether both ends are in one component."""
        if self.roots is None:
            return edges.withColumn("root", F.col("node")).withColumn("same", F.lit(False))
        other = self.roots.select(F.col("node").alias("nbr"), F.col("root").alias("other"))
        met = edges.join(self.roots, "node", "left").join(other, "nbr", "left")
        return met.withColumn("same", F.coalesce(F.col("root") == F.col("other"), F.lit(False))).withColumn("root", F.coalesce("root", "node")).drop("other")

    def best(self, edges: DataFrame, k: int) -> DataFrame:
        """The k best neighbours of every node in its component and outside (``listed``), and all
        links between components; an edge is new if it was not there before."""
        one = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("link").alias("link"))
        rank = F.row_number().over(Window.partitionBy("node", "same").orderBy(F.desc("sim"), "nbr"))
        one = self.with_same(one).withColumn("listed", rank <= k).where("listed OR link = 1")
        return cut(one.select("node", "nbr", "sim", "new", "link", "listed"), "lists")

    def refine(self, lists: DataFrame, k: int) -> DataFrame:
        """One neighbours-of-neighbours join."""
        lists = lists.where("listed").select("node", "nbr", "sim", "new")

        def lowest(same: bool):
            here = F.col("same") == F.lit(same)
            return F.when(F.count_if(here) >= k, F.min(F.when(here, F.col("sim")))).otherwise(-2.0)

        floor = self.with_same(lists).groupBy("node").agg(F.first("root").alias("root"), lowest(True).alias("inner"), lowest(False).alias("outer"))
        vectors = self.classes.select("node", "v").join(floor, "node", "left").select(F.col("node").alias("w"), "v", F.coalesce("root", "node").alias("root"), F.coalesce("inner", F.lit(-2.0)).alias("inner"), F.coalesce("outer", F.lit(-2.0)).alias("outer"))
        back = lists.select(F.col("nbr").alias("u"), F.col("node").alias("w"), "new")
        meetings = back.groupBy("u").agg(F.ceil(F.count("*") / F.lit(REVERSE)).cast("int").alias("meetings"))
        back = back.join(meetings, "u").select("u", F.pmod(F.xxhash64("w"), "meetings").cast("int").alias("m"), "w", "new")
        own = lists.select(F.col("node").alias("u"), F.col("nbr").alias("w"), "new").join(meetings, "u", "left")
        own = own.select("u", F.explode(F.sequence(F.lit(0), F.coalesce("meetings", F.lit(1)) - 1)).alias("m"), "w", "new")
        both = own.unionByName(back).groupBy("u", "m", "w").agg(F.max("new").alias("new")).join(vectors, "w")
        dtype, threshold = self.dtype, self.threshold

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches, 2):
                new = g.column(3).to_numpy() > 0
                if g.num_rows < 2 or not new.any():
                    continue
                w, root, inner, outer = (g.column(i).to_numpy() for i in (2, 4, 5, 6))
                x = _units(_bytes(g.column(7)), dtype)
                sims = x @ x.T
                np.fill_diagonal(sims, -3)
                same = root[:, None] == root[None, :]
                a, b = np.nonzero((sims > np.where(same, inner[:, None], outer[:, None])) & (new[:, None] | new[None, :]))
                yield _pairs(w, sims, a, b, 0)
                yield _pairs(w, sims, *_spanning((sims >= threshold) & ~same), 1)

        dealt = both.select("u", "m", "w", "new", "root", "inner", "outer", "v").repartition("u", "m").sortWithinPartitions("u", "m", "w")
        found = dealt.mapInArrow(meet, _EDGE).withColumn("new", F.lit(1))
        return self.best(found.unionByName(lists.withColumn("new", F.lit(0)).withColumn("link", F.lit(0))), k)

    def unite(self, lists: DataFrame) -> bool:
        """Takes the links of a round into the components; whether they changed. ``roots`` has
        every node that is linked."""
        fresh = self.with_same(lists.where("link = 1")).where("NOT same").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        if self.roots is not None:
            if fresh.isEmpty():
                return False
            fresh = fresh.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, self.roots = self.roots, cut(connected_components(fresh), "roots")
        if before is None:
            return not self.roots.isEmpty()
        discard(before)
        return True

    def run(self, lists: DataFrame, k: int) -> DataFrame:
        """Rounds until one brings no new link, neither between components nor into a list."""
        self.unite(lists)
        while True:
            after = self.refine(lists, k)
            discard(lists)
            lists = after
            if not self.unite(lists) and lists.where((F.col("new") == 1) & (F.col("sim") >= self.threshold)).isEmpty():
                return lists

    def compare_all(self) -> None:
        """Components from all pairs, compared in blocks."""
        dtype, threshold = self.dtype, self.threshold

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches, 3):
                node, x = g.column(4).to_numpy(), _units(_bytes(g.column(6)), dtype)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                a, b = _spanning(near)
                yield _out(["a", "b"], node[a], node[b])

        every = self.classes.select("node", F.octet_length("v").cast("long").alias("root"))
        self.roots = cut(connected_components(self.in_blocks(every).mapInArrow(join, "a long, b long")), "roots")

    def in_blocks(self, roots: DataFrame) -> DataFrame:
        """The vectors of each root, dealt so that any two blocks of them meet: ``root``, ``i``,
        ``j``, ``b`` (the row's block), ``node``, ``n``, ``v``."""
        blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        placed = roots.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.select("root", "node", "b", pairs.alias("o")).join(self.classes, "node")
        placed = placed.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "n", "v")
        return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def links(self) -> DataFrame:
        """All links inside the components. ``node``, ``root``, ``links`` (other rows linked,
        copies counted), ``partners`` (other classes linked)."""
        roots = self.roots
        dtype, threshold = self.dtype, self.threshold

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches, 3):
                b, node, n, x = g.column(3).to_numpy(), g.column(4).to_numpy(), g.column(5).to_numpy(), _units(_bytes(g.column(6)), dtype)
                first = b == g.column(1)[0].as_py()
                one = g.column(1)[0].as_py() == g.column(2)[0].as_py()
                for p, q in [(first, first)] if one else [(first, ~first), (~first, first)]:
                    rows, cols = np.flatnonzero(p), np.flatnonzero(q)
                    for a in range(0, len(rows), BLOCK):
                        at = rows[a : a + BLOCK]
                        near = (x[at] @ x[cols].T >= threshold) & (node[at][:, None] != node[cols][None, :])
                        yield _out(["node", "links", "partners"], node[at], near @ n[cols], near.sum(1).astype(np.int64))

        counts = self.in_blocks(roots).mapInArrow(count, "node long, links long, partners long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
        return cut(roots.join(counts, "node", "left"), "links")

    def recall(self, linked: DataFrame) -> float:
        """Mean share of its links found, of sampled classes that have any; every class is
        compared with them. The sample grows until enough have links."""
        size = max(AUDIT, int(AUDIT_ROOT * self.size**0.5))
        order = self.classes.select("node", "v").orderBy(F.xxhash64("node", F.lit("audit")))
        rows: list[tuple[int, int]] = []  # node, true links
        for grown in range(AUDIT_GROWS + 1):
            done, some = len(rows), order.limit(min(size << 2 * grown, self.size)).collect()
            for at in range(done, len(some), AUDIT_BLOCK):
                rows += self._true_links([(r["node"], bytes(r["v"])) for r in some[at : at + AUDIT_BLOCK]])
            if sum(t > 0 for _, t in rows) >= AUDIT_LINKED or len(rows) >= self.size:
                break
        true = self.classes.sparkSession.createDataFrame([r for r in rows if r[1] > 0], "node long, true long")
        share = F.coalesce("partners", F.lit(0)) / F.col("true")
        return true.join(linked.select("node", "partners"), "node", "left").agg(F.coalesce(F.avg(share), F.lit(1.0))).first()[0]

    def _true_links(self, some: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        dtype, threshold = self.dtype, self.threshold
        shared = self.classes.sparkSession.sparkContext.broadcast(some)

        def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for node, v in shared.value:
                by.setdefault(len(v), []).append((node, v))
            for b in batches:
                bodies, nodes = _bytes(b.column(1)), b.column(0).to_numpy()
                sizes = np.array(list(map(len, bodies)))
                for s, queries in by.items():
                    at = np.flatnonzero(sizes == s)
                    if len(at):
                        ids = np.array([q for q, _ in queries])
                        near = (_units([v for _, v in queries], dtype) @ _units([bodies[i] for i in at], dtype).T >= threshold) & (ids[:, None] != nodes[at][None, :])
                        yield _out(["node", "true"], ids, near.sum(1).astype(np.int64))

        found = self.classes.select("node", "v").mapInArrow(true, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        return [(r["node"], r["true"]) for r in found.collect()]


def near_duplicates(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with
    nothing: no links, their own id as component, kept. Vectors of different lengths never
    link. Rows with equal vectors are linked to each other. A null id counts as a row but is
    not a component's smallest id while another is there; repeated rows count as vectors of
    their own; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(table.sparkSession)
    element = table.schema[vector_col].dataType.elementType
    dtype = np.float32 if isinstance(element, T.FloatType) else np.float64
    kind = "float" if dtype is np.float32 else "double"

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.cumsum([0, *vectors.value_lengths().to_pylist()])
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("e"))
    fine = rows.where(valid("e"))
    classes = fine.groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = cut(cut(classes, "classes").withColumn("node", F.monotonically_increasing_id()), "nodes")
    packed = cut(classes.select("node", pack("e").alias("v"), "n"), "vectors")
    descent = Descent(packed, dtype, threshold)
    lists = descent.run(descent.start(k), k)
    linked = descent.links()
    for doubled in range(DOUBLINGS + 1):
        if descent.recall(linked) >= RECALL:
            break
        if doubled < DOUBLINGS:
            k *= 2
            lists = descent.run(descent.best(lists.withColumn("new", F.lit(1)), k), k)
        else:
            descent.compare_all()
        linked = descent.links()
    named = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root")
    named = named.select("e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    done = fine.join(named, "e").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    rest = rows.where(~valid("e")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs of rows; equal results for tables small enough for that.
ORACLE_SQL = """
WITH RECURSIVE x AS (SELECT row_number() OVER () AS i, vec_id, embedding, embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 AS fine FROM embeddings),
u AS (SELECT i, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM x WHERE fine),
link AS (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.i <> b.i AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT i AS a, i AS b FROM x UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS i, min(x.vec_id) AS c FROM reach JOIN x ON x.i = reach.b GROUP BY 1),
n AS (SELECT a AS i, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM x JOIN least USING (i) LEFT JOIN n USING (i)"""
