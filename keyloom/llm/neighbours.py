"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors become one node; it keeps the vec_ids that can be among a query's nearest (the k + 1 smallest). Nodes are
dealt to shards of about SHARD nodes. In each shard a graph is built: nodes are inserted in batches that double, a greedy
beam search proposes neighbours, relaxed distance pruning keeps those that no kept one is nearer to by ALPHA, and edges
are also added backwards and pruned again. Shard, vectors and graph are stored in the shared folder. Queries come in
blocks; each block is searched by beam in each shard, and the shards' best are merged. A task holds one shard; the blocks
of queries stream past it. Scores are exact cosines of the
original vectors in double precision.

Defined cases: rows without a vec_id and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of other
lengths are searched apart; repeated rows are candidates of their own, a query leaves out one row of its own id and
vector; ties go to the smaller vec_id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import read_table, stored

SHARD = 8192
DEGREE, BEAM, ALPHA = 24, 64, 1.2
#: Nodes of a beam that a step expands together.
EXPAND = 4
#: Nodes of a shard, taken at random, from the nearest of which a search starts: far clusters are reached from them.
ENTRIES = 256
QUERY_BLOCK = 256
BATCH = 256


U = np.uint64
NONE, ONE = U(2**64 - 1), U(1)


def packed(far: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (np.maximum(far, 0).astype(np.float32).view(np.uint32).astype(U) << U(32)) | (node.astype(U) << ONE)


def unpacked(keys: np.ndarray) -> np.ndarray:
    return ((keys >> ONE) & U(2**31 - 1)).astype(np.int64)


class Graph:
    """Unit vectors and out-edges; -1 is no edge."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        self.vectors = vectors
        self.edges = np.full((len(vectors), DEGREE), -1, np.int32) if edges is None else edges
        self.entries = np.zeros(0, np.int32) if entries is None else entries

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: (nodes, squared distances), nearest first, -1 where there are none.

        A place of a beam is one number: the distance's bits, which order as distances do, the node, and whether it is done.
        """
        m, n = len(queries), len(self.vectors)
        beam = min(beam, n)
        keys = np.full((m, beam), NONE)
        starts = np.sort(packed(2 - 2 * (np.einsum("qd,ed->qe", queries, self.vectors[self.entries])), self.entries[None]), axis=1)[:, :beam]
        keys[:, : starts.shape[1]] = starts
        stamp = np.full((m, n), -1, np.int16)  # the column that a node was met in
        stamp[:, self.entries] = 0
        going = np.arange(m)
        while True:
            now = keys[going]
            open_ = (now & ONE) == 0
            some = open_.any(1)
            going, now, open_ = going[some], now[some], open_[some]
            if not len(going):
                break
            at = np.argsort(~open_, axis=1, kind="stable")[:, :EXPAND]
            chosen = np.take_along_axis(now, at, 1)
            np.put_along_axis(now, at, chosen | ONE, 1)
            closed = (chosen & ONE) == 1
            near = self.edges[np.where(closed, 0, unpacked(chosen))]
            near[closed] = -1
            near = near.reshape(len(going), -1)
            row, column = np.nonzero((near >= 0) & (stamp[going[:, None], near] < 0))
            node = near[row, column]
            stamp[going[row], node] = column
            once = stamp[going[row], node] == column  # several of the nodes may lead to it
            row, column, node = row[once], column[once], node[once]
            gap = 2 - 2 * np.einsum("nd,nd->n", self.vectors[node], queries[going[row]])
            new = np.full(near.shape, NONE)
            new[row, column] = packed(gap, node)
            keys[going] = np.sort(np.concatenate([now, new], 1), axis=1)[:, :beam]
        there = keys != NONE
        far = np.where(there, (keys >> U(32)).astype(np.uint32), 0).astype(np.uint32).view(np.float32)
        return np.where(there, unpacked(keys), -1).astype(np.int32), np.where(there, far, np.inf)

    def prune(self, points: np.ndarray, near: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """Robust pruning of the candidates near (-1: none) of each point: out-edges, nearest kept first."""
        near = np.where(near == points[:, None], -1, near)
        ordered = np.sort(near, axis=1)
        again = np.zeros(near.shape, bool)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        near = np.where(again, -1, ordered)
        far = 2 - 2 * np.einsum("pcd,pd->pc", self.vectors[near], self.vectors[points])
        far[near < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        vectors = self.vectors[near]
        alive = np.isfinite(far)
        row = np.arange(len(points))
        out = np.full((len(points), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            best = alive.argmax(1)
            out[some, k] = near[row, best][some]
            between = 2 - 2 * np.einsum("pcd,pd->pc", vectors, vectors[row, best])
            alive &= ~((alpha * alpha) * between <= far)
            alive[row, best] = False
        return out

    def insert(self, points: np.ndarray) -> None:
        found, _ = self.search(self.vectors[points])
        self.edges[points] = self.prune(points, np.concatenate([found, self.edges[points]], 1))
        # backward edges: add where there is room, prune where there is none
        target = self.edges[points]
        source = np.repeat(points, DEGREE)[target.ravel() >= 0]
        target = target.ravel()[target.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        own, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        added = np.full((len(own), width), -1, np.int32)
        added[np.repeat(np.arange(len(own)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([self.edges[own], added], 1)
        size = (both >= 0).sum(1)
        roomy = size <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        self.edges[own[roomy]] = packed[roomy][:, :DEGREE]
        if (~roomy).any():
            self.edges[own[~roomy]] = self.prune(own[~roomy], both[~roomy])


def build(vectors: np.ndarray) -> Graph:
    """A graph over the unit vectors of a shard."""
    graph = Graph(vectors)
    order = np.random.default_rng(0).permutation(len(vectors)).astype(np.int32)
    at, step = 0, 1
    while at < len(order):
        graph.entries = order[: min(at, ENTRIES)]
        graph.insert(order[at : at + step])
        at += step
        step = min(2 * step, BATCH)
    graph.entries = order[:ENTRIES]
    return graph


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of paired rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """v, ids: distinct vectors with their k + 1 smallest ids. Ranks are cut before the shuffle, so a vector that a third
    of all rows share does no harm."""
    ranked = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


INDEX = "dim int, shard int, n int, ids array<array<long>>, vectors binary, edges binary, entries binary"
FOUND = "query_id long, vec_id long, score double, row binary, copies long"


def shard_row(dim: int, number: int, raw: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
    """A shard with its graph, by INDEX."""
    order = np.lexsort(raw.T[::-1])
    raw = raw[order]
    graph = build(unit(raw))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([dim], pa.int32()),
            pa.array([number], pa.int32()),
            pa.array([len(raw)], pa.int32()),
            pa.array([[ids[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
            pa.array([raw.tobytes()], pa.binary()),
            pa.array([graph.edges.tobytes()], pa.binary()),
            pa.array([graph.entries.tobytes()], pa.binary()),
        ],
        names=["dim", "shard", "n", "ids", "vectors", "edges", "entries"],
    )


def build_index(vectors: DataFrame, k: int, size: int | None = None) -> tuple[DataFrame, int]:
    """The stored shards of about size nodes and their number. Each shard is a task of its own."""
    nodes = stored(nodes_of(vectors, k))
    shards = max(1, -(-nodes.count() // (size or SHARD)))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, ids = None, [], []
        for batch in batches:
            dims, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]))) if len(dims) else []
            for a, b in zip(cuts, [*cuts[1:], len(dims)], strict=True):
                if now != (int(dims[a]), int(numbers[a])):
                    if now:
                        yield shard_row(*now, np.concatenate(raw), ids)
                    now, raw, ids = (int(dims[a]), int(numbers[a])), [], []
                part = batch.slice(a, b - a)
                raw.append(np.array(part.column(2).flatten()).reshape(-1, now[0]))
                ids += part.column(3).to_pylist()
        if now:
            yield shard_row(*now, np.concatenate(raw), ids)

    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("dim", "shard")
    return stored(ordered.mapInArrow(run, INDEX)), shards


def answers(graph: Graph, raw: np.ndarray, ids: list[list[int]], asked: pa.Array, k: int) -> pa.RecordBatch:
    """The k nearest in a shard of a block of queries, by FOUND; scores are exact."""
    own, copies = asked.field("id").to_pylist(), asked.field("copies").to_pylist()
    q = np.array(asked.field("v").flatten()).reshape(len(own), -1)
    found, _ = graph.search(unit(q))
    out: tuple[list, ...] = ([], [], [], [], [])
    for j, key in enumerate(own):
        here = found[j][found[j] >= 0]
        row = hashlib.md5(q[j].tobytes()).digest()
        score = cosines(raw[here], q[j][None])
        left = []
        for node, s in zip(here.tolist(), score.tolist(), strict=True):
            members = ids[node]
            if key in members and np.array_equal(raw[node], q[j]):
                members = list(members)
                members.remove(key)
            left += [(-s, x) for x in members]
        for s, x in sorted(left)[:k]:
            for column, value in zip(out, (key, x, -s, row, copies[j]), strict=True):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score", "row", "copies"]
    )


def search(index: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, k for each row of queries. Equal rows are searched once and answered each; rows of one
    id with other vectors have answers of their own.

    A shard goes to its task once; the blocks of queries stream past it."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    asked = (
        queries.groupBy("vec_id", "v")
        .agg(F.count("*").alias("copies"))
        .groupBy(F.size("v").alias("dim"), block)
        .agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("v").alias("v"), F.col("copies").alias("copies"))).alias("queries"))
        .select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "queries")
    )
    both = index.unionByName(asked, allowMissingColumns=True)
    ordered = both.repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", F.col("queries").isNotNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = graph = raw = ids = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(batch.schema.get_field_index(name))[i]
                here = get("dim").as_py(), get("shard").as_py()
                asked = get("queries")
                if asked.is_valid:
                    if now == here:
                        yield answers(graph, raw, ids, asked.values, k)
                    continue
                n, now, ids = get("n").as_py(), here, get("ids").as_py()
                raw = np.frombuffer(get("vectors").as_py(), np.float64).reshape(n, here[0])
                edges = np.frombuffer(get("edges").as_py(), np.int32).reshape(n, DEGREE)
                graph = Graph(unit(raw), edges, np.frombuffer(get("entries").as_py(), np.int32))

    found = ordered.mapInArrow(answer, FOUND)
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, size: int | None = None) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by every."""
    vectors = usable(embeddings)
    index, shards = build_index(vectors, k, size)
    return search(index, shards, vectors.where(F.col("vec_id") % every == 0), k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
