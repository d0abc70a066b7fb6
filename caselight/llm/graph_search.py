"""Approximate nearest neighbours by largest inner product, through sharded proximity graphs.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard becomes a directed
graph over its distinct vectors: every vector searches the graph so far greedily, what the search
visits proposes its neighbours, and a neighbour stays only if no kept one is closer to it by the
factor ``ALPHA`` (relaxed pruning keeps short and long edges); edges also go back. A query walks
every shard's graph with a beam; the shards' best, scored on the original vectors, are merged.

The graph needs a metric. One more coordinate, the root of what a vector's squared length lacks
of the largest, makes the nearest vector that of the largest inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.operators.scale import top_n_per_group

from ..session import shared_dir
from .shared import kept_aside

#: Vectors of a shard, and queries that meet a shard's graph in one task.
SHARD_ROWS, PART_QUERIES = 8192, 32_768
#: Edges of a node, candidates kept while building and while searching.
DEGREE, BUILD_BEAM, SEARCH_BEAM = 32, 48, 96
ALPHA = 1.2
#: Points that are inserted or queries that are walked together.
TOGETHER = 1024
#: Extra entry points beside the most central vector.
ENTRIES = 8
INDEX = "shard int, ids binary, owners binary, vectors binary, edges binary, entries binary, width int, longest double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite entry, not zero."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _metric(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of them as long as the longest, in single
    precision: distances only steer the walk."""
    x = x / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


class _Graph:
    """Points, their squared lengths, and edges (-1: none); ``entries`` is where walks begin."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.points, self.edges, self.entries = points, edges, entries
        self.lengths = np.einsum("ij,ij->i", points, points)

    def distances(self, queries: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Squared distances, but for the query's own length, of each query to its row of nodes."""
        return self.lengths[to] - 2 * np.einsum("qd,qkd->qk", queries, self.points[to])

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of the ``beam`` nearest found per query, nearest first; -1 and
        infinity fill up. Each round expands the nearest node that wasn't expanded yet."""
        n, q = len(self.points), len(queries)
        seen = np.zeros((q, n), bool)
        nodes = np.full((q, beam), -1, np.int64)
        far = np.full((q, beam), np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        start = np.tile(self.entries[:beam], (q, 1))
        seen[:, self.entries[:beam]] = True
        k = start.shape[1]
        nodes[:, :k], far[:, :k], open_[:, :k] = start, self.distances(queries, start), True
        going = np.arange(q)
        while len(going):
            best = np.where(open_[going], far[going], np.inf)
            at = best.argmin(axis=1)
            more = np.isfinite(best[np.arange(len(going)), at])
            going, at = going[more], at[more]
            if not len(going):
                break
            open_[going, at] = False
            near = self.edges[nodes[going, at]]
            fresh = near >= 0
            near = np.where(fresh, near, 0)
            fresh &= ~seen[going[:, None], near]
            row, column = np.nonzero(fresh)
            seen[going[row], near[row, column]] = True
            d = np.where(fresh, self.distances(queries[going], near), np.inf)
            all_d = np.concatenate([far[going], d], axis=1)
            pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            line = np.arange(len(going))[:, None]
            nodes[going] = np.concatenate([nodes[going], np.where(fresh, near, -1)], axis=1)[line, pick]
            open_[going] = np.concatenate([open_[going], fresh], axis=1)[line, pick]
            far[going] = all_d[line, pick]
        order = np.argsort(far, axis=1, kind="stable")
        line = np.arange(q)[:, None]
        far = far[line, order]
        return np.where(np.isfinite(far), nodes[line, order], -1), far

    def prune(self, owners: np.ndarray, candidates: np.ndarray, alpha: float) -> None:
        """New edges of ``owners`` from their rows of candidates (-1: none): the nearest stays and
        removes those that are closer to it, by the factor, than to the owner; and so on."""
        degree = self.edges.shape[1]
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        there = (candidates >= 0) & (candidates != owners[:, None])
        nodes = np.where(there, candidates, 0)
        vectors = self.points[nodes]
        own = np.where(there, self.distances(self.points[owners], nodes) + self.lengths[owners][:, None], np.inf)
        kept = np.full((len(owners), degree), -1, np.int64)
        line = np.arange(len(owners))
        for k in range(degree):
            at = own.argmin(axis=1)
            alive = np.isfinite(own[line, at])
            if not alive.any():
                break
            kept[alive, k] = nodes[line, at][alive]
            chosen = vectors[line, at]
            between = self.lengths[nodes] + self.lengths[nodes[line, at]][:, None] - 2 * np.einsum("qd,qkd->qk", chosen, vectors)
            own[alpha * alpha * np.maximum(between, 0) <= own] = np.inf
            own[line, at] = np.inf
        self.edges[owners] = kept

    def connect_back(self, owners: np.ndarray, alpha: float) -> None:
        """The reverse of every edge of ``owners``; nodes with too many are pruned."""
        degree = self.edges.shape[1]
        source = np.repeat(owners, degree)
        target = self.edges[owners].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, n = np.unique(target, return_index=True, return_counts=True)
        while len(heads):  # a popular node takes its new edges in portions
            portion = np.minimum(n, degree)
            width = int(portion.max())
            place = np.arange(width)
            inside = place < portion[:, None]
            new = np.where(inside, source[np.minimum(first[:, None] + place, len(source) - 1)], -1)
            both = np.concatenate([self.edges[heads], new], axis=1)
            ranked = np.sort(both, axis=1)[:, ::-1]
            ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
            ranked = np.sort(ranked, axis=1)[:, ::-1]
            fits = (ranked >= 0).sum(axis=1) <= degree
            if fits.any():
                short = ranked[fits][:, :degree]
                self.edges[heads[fits], : short.shape[1]] = short
                self.edges[heads[fits], short.shape[1] :] = -1
            if not fits.all():
                self.prune(heads[~fits], both[~fits], alpha)
            first, n = first + portion, n - portion
            more = n > 0
            heads, first, n = heads[more], first[more], n[more]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> _Graph:
    """A robust-pruned graph over all points, inserted in growing groups in random order."""
    n = len(points)
    random = np.random.default_rng(seed)
    order = random.permutation(n)
    middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
    order = np.concatenate([[middle], order[order != middle]]) if n else order
    graph = _Graph(points, np.full((n, degree), -1, np.int64), np.array([middle] if n else [], np.int64))
    done = min(n, beam)
    first = order[:done]
    if done:
        graph.prune(first, np.tile(first, (done, 1)), alpha)
        graph.connect_back(first, alpha)
    while done < n:
        group = order[done : done + min(TOGETHER, done)]
        near, _ = graph.walk(points[group], beam)
        graph.prune(group, near, alpha)
        graph.connect_back(group, alpha)
        done += len(group)
    # a second pass over the whole graph mends early points, which chose among few
    for a in range(0, n if n > beam else 0, TOGETHER):
        group = order[a : a + TOGETHER]
        near, _ = graph.walk(points[group], beam)
        graph.prune(group, np.concatenate([near, graph.edges[group]], axis=1), alpha)
        graph.connect_back(group, alpha)
    graph.entries = np.unique(np.concatenate([[middle], order[:ENTRIES]])).astype(np.int64) if n else graph.entries
    return graph


def _build(longest: float, degree: int, beam: int, alpha: float):
    def run(key, table):
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        raw = table["c"].combine_chunks()
        width = len(raw.flatten()) // len(raw)
        x = raw.flatten().to_numpy().reshape(len(raw), width)[order]
        nodes, owners = np.unique(x, axis=0, return_inverse=True)  # equal vectors are one node
        graph = build_graph(_metric(nodes, longest), degree, beam, alpha)
        # ids in the order of their nodes, smallest first
        by_node = np.argsort(owners.ravel(), kind="stable")
        values = [
            key[0].as_py(), ids[by_node].astype(np.int64).tobytes(), owners.ravel()[by_node].astype(np.int64).tobytes(),
            nodes.tobytes(), graph.edges.astype(np.int32).tobytes(), graph.entries.tobytes(), width, longest,
        ]
        kinds = (pa.int32(), *[pa.binary()] * 5, pa.int32(), pa.float64())
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

    return run


def vectors_of(rows: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, c): the vectors that take part, one per id, as doubles, written aside.

    They are those of the most frequent width (of equally frequent ones the largest); of rows
    that repeat an id the smallest vector counts; rows without an id take no part.
    """
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("c"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("c")))
    sizes = own.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    own = own.where(F.size("c") == (sizes["width"] if sizes else 0))
    return kept_aside(own.groupBy("id").agg(F.min("c").alias("c")))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """The stored graphs of ``vectors`` (id, c), a row per shard; every row is in one."""
    square = F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).first()
    shards = max(1, math.ceil(facts["n"] / shard_rows))
    dealt = vectors.select("id", "c", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    longest = math.sqrt(facts["square"] or 1.0) * (1 + 1e-12)
    path = shared_dir(vectors.sparkSession, "vector-graphs")
    dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_build(longest, degree, beam, alpha), INDEX).write.parquet(path)
    return vectors.sparkSession.read.schema(INDEX).parquet(path)


class _Shard:
    """A shard's graph, vectors and ids, read from its row."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        owners = np.frombuffer(row["owners"], np.int64)
        self.first = np.searchsorted(owners, np.arange(len(self.x) + 1))
        edges = np.frombuffer(row["edges"], np.int32).reshape(len(self.x), -1).astype(np.int64)
        self.graph = _Graph(_metric(self.x, row["longest"]), edges, np.frombuffer(row["entries"], np.int64))

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of at most k nearest ids of each query, its own left out."""
        beam = max(beam, k + 1)
        if len(self.x) <= beam:
            nodes = np.tile(np.arange(len(self.x)), (len(queries), 1))
        else:
            length = np.sqrt((queries * queries).sum(axis=1))[:, None]
            aimed = np.concatenate([queries / length, np.zeros_like(length)], axis=1).astype(np.float32)
            nodes, _ = self.graph.walk(aimed, beam)
        score = np.where(nodes >= 0, (queries[:, None, :] * self.x[np.maximum(nodes, 0)]).sum(axis=2), -np.inf)
        # the k + 1 smallest ids of each node are enough
        n = np.where(nodes >= 0, np.minimum(self.first[nodes + 1] - self.first[nodes], k + 1), 0)
        row, column = np.nonzero(n)
        times = n[row, column]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[nodes[row, column]], times)
        row, value, found = np.repeat(row, times), np.repeat(score[row, column], times), self.ids[at]
        other = found != ids[row]
        row, value, found = row[other], value[other], found[other]
        order = np.lexsort((found, -value, row))
        row, value, found = row[order], value[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return ids[row[place < k]], found[place < k], value[place < k]


def _search(k: int, beam: int):
    names = ("query_id", "vec_id", "score")

    def run(key, graphs, queries):
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if graphs.num_rows and queries.num_rows:
            shard = _Shard(graphs.to_pylist()[0])
            ids = queries["query_id"].to_numpy()
            x = queries["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            for a in range(0, len(ids), TOGETHER):
                parts.append(shard.best(ids[a : a + TOGETHER], x[a : a + TOGETHER], k, beam))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query (id, c) in all
    shards, by falling inner product, ties by vec_id; a vector of the query's own id is left out.

    Each shard's graph meets the queries in parts of about ``part_queries``. A shard of no more
    distinct vectors than the beam is compared whole, so few vectors give all candidates.
    """
    parts = max(1, math.ceil(queries.count() / part_queries))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col("id").alias("query_id"), F.col("c").alias("q"), part.alias("part"), each(shards).alias("shard"))
    graphs = index.select("*", each(parts).alias("part"))
    both = graphs.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part"))
    found = both.applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    return top_n_per_group(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
