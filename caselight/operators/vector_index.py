"""Approximate cosine search: inverted lists of trained cells with residual codes.

Building: cell centres are trained by k-means on a bounded sample of unit vectors; every vector
goes to the list of its nearest centre with a code of its residual (a byte a dimension) and the
length of what the code leaves out. Lists are stored in parts of bounded size.

Searching: a query's nearest cells give, from codes alone, ``top_k`` scores that are certainly
reached. Every cell that may hold a better vector is probed next: its centre's score plus
``BOUND`` times the spread of its residuals along any direction is the bound. In the probed
lists, vectors whose code allows a better score are compared exactly. With ``bound=None`` the
cell's radius is the bound, which no vector exceeds, so that the result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselight.operators.scale import top_n_per_group
from caselight.operators.vectors import _best, _best_first, _unit, cosine_top_k
from caselight.session import kept_aside, shared_dir

#: Cells at most (else the root of the number of vectors) and vectors of the sample per cell.
MAX_CELLS, TRAIN_PER_CELL = 4096, 64
#: Vectors of a part of a list, queries of a block, cells that give the first scores.
PART_ROWS, QUERY_BLOCK, FIRST_CELLS = 4096, 1024, 4
BOUND = 3.0
_LISTS = "cell int, part int, n int, ids array<string>, codes binary, steps binary, rests binary, vectors binary"
_CELLS = "cell int, n long, parts int, radius double, spread double"


def train(vectors: DataFrame, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centres of ``cells`` cells, by k-means on the ``TRAIN_PER_CELL * cells`` vectors
    whose ids have the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("ticket_id", F.lit(seed)), "ticket_id").limit(TRAIN_PER_CELL * cells)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = sample.select(F.col("vector").cast("array<double>").alias("v")).where(norm > 0).select(
        array_to_vector(F.transform("v", lambda x: x / norm)).alias("v"))
    unit = kept_aside(unit)
    if unit.isEmpty():
        return np.zeros((1, 0))
    model = KMeans(k=cells, featuresCol="v", seed=seed, maxIter=10).fit(unit) if cells > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.array([unit.first()["v"].toArray()])
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(norms == 0, 1, norms)


def _assigned(centres: np.ndarray):
    """The cell of each vector and the length of its residual."""
    def run(batches):
        for b in batches:
            if len(b):
                unit = _unit(b["vector"])
                cell = (unit @ centres.T).argmax(axis=1)
                yield b.assign(cell=cell.astype(np.int32), residual=np.linalg.norm(unit - centres[cell], axis=1))

    return run


def _listed(centres: np.ndarray):
    """A part of a list: codes of the residuals, their step sizes, and what the codes leave out."""
    def run(key, rows):
        rows = rows.sort_values("ticket_id", kind="stable")
        unit = _unit(rows["vector"])
        rest = unit - centres[key[0]]
        step = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
        code = np.rint(rest / step[:, None]).astype(np.int8)
        left = np.linalg.norm(rest - code * step[:, None], axis=1)
        return pd.DataFrame({
            "cell": [key[0]], "part": [key[1]], "n": [len(rows)], "ids": [rows["ticket_id"].tolist()], "codes": [code.tobytes()],
            "steps": [step.tobytes()], "rests": [left.tobytes()], "vectors": [unit.tobytes()]})

    return run


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, seed: int = 42) -> str:
    """Write lists, cells and centres of ``vectors`` (ticket_id, vector); the folder."""
    spark = vectors.sparkSession
    path = path or shared_dir(spark, "vector-index")
    rows = vectors.select("ticket_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("ticket_id is not null and vector is not null")
    n = rows.count()
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(n)))
    centres = train(rows, cells, seed)
    placed = rows.mapInPandas(_assigned(centres), "ticket_id string, vector array<double>, cell int, residual double")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    width = max(1, centres.shape[1])
    placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.max("residual").alias("radius"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual")) / width).alias("spread")).write.parquet(f"{path}/cells")
    sizes = spark.read.schema(_CELLS).parquet(f"{path}/cells")
    part = F.pmod(F.xxhash64("ticket_id"), "parts").cast("int").alias("part")
    dealt = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", part, "ticket_id", "vector")  # a row per cell
    dealt.groupBy("cell", "part").applyInPandas(_listed(centres), _LISTS).write.parquet(f"{path}/lists")
    numbered = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(numbered, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return path


def _cells_of(spark: SparkSession, path: str):
    """Non-empty cells: numbers, centres, radius and spread; a row per cell."""
    rows = spark.read.schema(_CELLS).parquet(f"{path}/cells").join(spark.read.parquet(f"{path}/centres"), "cell").orderBy("cell").collect()
    take = lambda name: np.array([r[name] for r in rows])
    return take("cell"), np.array([r["centre"] for r in rows]), take("radius"), take("spread"), take("n"), take("parts")


def _first_probes(cells: np.ndarray, centres: np.ndarray, sizes: np.ndarray, first: int, top_k: int):
    """A query's nearest cells: ``first`` of them, more until they hold ``top_k`` vectors."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-(_unit(b["q"]) @ centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            need = np.maximum(first, (held < top_k).sum(axis=1) + 1)
            at = [np.sort(cells[o[:k]]) for o, k in zip(order, need)]
            yield b.assign(cell=[a.tolist() for a in at]).explode("cell").astype({"cell": np.int32})

    return run


def _probes(cells: np.ndarray, centres: np.ndarray, slack: np.ndarray):
    """The cells that may hold something at least as good as the score already reached."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            best = _unit(b["q"]) @ centres.T + slack
            wanted = best >= b["reached"].to_numpy()[:, None] - 1e-9
            yield b.assign(cell=[cells[w].tolist() for w in wanted]).explode("cell").dropna(subset=["cell"]).astype({"cell": np.int32})

    return run


def _estimates(part: pd.Series, queries: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) scores from centre and code, and by how much they may be wrong."""
    n = part["n"]
    code = np.frombuffer(part["codes"], np.int8).reshape(n, -1)
    step, rest = np.frombuffer(part["steps"]), np.frombuffer(part["rests"])
    own = queries @ centres[part["cell"]]
    return own[:, None] + (queries @ code.T.astype(np.float64)) * step, rest


def _reached(centres: np.ndarray, top_k: int):
    def run(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names, scores = [], []
        if len(lists) and len(asked):
            estimate, rest = _estimates(lists.iloc[0], _unit(asked["q"]), centres)
            sure = -np.sort(-(estimate - rest), axis=1)[:, :top_k]
            names, scores = np.repeat(asked["query_id"].to_numpy(object), sure.shape[1]), sure.ravel()
        return pd.DataFrame({"query_id": pd.Series(names, dtype=object), "sure": pd.Series(scores, dtype=float)})

    return run


def _compared(centres: np.ndarray, top_k: int):
    def run(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names, found, scores, compared = [], [], [], []
        if len(lists) and len(asked):
            part, queries = lists.iloc[0], _unit(asked["q"])
            estimate, rest = _estimates(part, queries, centres)
            ids, x = np.array(part["ids"], object), np.frombuffer(part["vectors"]).reshape(part["n"], -1)
            maybe = estimate + rest >= asked["reached"].to_numpy()[:, None] - 1e-9
            for name, q, near in zip(asked["query_id"], queries, maybe):
                at = np.flatnonzero(near)
                own, score = _best(ids[at], x[at] @ q, top_k)
                # one row without a ticket carries the number of compared vectors
                names += [name] * (len(own) + 1)
                found += [*own, None]
                scores += [*score, 0.0]
                compared += [*[0] * len(own), len(at)]
        return pd.DataFrame({"query_id": pd.Series(names, dtype=object), "ticket_id": pd.Series(found, dtype=object),
                             "score": pd.Series(scores, dtype=float), "compared": pd.Series(compared, dtype="int64")})

    return run


def _met(lists: DataFrame, asked: DataFrame, f, schema: str) -> DataFrame:
    """``f`` on every part of a list and every block of queries that probe its cell. Parts that
    no query probes are left out before anything is moved."""
    wanted = asked.groupBy(F.col("cell").alias("met_cell")).agg(F.array_sort(F.collect_set("block")).alias("blocks"))  # a row per cell
    kept = lists.join(wanted, F.col("cell") == F.col("met_cell")).withColumn("met_block", F.explode("blocks")).drop("blocks", "met_cell")
    parts = lists.select(F.col("cell").alias("at_cell"), F.col("part").alias("at_part"))
    met = asked.select(*[F.col(c).alias(f"at_{c}" if c == "block" else f"its_{c}" if c == "cell" else c) for c in asked.columns])
    met = met.join(parts, F.col("its_cell") == F.col("at_cell"))
    return kept.groupBy("cell", "part", "met_block").cogroup(met.groupBy("at_cell", "at_part", "at_block")).applyInPandas(f, schema)


def _compare(spark: SparkSession, path: str, queries: DataFrame, top_k: int, bound: float | None, first: int) -> DataFrame:
    """(query_id, ticket_id, score) of the best of every probed part, and compared counts."""
    cells, centres, radius, spread, sizes, _ = _cells_of(spark, path)
    if not len(cells):
        return spark.createDataFrame([], "query_id string, ticket_id string, score double, compared long")
    every = np.zeros((int(cells.max()) + 1, centres.shape[1]))
    every[cells] = centres
    lists = spark.read.schema(_LISTS).parquet(f"{path}/lists")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int")
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where("q is not null")
    q = kept_aside(q.withColumn("block", F.pmod(F.xxhash64("query_id"), q.agg(blocks).scalar()).cast("int")))
    schema = "query_id string, q array<double>, block int"
    near = q.mapInPandas(_first_probes(cells, centres, sizes, first, top_k), f"{schema}, cell int")
    codes = lists.select("cell", "part", "n", "codes", "steps", "rests")
    sure = _met(codes, near, _reached(every, top_k), "query_id string, sure double")
    best = top_n_per_group(sure, ["query_id"], [F.desc("sure")], top_k)
    reached = best.groupBy("query_id").agg(F.when(F.count("*") == top_k, F.min("sure")).alias("least"))
    asked = q.join(reached, "query_id", "left").select(*q.columns, F.coalesce("least", F.lit(-2.0)).alias("reached"))
    slack = radius if bound is None else np.minimum(radius, bound * spread)
    probes = asked.mapInPandas(_probes(cells, centres, slack), f"{schema}, reached double, cell int")
    return _met(lists, probes, _compared(every, top_k), "query_id string, ticket_id string, score double, compared long")


def search(
    spark: SparkSession, path: str, queries: DataFrame, top_k: int = 10, bound: float | None = BOUND, first: int = FIRST_CELLS,
) -> DataFrame:
    """(query_id, ticket_id, score, rank): the best ``top_k`` found for every query.

    A query with a null vector has no rows; one of length zero scores 0 everywhere. Equal scores,
    to nine decimals, rank by ticket id.
    """
    found = _compare(spark, path, queries, top_k, bound, first).where("ticket_id is not null").drop("compared")
    return top_n_per_group(found, ["query_id"], _best_first(), top_k)


def quality(vectors: DataFrame, path: str, queries: DataFrame, top_k: int = 10, bound: float | None = BOUND, first: int = FIRST_CELLS) -> DataFrame:
    """Per query: vectors compared, their share of all, and recall of the exact top-k."""
    spark = vectors.sparkSession
    rows = kept_aside(_compare(spark, path, queries, top_k, bound, first))
    found = top_n_per_group(rows.where("ticket_id is not null"), ["query_id"], _best_first(), top_k)
    exact = cosine_top_k(vectors, queries, top_k).select("query_id", "ticket_id")
    hits = exact.join(found.select("query_id", "ticket_id", F.lit(1).alias("hit")), ["query_id", "ticket_id"], "left")
    recall = hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    counts = rows.groupBy("query_id").agg(F.sum("compared").alias("candidates"))
    total = vectors.agg(F.count("*")).scalar()
    return recall.join(counts, "query_id", "left").select(
        "query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        (F.coalesce("candidates", F.lit(0)) / total).alias("candidate_share"), "recall")
