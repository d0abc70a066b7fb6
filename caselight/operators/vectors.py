"""Vector search: encoder and exact cosine top-k; ``vector_index`` has the approximate one.

Queries stay a table. Vectors are dealt into chunks of bounded size within each combination
of filter values, queries into blocks, and every block meets only the chunks that its filters
allow; the product of a block and a chunk is cut to the best of each query where it is made.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from caselight.functions.text import TOKEN
from caselight.operators.scale import top_n_per_group
from caselight.session import kept_aside

DIMENSIONS = 384
Encoder = PipelineModel | Callable[[DataFrame], DataFrame]
#: Vectors of a chunk, queries of a block, and rows of a chunk that are multiplied at once.
CHUNK_ROWS, QUERY_BLOCK, SLICE = 16_384, 1024, 2048


def _best_first():
    return [F.desc(F.round("score", 9)), F.asc("ticket_id")]


def _stages(text: str, dimensions: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]


def fit_encoder(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """The default encoder: hashed term counts, idf weights, unit length."""
    return Pipeline(stages=_stages(text, dimensions)).fit(texts)


def fit_and_encode(texts: DataFrame, out: str = "vector", dimensions: int = DIMENSIONS) -> tuple[PipelineModel, DataFrame]:
    """``fit_encoder`` of ``texts`` and their vectors, without ``text``. The texts are read once: their
    term counts are kept, and the weights are fitted to and applied to those."""
    tokenizer, hashing, idf, unit = _stages("text", dimensions)
    counted = kept_aside(hashing.transform(tokenizer.transform(texts)).drop("text", "_tok"))
    weights = idf.fit(counted)
    rows = unit.transform(weights.transform(counted)).withColumn(out, vector_to_array("_unit", "float32"))
    return PipelineModel(stages=[tokenizer, hashing, weights, unit]), rows.drop("_tf", "_idf", "_unit")


def encode(model: Encoder, texts: DataFrame, out: str = "vector") -> DataFrame:
    """Rows with ``text`` and their vector, by a fitted pipeline or by any function that maps
    such rows to the same rows plus ``vector``."""
    if not isinstance(model, PipelineModel):
        return model(texts).withColumnRenamed("vector", out)
    return model.transform(texts).withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_tok", "_tf", "_idf", "_unit")


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _best(ids: np.ndarray, scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.flatnonzero(scores > -np.inf)
    rounded = np.round(scores[keep], 9)  # equal vectors must tie
    if len(keep) > top_k:
        kth = np.partition(rounded, len(keep) - top_k)[len(keep) - top_k]
        keep, rounded = keep[rounded >= kth], rounded[rounded >= kth]
    order = np.lexsort((ids[keep], -rounded))[:top_k]
    return ids[keep][order], scores[keep][order]


_FOUND = "query_id string, ticket_id string, score double"


def _rows(queries: list, tickets: list, scores: list) -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series(queries, dtype=object), "ticket_id": pd.Series(tickets, dtype=object),
                         "score": pd.Series(scores, dtype=float)})


def _multiply(top_k: int, filters: list[str]):
    """The best ``top_k`` vectors of a chunk for every query of a block."""
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or queries.empty:
            return _rows([], [], [])
        qm = _unit(queries["qvector"])
        held = [(np.empty(0, dtype=object), np.empty(0))] * len(queries)
        for at in range(0, len(vectors), SLICE):
            part = vectors.iloc[at : at + SLICE]
            sims = qm @ _unit(part["vector"]).T
            for f in filters:
                want, have = queries[f"_{f}"].to_numpy(dtype=object), part[f].to_numpy(dtype=object)
                sims = np.where(pd.isna(want)[:, None] | (want[:, None] == have[None, :]), sims, -np.inf)
            ids = part["ticket_id"].to_numpy(dtype=object)
            held = [_best(np.concatenate([h[0], ids]), np.concatenate([h[1], s]), top_k) for h, s in zip(held, sims)]
        names = [q for q, (ids, _) in zip(queries["query_id"], held) for _ in ids]
        return _rows(names, [i for ids, _ in held for i in ids], [x for _, scores in held for x in scores])

    return run


def cosine_top_k(
    vectors: DataFrame, queries: DataFrame, top_k: int = 10, filters: tuple[str, ...] = (),
    chunk_rows: int = CHUNK_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine top-k of every query; ``filters`` are equality columns.

    A NULL filter value matches everything. The numbers of chunks and blocks follow from the
    tables within the plan; nothing comes to the driver. Vectors are repeated once per block
    of queries, queries once per chunk that they may match.
    """
    names = list(filters)
    v = vectors.select("ticket_id", "vector", *names)
    q = queries.select("query_id", F.col("vector").alias("qvector"), *[F.col(f).alias(f"_{f}") for f in names])

    # chunks are numbered group by group; the window runs over a row per combination of filters
    chunks = F.ceil(F.count("*") / chunk_rows).cast("long").alias("n_chunks")
    sizes = v.groupBy(*names).agg(chunks) if names else v.agg(chunks).where("n_chunks > 0")
    group = F.xxhash64(F.lit(0), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in names])
    before = F.sum("n_chunks").over(Window.orderBy("g", *names)) - F.col("n_chunks")
    sizes = sizes.withColumn("g", group).withColumn("first", before)
    n_blocks = q.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / query_block)).cast("int")).scalar()
    n_parts = sizes.agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).scalar()

    own = F.col("first") + F.pmod(F.xxhash64("ticket_id"), "n_chunks")
    held = sizes.select("first", "n_chunks", *[F.col(f).alias(f"_{f}") for f in names])
    cond = F.lit(True)
    for f in names:
        cond = cond & F.col(f).eqNullSafe(F.col(f"_{f}"))
    v = v.join(held, cond) if names else v.withColumns({"first": F.lit(0), "n_chunks": n_parts})
    v = v.select("ticket_id", "vector", *names, own.alias("chunk"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))

    # a query meets the groups that agree with its filters, one kind of missing filters at a time
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), n_blocks).cast("int"))
    asked = None
    for given in product((True, False), repeat=len(names)):
        kind = q
        for f, g in zip(names, given):
            kind = kind.filter(F.col(f"_{f}").isNotNull() if g else F.col(f"_{f}").isNull())
        keys = [f"_{f}" for f, g in zip(names, given) if g]
        if keys:
            met = kind.join(held.select(*keys, "first", "n_chunks"), keys)
            span = F.sequence(F.col("first"), F.col("first") + F.col("n_chunks") - 1)
        else:
            met, span = kind, F.when(n_parts > 0, F.sequence(F.lit(0).cast("long"), n_parts - 1))
        met = met.select(*q.columns, F.explode(span).alias("chunk"))
        asked = met if asked is None else asked.unionByName(met)
    found = v.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInPandas(
        _multiply(top_k, names), _FOUND)
    return top_n_per_group(found, ["query_id"], _best_first(), top_k)


def centroids(vectors: DataFrame, key: str, query_id: str = "query_id") -> DataFrame:
    """One mean vector per value of ``key``, built from narrow partial sums."""
    cells = vectors.select(F.col(key).alias(query_id), F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy(query_id, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(query_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector"))
