"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents that the labels call good; all documents of the corpus are the
unlabelled set. For a linear score and the squared loss (1 - z)^2 / 4 the risks of both sets are
quadratic, so one distributed pass that sums features and their products says all that training
needs: every text of the corpus takes part, and only two small matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_features import N_FEATURES, features
from .shared import all_columns, without

#: At most this many trusted documents (those with the smallest hash of their id).
TRUSTED = 20_000
_SUMS = "part int, sums binary"
_PARTS = 32


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sum_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for the unlabelled and the trusted texts, the sum of outer products (the
    constant feature makes its first row the count and the sums)."""
    total = np.zeros((2, N_FEATURES, N_FEATURES))
    for batch in batches:
        texts, trusted = batch["text"].to_pylist(), batch["trusted"].to_numpy(zero_copy_only=False).astype(bool)
        for at in range(0, len(texts), 2000):
            x = features(texts[at : at + 2000])
            total[0] += x.T @ x
            x = x[trusted[at : at + 2000]]
            total[1] += x.T @ x
    part = TaskContext.get().partitionId() % _PARTS
    yield pa.record_batch({"part": pa.array([part], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table["sums"].to_pylist())
    return pa.table({"part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, penalty: float, steps: int, rate: float) -> np.ndarray:
    """Weights of least prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) + penalty * |w|^2.

    ``positive`` and ``unlabelled`` are mean outer products with the constant feature first. The
    descent is preconditioned by the curvature of the unlabelled risk. While the estimate of the
    negatives' risk is below zero, which no real risk is, steps lift that estimate instead of
    lowering the whole, so the positives can't be overfitted.
    """
    m_p, m_u = positive[0], unlabelled[0]
    curvature = unlabelled / 2 + 2 * penalty * np.eye(len(m_u))
    solve = np.linalg.inv(curvature)
    risk = lambda w, m, second, sign: (1 - 2 * sign * w @ m + w @ second @ w) / 4
    best, least, w = np.zeros(len(m_u)), np.inf, np.zeros(len(m_u))
    for _ in range(steps):
        negative = risk(w, m_u, unlabelled, -1) - prior * risk(w, m_p, positive, -1)
        value = prior * risk(w, m_p, positive, 1) + max(0.0, negative) + penalty * w @ w
        if negative >= 0 and value < least:
            best, least = w, value
        if negative >= 0:
            w = w + rate * (solve @ (prior * m_p - m_u / 2) - w)
        else:
            w = w + rate * solve @ ((m_u + unlabelled @ w) - prior * (m_p + positive @ w)) / 2
    return best


def fit(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None,
    trusted: int = TRUSTED, penalty: float = 1e-4, steps: int = 400, rate: float = 0.1,
) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Only label rows where ``learn_from`` (a condition on doc_id) holds are read. Trusted are
    documents whose labels are all 1, at most ``trusted`` of them, chosen by a hash; the class
    prior is the share of good documents among all labelled ones that may be learnt from.
    Labels of null documents or with null quality don't count. Without any trusted document the
    model scores every text 0.5.
    """
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    if learn_from is not None:
        usable = usable.where(learn_from)
    good = usable.groupBy("doc_id").agg((F.min("quality") >= 1).alias("trusted"))
    share = good.agg(F.avg(F.col("trusted").cast("int"))).first()[0]
    chosen = good.where("trusted").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)  # bounded: broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    rows = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = rows.mapInArrow(_sum_features, _SUMS).groupBy("part").applyInArrow(_add, _SUMS)
    total = np.zeros((2, N_FEATURES, N_FEATURES))
    for row in sums.orderBy("part").collect():  # at most _PARTS rows
        total += np.frombuffer(bytes(row["sums"]), np.float64).reshape(total.shape)
    n_u, n_p = total[0, 0, 0], total[1, 0, 0]
    if not n_p:
        return Model(np.zeros(N_FEATURES), 0.5)
    weights = non_negative_risk(total[1] / n_p, total[0] / n_u, share, penalty, steps, rate)
    return Model(weights, float(share))


def _scores(weights: np.ndarray):
    def run(text: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(text), 2000):
            parts.append(np.clip((features(text.slice(at, 2000).to_pylist()) @ weights + 1) / 2, 0, 1))
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return F.arrow_udf(run, "double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1, higher: good likelier) and predicted (score >=
    0.5). Null, empty and blank texts get the score of a text without properties. Columns of
    ``docs`` of these names are replaced, all others stay in the JVM; an empty table gives no
    rows."""
    docs = without(docs, ("score", "predicted"))
    rows = docs.select(*all_columns(docs), _scores(model.weights)(F.col("text").cast("binary")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their own columns only."""
    return docs.where(_scores(model.weights)(F.col("text").cast("binary")) >= 0.5)
