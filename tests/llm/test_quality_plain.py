"""The quality classifier beside a plain version of its features, sums, risk and scores."""

import math
import zlib

import numpy as np
import pytest

from caselight.llm import quality_classifier as qc
from caselight.llm.quality_features import N_FEATURES, features

SINGLE = "#*$%&|<>!?@^~_=+/\\{}[]();:\"'`-.,"


def plain_features(text):
    data = (text or "").encode()
    words = data.split()
    classes = 7 + len(SINGLE)
    if not words:
        return [1.0] + [0.0] * (2 * (classes + 10))
    share = [0.0] * classes
    for byte in data:
        c = chr(byte)
        if byte >= 128:
            k = 6
        elif "a" <= c <= "z":
            k = 1
        elif "A" <= c <= "Z":
            k = 2
        elif "0" <= c <= "9":
            k = 3
        elif c == "\n":
            k = 5
        elif c in " \t\v\f\r":
            k = 4
        else:
            k = 7 + SINGLE.index(c) if c in SINGLE else 0
        share[k] += 1 / len(data)
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    share += [
        len(set(words)) / n, sum(a == b for a, b in pairs) / n, 1 - len(set(lines)) / len(lines), 1 - len(set(pairs)) / max(1, n - 1),
        min(2.0, sum(map(len, words)) / n / 20), min(1.0, max(map(len, words)) / 100), math.log1p(n) / 12, math.log1p(len(lines)) / 8,
        sum(len(w) == 1 for w in words) / n, 1 / n,
    ]
    return [round(x * 4096) / 4096 for x in [1.0, *share, *map(math.sqrt, share)]]


def test_features_equal_plain_ones(corpus):
    texts = [t for _, t in corpus] + ["A\tb\r\n#!? {x}\x00é" * 3]
    got = features([None if t is None else t.encode() for t in texts])
    want = np.array([plain_features(t) for t in texts])
    assert got.shape == want.shape == (len(texts), N_FEATURES)
    assert np.abs(got - want).max() <= 1 / 4096  # a sum in another order may round to the next step
    assert (np.abs(got - want) > 0).mean() < 0.001


def plain_risk(w, positive, unlabelled, prior, penalty):
    loss = lambda x, sign: np.mean((1 - sign * (x @ w)) ** 2 / 4)
    return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1)) + penalty * w @ w


@pytest.mark.parametrize("prior", [0.2, 0.33])
def test_the_risk_is_minimal(prior):
    random = np.random.default_rng(8)
    good = random.normal(0.5, 1, (400, 5))
    bad = random.normal(-0.5, 1, (600, 5))
    one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)
    positive, unlabelled = one(good[:100]), one(np.concatenate([good[100:], bad]))
    second = lambda x: x.T @ x / len(x)
    w = qc.non_negative_risk(second(positive), second(unlabelled), prior, 1e-4, 400, 0.1)
    least = plain_risk(w, positive, unlabelled, prior, 1e-4)
    # small steps in any direction don't lower it
    for step in (1e-1, 1e-2):
        for _ in range(200):
            assert plain_risk(w + step * random.normal(size=6) / np.sqrt(6), positive, unlabelled, prior, 1e-4) >= least - 1e-5
    assert np.mean(positive @ w) > np.mean(one(bad) @ w) + 0.5


def test_a_prior_that_is_too_large_leaves_no_negative_risk_below_zero():
    random = np.random.default_rng(8)
    positive, bad = random.normal(0.5, 1, (400, 5)), random.normal(-0.5, 1, (600, 5))
    one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)
    positive, unlabelled = one(positive[:100]), one(np.concatenate([positive[100:], bad]))
    second = lambda x: x.T @ x / len(x)
    w = qc.non_negative_risk(second(positive), second(unlabelled), 0.6, 1e-4, 400, 0.1)
    loss = lambda x: np.mean((1 + x @ w) ** 2 / 4)
    assert loss(unlabelled) - 0.6 * loss(positive) >= -1e-9 and np.mean(positive @ w) > np.mean(one(bad) @ w)


def test_fit_and_scores_equal_plain_ones(spark, documents, corpus):
    docs = documents(corpus)
    labels = [(i, int(i % 3 > 0)) for i, _ in corpus if i % 2 == 0] + [(None, 1), (1, None), (4, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    model = qc.fit(docs, table, learn_from=~qc.held_out(qc.F.col("doc_id")))
    usable = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            usable.setdefault(i, []).append(q)
    trusted = {i for i, qs in usable.items() if min(qs) >= 1}
    x = {i: np.array(features([None if t is None else t.encode()]))[0] for i, t in corpus}
    second = lambda rows: sum(np.outer(r, r) for r in rows) / len(rows)
    prior = len(trusted) / len(usable)
    w = qc.non_negative_risk(second([x[i] for i in sorted(trusted)]), second([x[i] for i in sorted(x)]), prior, 1e-4, 400, 0.1)
    assert model.prior == prior and np.allclose(model.weights, w, atol=1e-6)
    for r in qc.scored(docs, model).collect():
        want = min(1.0, max(0.0, (x[r["doc_id"]] @ model.weights + 1) / 2))
        assert abs(r["score"] - want) < 1e-12 and r["predicted"] == (r["score"] >= 0.5)
