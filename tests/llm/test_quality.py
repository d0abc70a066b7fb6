import math
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from caselight.llm import licenses, quality_classifier, quality_rules

GOOD = "the quick brown fox jumps over the lazy dog and runs home to its den by the old mill near a river"


def labelled(n=240):
    """Clean texts, and texts strewn with symbols."""
    rows = []
    for i in range(n):
        words = (GOOD + f" word{i % 17} again{i % 5}").split()
        words = words[i % 7 :] + words[: i % 7]
        bad = i % 6 == 0
        rows.append((i, " ".join(f"{w}{'$&#%'[k % 4] * 3}" for k, w in enumerate(words)) if bad else " ".join(words) + ".", 0 if bad else 1))
    return rows


def test_classifier_on_held_out_rows(spark, documents):
    rows = labelled()
    docs = documents([(i, t) for i, t, _ in rows] + [(None, GOOD), (None, None), (900, ""), (901, GOOD * 300), (5, rows[5][1])])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(i, q) for i, _, q in rows if i % 12 == 0] + [(None, 1), (3, None)], "doc_id long, quality int")
    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.fit(docs, labels, learn_from=~held)
    out = quality_classifier.scored(docs, model).withColumn("held", held).collect()
    assert len(out) == docs.count() and out[0].asDict().keys() >= {"text", "lang", "label", "predicted"}
    truth = {i: q for i, _, q in rows}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    tested = [r for r in out if r["held"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)


def test_classifier_without_labels(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    model = quality_classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.scored(docs, model).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), model).collect() == []


def test_risk_estimate_stays_non_negative():
    import numpy as np

    rng = np.random.default_rng(0)
    x = lambda m, n: np.concatenate([np.ones((n, 1)), rng.normal(m, 1, (n, 30))], axis=1)
    positive, unlabelled = x(0.5, 200), np.concatenate([x(0.5, 700), x(-0.5, 300)])
    p, u = positive.T @ positive / 200, unlabelled.T @ unlabelled / 1000
    w = quality_classifier.non_negative_risk(p, u, 0.7, 1e-4, 400, 0.1)
    negative = (1 + 2 * w @ u[0] + w @ u @ w) / 4 - 0.7 * (1 + 2 * w @ p[0] + w @ p @ w) / 4
    assert negative > -0.01
    fresh = np.concatenate([x(0.5, 500), x(-0.5, 500)])
    assert ((fresh @ w > 0) == np.repeat([True, False], 500)).mean() > 0.9


def test_base_counts(documents, corpus):
    extra = [(200, "a b c d e f g h a b c d e f g h"), (201, "x\nx\n\n\ny\n x"), (202, "#$ |a|é <&>"), (203, " ".join(["z"] * 30))]
    rows = corpus + extra
    docs = documents(rows)
    out = docs.select("doc_id", quality_rules.counts(F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == {i: brute.base_counts(t) for i, t in rows}


def test_judged(spark, documents):
    rows = labelled()
    docs = documents([(i, t) for i, t, _ in rows] + [(None, GOOD), (900, None), (901, "few words"), (902, GOOD + " " + GOOD)])
    trusted = quality_rules.trusted_ids(spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 or q == 0], "doc_id long, quality int"))
    out = quality_rules.judged(docs, trusted).collect()
    assert len(out) == len(rows) + 4
    truth = {i: q for i, _, q in rows}
    for r in out:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= quality_rules.THRESHOLD)
        if r["doc_id"] in truth:
            assert r["kept"] == bool(truth[r["doc_id"]])
    assert {r["doc_id"]: r["kept"] for r in out if r["doc_id"] not in truth} == {None: True, 900: False, 901: False, 902: False}
    assert quality_rules.judged(docs.limit(0), trusted).collect() == []


def test_likelihood_weights_match_brute_force(spark, documents):
    import math

    texts = [(1, "a b a"), (2, "a c"), (3, "d d d")]
    n = 64
    grams = documents(texts).select("doc_id", quality_rules.ngram_buckets(F.col("text"), n).alias("g")).collect()
    assert sorted(len(r["g"]) for r in grams) == [3, 5, 5]
    raw, target = [0] * n, [0] * n
    for r in grams:
        for g in r["g"]:
            raw[g] += 1
            target[g] += r["doc_id"] < 3
    f, k = sum(target) / sum(raw), quality_rules.PRIOR
    out = quality_rules.log_ratios(documents(texts), spark.createDataFrame([(1,), (2,), (2,)], "doc_id long"), n).collect()
    assert {r["bucket"]: r["weight"] for r in out} == pytest.approx({b: math.log((target[b] + k * f) / (f * (raw[b] + k))) for b in range(n)})


def test_every_trusted_document_counts(spark):
    """However many there are, and without a broadcast of their ids."""
    n = 20_500
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b").otherwise("c").alias("text"))
    trusted = quality_rules.trusted_ids(docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("quality")))
    assert trusted.count() == n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights = quality_rules.log_ratios(docs, trusted, 64)
        assert "BroadcastHashJoin" not in weights._jdf.queryExecution().executedPlan().toString()
        got = {r["bucket"]: r["weight"] for r in weights.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (a,) = spark.createDataFrame([("a",)], "t string").select(quality_rules.ngram_buckets(F.col("t"), 64)[0]).first()
    share, k = 3 / 4, quality_rules.PRIOR
    raw = n * sum(x == a for x in spark.createDataFrame([("a b",)], "t string").select(quality_rules.ngram_buckets(F.col("t"), 64)).first()[0])
    assert got[a] == pytest.approx(math.log((raw + k * share) / (share * (raw + k))))


MIT = "\n\n".join(licenses.SENTENCES[x] for x in ("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liable"))
BSD3 = " ".join(licenses.SENTENCES[x] for x in ("bsd-head", "bsd-source", "bsd-binary", "bsd-name"))
BSD2 = " ".join(licenses.SENTENCES[x] for x in ("bsd-head", "bsd-source", "bsd-binary"))


@pytest.mark.parametrize(("text", "expected"), [
    (MIT, ["MIT"]), (MIT.upper(), ["MIT"]), (MIT.replace(" ", "\n"), ["MIT"]), (BSD3, ["BSD-3-Clause"]), (BSD2, ["BSD-2-Clause"]),
    ("some | words\nReleased under the MIT License.\nmore", ["MIT"]),
    ("Text. Licensed under CC BY-NC 4.0. Then\nAll rights reserved.", ["CC-BY-NC-4.0", "proprietary"]),
    (licenses.SENTENCES["bsd-source"], []), ("Licensed under the moon.", []), ("Released under the MIT Licenses.", []),
    ("", []), (None, []), ("x " * 5000 + ".\nReleased under the MIT License.", ["MIT"]),
])
def test_license_rules(documents, text, expected):
    out = licenses.scanned(documents([(None, text), (None, text)])).collect()
    assert [r["licenses"] for r in out] == [expected] * 2
    assert len(out[0]["matches"]) == len(expected)


def test_normal_forms_agree(documents):
    rows = [(k, s) for k, s in enumerate(licenses.SENTENCES.values())]
    out = documents(rows).select("text", licenses.normal_form(F.col("text")).alias("n")).collect()
    assert all(r["n"] == licenses.normal(r["text"]) for r in out)
    assert licenses.scanned(documents(rows).limit(0)).collect() == []


def test_every_known_sentence_and_rule_is_found(documents):
    """Also those with the end of a sentence inside, as GPL and MPL headers have."""
    names = list(licenses.SENTENCES)
    rows = [(k, licenses.SENTENCES[x]) for k, x in enumerate(names)]
    rows += [(100 + k, f"Some text\n# {licenses.SENTENCES[x]}\nMore text.") for k, x in enumerate(names)]
    rows += [(200 + k, "\n\n".join(licenses.SENTENCES[x] for x in run)) for k, (_, run) in enumerate(licenses.RULES)]
    out = {r["doc_id"]: r for r in licenses.scanned(documents(rows)).collect()}
    for k, x in enumerate(names):
        assert out[k]["sentence_ids"] == [x]
        if licenses.SENTENCES[x][-1] in ".;:":
            assert out[100 + k]["sentence_ids"] == [x]
    for k, (name, run) in enumerate(licenses.RULES):
        r = out[200 + k]
        assert (r["sentence_ids"], r["licenses"], len(r["matches"])) == (run, [name], 1)


GPL3 = """# Copyright (C) 2020 Somebody
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
MPL2 = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
FREE = licenses.SENTENCES["gpl-free"]


@pytest.mark.parametrize(("text", "found", "expected"), [
    (GPL3, ["gpl-free", "gpl-hope", "gpl-merchant", "gpl-see"], ["GPL-3.0-or-later"]), (MPL2, ["mpl-head"], ["MPL-2.0"]),
    (FREE.replace(": ", "; "), ["gpl-free"], ["GPL-3.0-or-later"]), (FREE.replace(":", ","), ["gpl-free"], ["GPL-3.0-or-later"]),
    (FREE.replace(": ", ":\n# --\n\n "), ["gpl-free"], ["GPL-3.0-or-later"]), (FREE + " " + MPL2, ["gpl-free", "mpl-head"], ["GPL-3.0-or-later", "MPL-2.0"]),
    (FREE.replace(": ", ": or so they say. "), [], []), (FREE.split(": ")[1], [], []), (FREE.split(": ")[0] + ".", [], []),
    ("This license is at version v. 2.0. All rights reserved.", ["reserved"], ["proprietary"]),
])
def test_sentences_of_several_parts(documents, text, found, expected):
    (r,) = licenses.scanned(documents([(1, text)])).collect()
    assert (r["sentence_ids"], r["licenses"]) == (found, expected)
