import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caselight.llm import importance_resampling as ir

SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SEPARATORS.split(low) if w]
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(rows, targets, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in targets for f in plain_features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_weights_and_ranks_equal_plain_ones(spark, documents, corpus, percent):
    rows = [*corpus, (None, corpus[0][1]), (None, None), (200, "x" * 300 + " Über-STRASSE 12 a\n\nB" + " tail" * 30)]
    targets = [corpus[3][1], corpus[5][1], None, "", "one Two"]
    items = spark.createDataFrame(list(enumerate(targets)), "item_id long, text string")
    out = ir.resampled(documents(rows), items, percent=percent)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=str) == plain(rows, targets, percent)


def test_repeated_rows_and_empty_tables(spark, documents):
    text = " ".join(f"w{i}" for i in range(25))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    out = ir.resampled(documents([(7, text)] * 40 + [(8, "few words")]), items).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2]
    assert ir.resampled(documents([]), items).collect() == []
    none = ir.resampled(documents([(1, text), (2, None)]), items.limit(0)).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in sorted(none)] == [(1, 72, None), (2, 0, None)]


def test_texts_longer_than_a_block_of_words(monkeypatch):
    text = ir.collapsed(" ".join(f"W{i % 50}" for i in range(1000)).encode())
    whole = ir.features_of([b"", text, b"a b"], ir.run_pattern(), 3, 10_000)
    monkeypatch.setattr(ir, "BLOCK_WORDS", 64)
    cut = ir.features_of([b"", text, b"a b"], ir.run_pattern(), 3, 10_000)
    assert all((a == b).all() for a, b in zip(whole, cut)) and whole[2].sum() == 2997 + 3


def test_checksums_of_spans():
    random = np.random.default_rng(0)
    data = random.integers(0, 256, 5000).astype(np.uint8)
    start = random.integers(0, 4000, 300)
    end = start + random.integers(1, 300, 300)
    assert ir.crc32_of(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_ranks_among_equal_scores(spark):
    rows = spark.createDataFrame([(i, 30, 5 if i % 3 else 9) for i in range(300)], "doc_id long, n_words long, score long")
    ranks = {r["doc_id"]: r["rank"] for r in ir.ranked(rows, percent=50, ranges=8).collect() if r["rank"]}
    want = sorted(range(300), key=lambda i: (i % 3 > 0, i))[:150]
    assert ranks == {i: k + 1 for k, i in enumerate(want)}


def test_drawn_documents(spark, documents):
    docs = documents([(i, f"text {i} " + "word " * 30) for i in range(40)])
    ranks = spark.createDataFrame([(3, 1), (5, 2), (6, None)], "doc_id long, rank long")
    out = ir.drawn_documents(docs, ranks)
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 5] and out.columns == docs.columns
