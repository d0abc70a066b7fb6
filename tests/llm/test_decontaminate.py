import random

import brute
import pytest

from caselight.llm import decontaminate

ITEMS = "item_id long, text string, chunk string"


def as_brute(df):
    import hashlib

    return {
        r["doc_id"]: (r["n_words"], len(r["hit_words"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["hit_words"]))
        for r in df.collect()
    }


@pytest.mark.parametrize(("chunk", "block"), [(4 << 20, 1 << 20), (2000, 200)])
def test_matches_brute_force(spark, documents, corpus, chunk, block):
    texts = dict(corpus)
    items = [(1, " ".join((texts[3] or "").split()[:25])), (10, texts[5]), (2, "one"), (3, None), (4, "  ...  "), (5, texts[5]), (6, "SAME same")]
    index = decontaminate.build_index(documents(corpus), chunk_bytes=chunk)
    out = decontaminate.phrase_matches(index, spark.createDataFrame([(*x, None) for x in items], ITEMS), block_bytes=block)
    assert as_brute(out) == brute.contamination(corpus, items)


def test_phrases_dont_cross_documents(spark, documents):
    rows = [(1, "a b c"), (2, "d e f"), (None, "c d"), (None, "c d"), (3, "")]
    index = decontaminate.build_index(documents(rows))
    out = decontaminate.phrase_matches(index, spark.createDataFrame([(7, "c, d", None), (None, "E F", None)], ITEMS)).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["items"]), tuple(r["hit_words"])) for r in out) == [
        (0, ("7",), (0, 1)), (0, ("7",), (0, 1)), (1, (), ()), (2, ("",), (1, 2)), (3, (), ()),
    ]


def test_proximity(spark, documents):
    rows = [(1, "x beta y alpha"), (2, "alpha a a a a a a beta"), (3, "alpha alpha"), (4, "beta"), (5, "gamma alpha beta")]
    index = decontaminate.build_index(documents(rows))
    items = spark.createDataFrame([(1, "alpha beta", None)], ITEMS)
    out = decontaminate.proximity_matches(index, items, within=3).collect()
    assert {r["doc_id"] for r in out if r["items"]} == {1, 5}


def near_brute(rows, items, within):
    """doc_id: (items, hit_words)."""
    out = {}
    for i, text in rows:
        own, hits, names = [x.lower() for x in (text or "").split()], set(), set()
        for name, item in items:
            wanted = set((item or "").lower().split())
            for p, x in enumerate(own):
                if x in wanted and wanted <= set(own[max(0, p - within) : p + within + 1]):
                    hits.add(p)
                    names.add(str(name))
        out[i] = (sorted(names), sorted(hits))
    return out


@pytest.mark.parametrize("crowd", ["a", "b", "c"])
@pytest.mark.parametrize("chunk", [1, 4 << 20])
def test_proximity_doesnt_depend_on_the_chunk(spark, documents, chunk, crowd):
    words = [f"x{k}" for k in range(60)]
    words[0], words[25], words[50] = "a", "b", "c"
    others = sorted({"a", "b", "c"} - {crowd})
    rows = [(1, " ".join(words)), (2, " ".join(others * 20)), (3, f"{crowd} {others[0]}"), (4, "c y b"), (5, "y y a")]
    items = [(1, "a b c", None)]
    index = decontaminate.build_index(documents(rows).coalesce(1), chunk_bytes=chunk)
    out = decontaminate.proximity_matches(index, spark.createDataFrame(items, ITEMS), within=30).collect()
    assert {r["doc_id"]: (r["items"], r["hit_words"]) for r in out} == {1: (["1"], [25]), 2: ([], []), 3: ([], []), 4: ([], []), 5: ([], [])}


@pytest.mark.parametrize(("chunk", "block"), [(4 << 20, 1 << 20), (700, 1 << 20), (1, 30)])
def test_proximity_matches_brute_force(spark, documents, chunk, block, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=n))
    rows = [(i, text(rnd.choice([0, 1, 5, 60]))) for i in range(60)] + [(60, None), (61, text(400))]
    items = [(k, text(rnd.choice([1, 2, 3, 4, 5]))) for k in range(40)] + [(40, None), (41, "w0 none")]
    monkeypatch.setattr(decontaminate._near, "__defaults__", (200,))  # several slabs and steps
    index = decontaminate.build_index(documents(rows), chunk_bytes=chunk)
    for within in (0, 2, 6):
        out = decontaminate.proximity_matches(index, spark.createDataFrame([(*x, None) for x in items], ITEMS), within=within, block_bytes=block)
        got = {r["doc_id"]: (r["items"], r["hit_words"]) for r in out.collect()}
        want = near_brute(rows, items, within)
        assert {i: (sorted(a), b) for i, (a, b) in got.items()} == want


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], ITEMS)
    index = decontaminate.build_index(documents([(1, "a b")]))
    assert [r["n_words"] for r in decontaminate.phrase_matches(index, items).collect()] == [2]
    none = decontaminate.build_index(documents([(1, "a")]).limit(0))
    assert decontaminate.phrase_matches(none, spark.createDataFrame([(1, "a", None)], ITEMS)).collect() == []
