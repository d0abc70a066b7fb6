import brute
import numpy as np
import pytest

from caselight.llm import components, near_dedup, superminhash


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(documents, corpus, size):
    assert found(near_dedup.near_duplicates(documents(corpus), shingle=size)) == brute.near_duplicates(corpus, size)


def test_links_between_members_that_both_miss_the_smallest(documents):
    # all share buckets with document 0; 1 and 2 link with each other only
    base = [f"w{i}" for i in range(200)]
    edit = lambda *places: " ".join(f"x{p}" if p in places else w for p, w in enumerate(base))
    shared = range(0, 60, 3)
    rows = [(0, edit()), (1, edit(*shared)), (2, edit(*shared, 100)), (3, edit(150)), (4, edit(*range(1, 100, 4)))]
    rows += [(10 + k, edit(150, 151 + k)) for k in range(8)]
    assert found(near_dedup.near_duplicates(documents(rows), shingle=2)) == brute.near_duplicates(rows, 2)


def test_repeated_rows_and_ids(documents):
    text = "a b c d e f g h i j"
    rows = [(7, text), (7, text), (3, text), (7, "k l m n o p"), (9, "k l m n o p"), (None, text), (None, None), (5, None)]
    out = near_dedup.near_duplicates(documents(rows), shingle=2).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(7, 3, False), (3, 3, True), (9, 3, False), (None, None, True), (5, 5, True)}


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([(1, "a b")]).limit(0)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(1, 2**63, 80).astype(np.uint64)
    errors = []
    for _ in range(40):
        own = [np.concatenate([common, rng.integers(1, 2**63, 10).astype(np.uint64)]) for _ in range(2)]
        sig = superminhash.signatures(np.concatenate(own), np.repeat([0, 1], 90), 2, 128)
        errors.append((sig[0] == sig[1]).mean() - 0.8)
        common = rng.integers(1, 2**63, 80).astype(np.uint64)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (0.8 * 0.2 / 128) ** 0.5 * 1.1  # not above plain MinHash


def test_tiny_sets_fill_all_slots():
    sig = superminhash.signatures(np.array([5, 9, 9], np.uint64), np.array([0, 1, 2]), 4, 64)
    assert (sig[:3] != superminhash.EMPTY).all() and (sig[3] == superminhash.EMPTY).all()
    assert (sig[1] == sig[2]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    out = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {k: 1 for k in range(1, 30)} | {60: 60, 61: 60}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_shingles_are_signed_at_once(monkeypatch):
    """The memory of a task is that of a part of its batch; parts don't change the keys."""
    import pyarrow as pa
    from caselight.llm import near_dedup as nd

    texts = [" ".join(f"w{i}x{j}" for j in range(1000)).encode() for i in range(100)]
    batch = pa.record_batch({"doc_id": pa.array(range(100), pa.int64()), "text": pa.array(texts, pa.binary())})
    sizes, signed = [], nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda e, *rest: sizes.append(len(e)) or signed(e, *rest))
    out = nd._sketch(5, 128, 4)(batch)
    assert max(sizes) <= 40_000 and sum(sizes) == 100 * 996
    monkeypatch.setattr(nd, "SHINGLES", 10**9)
    assert nd._sketch(5, 128, 4)(batch).equals(out)
