import brute
import pytest

from caselight.llm import line_dedup, substring_dedup


def windows(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


@pytest.mark.parametrize(("size", "chunk"), [(20, 8 << 20), (20, 3000), (5, 3000)])
def test_windows_match_brute_force(documents, corpus, size, chunk):
    out = substring_dedup.remove_repeated_windows(documents(corpus), window=size, chunk_bytes=chunk)
    assert windows(out) == brute.repeated_windows(corpus, size)


def test_windows_of_repeated_ids_and_rows(documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (4, "x " + text), (2, None)]
    out = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_windows(documents(rows)).collect())
    # equal places in rows of one document don't remove each other; a null id comes first
    assert out == [(False, 0, 30, 0), (True, 2, 0, 0), (True, 4, 30, 30), (True, 4, 30, 30), (True, 4, 31, 30)]
    same = substring_dedup.remove_repeated_windows(documents([(4, text), (4, text)])).collect()
    assert [r["n_removed"] for r in same] == [0, 0]


def test_crowded_sketch_loses_nothing(documents, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELL_BITS", 6)  # nearly every cell collides
    monkeypatch.setattr(substring_dedup, "WINDOWS_PER_BLOCK", 500)
    monkeypatch.setattr(substring_dedup, "WINDOWS_PER_GROUP_BLOCK", 300)
    out = substring_dedup.remove_repeated_windows(documents(corpus), window=20, chunk_bytes=5000)
    assert windows(out) == brute.repeated_windows(corpus, 20)


def lines_brute(rows, **shape):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = text.encode().split(b"\n") if text is not None else []
        gone, own = [False] * len(lines), line_dedup.passages(None if text is None else text.encode(), **shape)
        for start, n, data in own:
            if data in seen:
                gone[start : start + n] = [True] * n
            seen.add(data)
        kept = None if text is None else b"\n".join(x for x, g in zip(lines, gone) if not g).decode()
        out[i] = (len(lines), len(own), sum(gone), kept)
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_passages_match_brute_force(documents, corpus, chunk):
    lined = [(i, None if t is None else t.replace(" ", "\n") if i % 2 else t) for i, t in corpus]
    out = line_dedup.remove_repeated_passages(documents(lined), chunk_bytes=chunk).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_passages"], r["n_removed_lines"], r["kept_text"]) for r in out} == lines_brute(lined)


@pytest.mark.parametrize("between", ["\n", "\n\n", "\n \t\n\r\n"])
def test_copies_go_wholly(documents, between):
    """Texts of two lines with words or more, blank lines between them or not."""
    texts = [between.join(f"line {k} of text {i}" for k in range(2 + i % 9)) for i in range(120)]
    texts += [between + texts[7] + between, "\n" * 200 + "alpha" + "\n" * 200 + "beta", between.join(f"long {k}" for k in range(500))]
    rows = [(i + 1000 * copy, t) for copy in range(2) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in line_dedup.remove_repeated_passages(documents(rows), chunk_bytes=3000).collect()}
    for i, t in enumerate(texts):
        n = t.count("\n") + 1
        assert i == 120 or (out[i]["n_removed_lines"], out[i]["kept_text"]) == (0, t)
        assert (out[1000 + i]["n_lines"], out[1000 + i]["n_removed_lines"], out[1000 + i]["kept_text"]) == (n, n, "")


@pytest.mark.parametrize("shape", [{}, {"least": 3, "most": 5}, {"window": 4, "most": 2}, {"divisor": 1}, {"divisor": 10**9}])
def test_passages_cover_every_line(shape):
    for n in range(2, 150):
        lines = [f"{n} {k}" if k * n % 7 % 3 else " " * (k % 2) for k in range(n)]
        text = "\n".join(lines).encode()
        found = line_dedup.passages(text, **shape)
        if sum(bool(x.strip()) for x in lines) > 1:
            assert {k for start, many, _ in found for k in range(start, start + many)} == set(range(n))
        for start, many, data in found:
            assert b"\n".join(text.split(b"\n")[start : start + many]).strip() == data.strip()


def test_blank_lines_shift_no_passage(documents):
    lines = [f"line {k}" for k in range(300)]
    other = "\n".join(["first", *lines, "last"])
    rows = [(1, "\n".join(lines[:150]) + "\n\n\n" + "\n".join(lines[150:])), (2, other), (3, "\n\n" + other)]
    out = {r["doc_id"]: r for r in line_dedup.remove_repeated_passages(documents(rows)).collect()}
    assert out[1]["n_removed_lines"] == 0 and out[2]["n_removed_lines"] > 280
    assert out[3]["kept_text"] == ""


def test_a_last_line_alone_costs_its_predecessor_nothing(documents):
    """A passage at a text's end is still found inside another, whatever single line follows it."""
    lines = [f"line {k}" for k in range(40)]
    rows = [(0, "\n".join(lines))] + [(k, "\n".join(lines[:k]) + "\nnew") for k in range(2, 39)]
    out = {r["doc_id"]: r["kept_text"] for r in line_dedup.remove_repeated_passages(documents(rows)).collect()}
    ends = line_dedup.boundaries([x.encode() for x in lines], 3, 2, 2, 64)
    assert all(out[k] == "new" for k in ends if k in out)


def test_boundaries_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    plain = {p[2] for p in line_dedup.passages(b"\n".join(lines))}
    shifted = [p[2] for p in line_dedup.passages(b"\n".join([b"new first line", *lines[:100], b"inserted", *lines[100:]]))]
    assert sum(p in plain for p in shifted) > 0.9 * len(shifted)


def test_passages_with_the_same_hash_are_compared(documents, monkeypatch):
    class Weak:
        xxh3_64_intdigest = staticmethod(line_dedup.xxhash.xxh3_64_intdigest)
        xxh3_128_digest = staticmethod(lambda data: b"\0" * 16)

    rows = [(i, f"alpha {i % 3}\nbeta {i % 3}") for i in range(6)]
    monkeypatch.setattr(line_dedup, "xxhash", Weak)
    out = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.remove_repeated_passages(documents(rows), most=2).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 2}


def test_empty_tables(documents):
    none = documents([(1, "a")]).limit(0)
    assert substring_dedup.remove_repeated_windows(none).collect() == []
    assert line_dedup.remove_repeated_passages(none).collect() == []
    assert line_dedup.remove_repeated_passages(documents([(None, None), (None, "")])).count() == 2
