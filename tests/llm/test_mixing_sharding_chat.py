import collections
import hashlib
import zlib

import brute
import pytest
from hypothesis import given
from hypothesis import strategies as st

from caselight.llm import chat_format, mixing, sharding


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        share = sum(w[n] for n in names if n not in capped)
        rest = total - sum(3 * sizes[n] for n in capped)
        out = {n: 3.0 * sizes[n] if n in capped else rest * w[n] / share for n in names}
        over = {n for n in names if n not in capped and out[n] > 3 * sizes[n]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("most_sources", [20_000, 1])
def test_mixing(documents, corpus, monkeypatch, most_sources):
    monkeypatch.setattr(mixing, "MAX_SOURCES", most_sources)
    docs = documents(corpus + [(300, "a b"), (300, "a b"), (None, "c d e"), (None, None)])
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) >= set(docs.columns) - {"size"}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(brute.words(r["text"]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for name, n in taken.items():
        assert n == int(want[name])
    again = sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    assert again == sorted(map(str, rows))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    got = collections.Counter()
    for r in copies.collect():
        got[r["source"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def test_small_sources_stop_at_their_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 2000, "d": 0}
    out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in out} == pytest.approx(targets(sizes))


def test_identical_rows_and_empty_mix(spark, documents):
    rows = mixing.mixed(documents([(1, "a b c")] * 10).drop("source").selectExpr("*", "'x' as source")).collect()
    assert [r["taken"] for r in rows] == [3] * 10
    assert mixing.mixed(documents([(1, "a")]).limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mixed(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = (b + 1) * 2**31 // ((key >> 33) + 1)
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 700])
def test_shards(documents, corpus, n):
    rows = corpus + [(None, "x"), (None, None), (7, "y"), (7, "y")]
    out = sharding.sharded(documents(rows), n).collect()
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        key = int(hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:16], 16)
        data = (r["text"] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (jump(key, n), jump(key, n + 1))
        assert r["grown_shard"] in (r["shard"], n)
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.sharded(documents(rows).limit(0), n).collect() == []


def test_shard_files(documents, corpus, tmp_path, spark):
    out = sharding.sharded(documents(corpus), 3)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().count() == 3 and back.count() == len(corpus)


TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x <|", "<||>", "", "é\n\n<", "\\", "<|im_start|>user\nhi<|im_end|>\n"]


def test_conversations_read_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", TRICKY[(c + t) % len(TRICKY)]) for c in range(8) for t in range(5)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (9, 1, "as\nsis\\tant", "y"), (9, 1, "assistant", None), (9, 1, "assistant", "b"), (10, 0, "assistant", "z" * 300_000), (11, 0, "user", "a"), (11, 0, "user", "a")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    pieces = chat_format.format_conversations(turns)
    out = {r["conv_id"]: r for r in chat_format.read_back(pieces).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert out.keys() == want.keys()
    for c, own in want.items():
        own.sort()
        turned = "".join(f"{r[3]}\n{r[5]}\n" for r in own)
        loss = "".join(r[5] for r in own if r[3] == "assistant")
        r = out[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(turned.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = b"".join(p["formatted"] for p in pieces.collect() if p["conv_id"] == c)
        assert r["formatted_chars"] == len(text.decode())
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_long_conversation_comes_in_pieces(spark):
    rows = [(1, t, "assistant", f"text {t}") for t in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pieces = chat_format.format_conversations(turns)
        assert pieces.count() > 1
        (r,) = chat_format.read_back(pieces).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (r["n_turns"], r["loss_sha256"]) == (50, hashlib.sha256("".join(x[3] for x in rows).encode()).hexdigest())


@given(st.text(alphabet="<|\\>aé\nn"), st.text(alphabet="<|\\>aé\nn"))
def test_escapes_are_reversible(role, text):
    import pyarrow as pa

    out = chat_format.escape(pa.array([text]))[0].as_py()
    assert "<|" not in out and chat_format.unescape(out.encode()).decode() == text
    named = chat_format.escape_role(pa.array([role]))[0].as_py()
    assert "<|" not in named and "\n" not in named and chat_format.unescape_role(named.encode()).decode() == role
