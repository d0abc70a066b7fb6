import corpus_pipeline


def test_exact_copies_in_rows_of_one_document_go(spark, documents):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, text("a"))] * 6 + [(None, text("b")), (7, text("c")), (7, text("c")), (7, text("d")), (8, text("e")), (9, text("e"))]
    rows += [(None, None), (None, None), (None, ""), (None, ""), (10, "")]
    docs = documents(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("e")), (None, None), (None, ""), (10, "")]
    assert got == sorted(want, key=str)
    # the first by the other columns: a null source comes before others
    assert [r["source"] for r in out.where(f"text = '{text('a')}'").collect()] == [None]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_copies_are_cut_before_they_are_moved(spark, documents):
    shown = corpus_pipeline._once(documents([(None, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in shown and shown.count("WindowGroupLimit") >= 2
