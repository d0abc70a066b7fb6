"""Cleaning chains and text features with literal expectations."""

import pytest
from pyspark.sql import functions as F

from caselight.functions import text as tx


def clean(spark, subject, description):
    df = spark.createDataFrame([(subject, description)], "subject string, description string")
    return tx.clean_tickets(df).first().cleaned_text


def frames(n):
    return "\n".join(f"    at com.app.Mod.f{i}(Mod.java:{i})" for i in range(n))


CASES = [
    ("s", None, "s"), (None, "d", "d"), (None, None, ""), ("", "", ""),
    (" Login ", "<p>It <b>fails</b></p>", "Login. It fails"),
    ("s", "From: a@b.c\nreal text\nSent: today", "s. real text"),
    ("s", "My text\nOn Mon, Jan 1, John Doe wrote:\nold text", "s. My text"),
    ("s", "My text\n> quoted\nafter", "s. My text"),
    ("s", "My text\n--- Original Message ---\nold", "s. My text"),
    ("s", "My text\n----- forwarded  message -----\nold", "s. My text"),
    ("s", "Hi team,\nthe app broke", "s. the app broke"),
    ("s", "GOOD  morning all!\nthe app broke", "s. the app broke"),
    ("s", "the app broke\nBest regards,", "s. the app broke"),
    ("s", "the app broke\nThanks in advance!", "s. the app broke\nThanks in advance!"[:16]),
    ("s", "what!!!! now... then--- ==== ok", "s. what! now. then- = ok"),
    ("s", "a?!.b", "s. a.b"),
    ("s", "a\n\n\n\n\nb   c", "s. a\n\nb c"),
    ("s", "größer als früher, naïve café", "s. größer als früher, naïve café"),
]


@pytest.mark.parametrize("subject, description, want", CASES)
def test_clean_ticket(spark, subject, description, want):
    assert clean(spark, subject, description) == want


@pytest.mark.parametrize("n, kept", [
    (1, ["at com.app.Mod.f0(Mod.java:0)"]),
    (2, ["at com.app.Mod.f0(Mod.java:0)", "at com.app.Mod.f1(Mod.java:1)"]),
    (3, ["at com.app.Mod.f0(Mod.java:0)", " . (1 more frames)", "at com.app.Mod.f2(Mod.java:2)"]),
    (10, ["at com.app.Mod.f0(Mod.java:0)", " . (8 more frames)", "at com.app.Mod.f9(Mod.java:9)"]),
])
@pytest.mark.parametrize("tail", ["", "\nafter"])
def test_stack_runs(spark, n, kept, tail):
    body = "Exception: boom\n" + frames(n) + tail
    assert clean(spark, "s", body) == "s. Exception: boom\n" + "\n".join(kept) + tail


def test_collapsed_line_before_punctuation_is_shortened(spark):
    df = spark.createDataFrame([(frames(5),)], "t string")
    assert tx.collapse_stack(df, "t").first().t.split("\n")[1] == "  ... (3 more frames)"


def test_two_runs_are_collapsed_apart(spark):
    body = frames(3) + "\nCaused by: x\n" + frames(4)
    got = clean(spark, "s", body).split("\n")
    assert [l.strip() for l in got if "more" in l] == [". (1 more frames)", ". (2 more frames)"]
    assert len(got) == 7


def test_other_frame_forms(spark):
    body = "x\n  File \"a.py\", line 3\n  File \"b.py\", line 4\n#0 0xdeadbeef in f\ny"
    assert clean(spark, "s", body) == (
        "s. x\nFile \"a.py\", line 3\n . (1 more frames)\n#0 0xdeadbeef in f\ny")


def test_clean_resolution_keeps_headers_and_punctuation(spark):
    df = spark.createDataFrame([
        ("Hello there,\n<b>Set</b> timeout!!!!\nFrom: me\nKind regards",), (None,), ("",)], "resolution string")
    got = [r.cleaned_resolution for r in tx.clean_resolution(df).collect()]
    assert got == ["Set timeout!!!!\nFrom: me", "", ""]


def test_error_codes(spark):
    df = spark.createDataFrame(
        [("Got ERROR_TIMEOUT_429",), ("",), (None,), ("ERROR_Ä1 ERROR_B ERROR_B error_c",)], "t string")
    got = [r.c for r in df.select(tx.distinct_error_codes("t").alias("c")).collect()]
    assert got == [["ERROR_TIMEOUT_429"], [], [], ["ERROR_B", "ERROR_Ä1"]]


def test_tokens_and_words(spark):
    df = spark.createDataFrame([("Café ERROR_X-1 naïve_2",), (None,)], "t string")
    got = df.select(tx.tokens("t").alias("t"), tx.word_count("t").alias("w")).collect()
    assert got[0].t == ["café", "error_x", "1", "naïve_2"] and got[0].w == 3
    assert got[1].t == [] and got[1].w == 0


def test_composed_texts(spark):
    df = spark.createDataFrame(
        [("sub", "desc", "P", "E1\nE2", " res "), ("sub", None, None, None, None)],
        "subject string, description string, product string, error_logs string, resolution string")
    got = df.select(tx.embedding_text().alias("e"), tx.classifier_text().alias("c")).collect()
    assert got[0].e == "sub | desc | Product: P | Error: E1" and got[0].c == "sub [SEP] desc"
    assert got[1].e == "sub | " and got[1].c == "sub [SEP] "
    assert [r.index_text for r in tx.index_text(df).collect()] == ["sub | res", "sub | "]


def test_guards_do_not_change_results(spark):
    """Every pattern alternative still fires behind its cheap test."""
    texts = ["x regards", "x thanks", "x Thank you", "x CHEERS", "x sincerely", "x looking forward",
             "x please advise", "x appreciate your help"]
    for t in texts:
        assert clean(spark, "s", t) == "s. x", t
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(tx._where(F.col("t"), tx.CLOSING_PARTS, F.lit("")) != "").count() == 0


def test_reply_test_leaves_out_only_texts_without_a_reply(make):
    """The cheap test before the reply pattern agrees with the pattern itself."""
    texts = ["answer\n> quoted", "> all quoted", "a > b from me", "x\nOn Monday 3 May Ann wrote: hi", "--- Original Message ---\nold", "ok\n----forwarded message----",
             "new\nFrom: a\nSent: b\nTO : c\nSubject: d\nold", "from a to b", "forwarded to you", None, ""]
    df = make([(x,) for x in texts], "t string")
    cut = F.split(F.coalesce("t", F.lit("")), tx._uni(tx.QUOTED_REPLY), 2)
    plain = F.when(F.size(cut) > 1, tx.strip(cut[0])).otherwise(F.coalesce("t", F.lit("")))
    for r in df.select("t", tx._cut_at_reply(F.coalesce("t", F.lit(""))).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b, r.t
    tried = tx._where(F.col("t"), tx.REPLY_PARTS, F.lit("tried"), F.startswith("t", F.lit(">")))
    assert [r[0] for r in df.select(tried).collect()][-4:] == texts[-4:]
