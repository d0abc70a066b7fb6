"""Text expressions: tokens, error codes and the cleaning chains.

Everything is a column expression over whole texts. The regular expressions use the
Java flags (?d) (only \\n ends a line) and (?U) (Unicode classes), which give the
specified line and character semantics.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: patterns that must match the specification -------------------

WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+"
ERROR_CODE = rf"ERROR_{WORD}+"

HTML_TAG = r"<[^>]+>"
HEADER_LINE = r"(?imd)^(from|to|cc|bcc|sent|date|subject)\s*:\s*.*$"
QUOTED_REPLY = (
    r"(?imd)(on\s+.{5,60}\s+wrote\s*:"
    r"|from\s*:\s*.+\nsent\s*:\s*.+\nto\s*:\s*.+\nsubject\s*:\s*.+\n"
    r"|^>.*$"
    r"|-{3,}\s*original\s+message\s*-{3,}"
    r"|-{3,}\s*forwarded\s+message\s*-{3,})"
)
GREETING = (
    r"(?imd)^(hi|hello|hey|dear|good\s+(morning|afternoon|evening)|greetings)[\s,!.]*"
    r"(team|support|everyone|all|there)?[\s,!.]*\n?"
)
CLOSING = (
    r"(?imd)(best\s+regards|kind\s+regards|regards|thanks|thank\s+you|cheers|sincerely"
    r"|many\s+thanks|thanks\s+in\s+advance|looking\s+forward|please\s+advise"
    r"|appreciate\s+your\s+help)[,.\s!]*$"
)
STACK_FRAME = r"^\s*(at\s+.+|File\s+\".+\",\s+line\s+\d+|#\d+\s+0x[0-9a-fA-F]+)"
REPEATED_PUNCTUATION = r"([!?.=\-]){3,}"
MANY_NEWLINES = r"\n{3,}"
MANY_SPACES = r" {2,}"

# parts that every match of the two searching patterns contains, all of a group; letters with
# more than one upper-case form are left out, so that testing the lower-cased text is safe
REPLY_PARTS = [["wrote"], ["from", "\nto"], ["\n>"], ["---", "original"], ["---", "forwarded"]]
CLOSING_PARTS = [["regard"], ["than"], ["cheer"], ["incerely"], ["forward"], ["advi"], ["appreciate"]]

# ---------------------------------------------------------------------------------

_TRIM = r"\A\s+|\s+\z"


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _uni(pattern: str) -> str:
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _uni(_TRIM), "")


def tokens(c: str | Column) -> Column:
    """Lower-cased words in order; original text, nothing dropped."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(TOKEN), F.lit(0))


def error_codes(c: str | Column) -> Column:
    """All error codes in order of appearance."""
    return F.regexp_extract_all(_text(c), F.lit(ERROR_CODE), F.lit(0))


def distinct_error_codes(c: str | Column) -> Column:
    return F.array_sort(F.array_distinct(error_codes(c)))


def word_count(c: str | Column) -> Column:
    return F.size(F.regexp_extract_all(_text(c), F.lit(r"(?U)\S+"), F.lit(0)))


def first_line(c: str | Column) -> Column:
    return F.substring_index(F.col(c) if isinstance(c, str) else c, "\n", 1)


def _where(c: Column, parts: list[list[str]], changed: Column, some: Column | None = None) -> Column:
    """Run an expensive pattern only on texts that can match it: those with all parts of a group."""
    low, some = F.lower(c), F.lit(False) if some is None else some
    for group in parts:
        some = some | reduce(and_, [F.contains(low, F.lit(p)) for p in group])
    return F.when(some, changed).otherwise(c)


def _cut_at_reply(c: Column) -> Column:
    """Text before the first quoted reply, trimmed if there is one."""
    parts = F.split(c, _uni(QUOTED_REPLY), 2)
    return _where(c, REPLY_PARTS, F.when(F.size(parts) > 1, strip(parts[0])).otherwise(c), F.startswith(c, F.lit(">")))


def _without_closing(c: Column) -> Column:
    return _where(c, CLOSING_PARTS, _replace(c, (CLOSING, "")))


def _replace(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, _uni(pattern), by)
    return c


def _collapse_runs(lines: Column, is_frame: Column, starts: Column) -> Column:
    """Every run of more than two frames becomes first, a count line, last."""
    n = F.size(lines)

    def run(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), n)
        length = end - start
        part = F.slice(lines, start + 1, length)
        short = F.transform(part, strip)
        long = F.array(
            strip(F.get(lines, start)),
            F.concat(F.lit("  ... ("), (length - 2).cast("string"), F.lit(" more frames)")),
            strip(F.get(lines, end - 1)),
        )
        return (
            F.when(~F.get(is_frame, start), part)
            .when(length > 2, long).otherwise(short)
        )

    return F.array_join(F.flatten(F.transform(starts, run)), "\n")


def collapse_stack(df: DataFrame, text: str) -> DataFrame:
    """Collapse stack traces in column ``text``; linear in the number of lines.

    Lines never leave their row, so there is no explode and no shuffle. The helper
    columns are projected one after the other so that each is computed once.
    """
    has_frame = F.col(text).rlike(_uni(r"(?md)" + STACK_FRAME))
    lines = F.when(has_frame, F.split(text, "\n")).otherwise(F.array(F.col(text)))
    flags = F.transform(F.col("_lines"), lambda l: l.rlike(_uni("(?d)" + STACK_FRAME)))
    positions = F.sequence(F.lit(0), F.size("_lines") - 1)
    starts = F.filter(
        positions,
        lambda i: (i == 0) | (F.get("_frames", i) != F.get("_frames", i - 1)),
    )
    return (
        df.withColumn("_lines", lines)
        .withColumn("_frames", flags)
        .withColumn("_starts", starts)
        .withColumn(
            text,
            F.when(F.exists("_frames", lambda f: f),
                   _collapse_runs(F.col("_lines"), F.col("_frames"), F.col("_starts")))
            .otherwise(F.col(text)),
        )
        .drop("_lines", "_frames", "_starts")
    )


def clean_tickets(
    df: DataFrame, out: str = "cleaned_text", subject: str = "subject",
    description: str = "description", stack: bool = True,
) -> DataFrame:
    """Add the cleaned "subject. description" used for semantic search."""
    body = _replace(strip(_text(description)), (HTML_TAG, " "), (HEADER_LINE, ""))
    df = df.withColumn("_body", body).withColumn(
        "_body", _replace(_cut_at_reply(F.col("_body")), (GREETING, "")))
    df = df.withColumn("_body", _without_closing(F.col("_body")))
    if stack:
        df = collapse_stack(df, "_body")
    tail = strip(_replace(
        F.col("_body"), (REPEATED_PUNCTUATION, "$1"), (MANY_NEWLINES, "\n\n"),
        (MANY_SPACES, " ")))
    df = df.withColumn("_body", tail).withColumn("_head", strip(_text(subject)))
    both = (F.length("_head") > 0) & (F.length("_body") > 0)
    return df.withColumn(
        out,
        F.when(both, F.concat("_head", F.lit(". "), "_body"))
        .otherwise(F.concat("_head", "_body")),
    ).drop("_body", "_head")


def clean_resolution(df: DataFrame, out: str = "cleaned_resolution",
                     resolution: str = "resolution") -> DataFrame:
    """Add the cleaned resolution text used at index time."""
    start = _replace(strip(_text(resolution)), (HTML_TAG, " "), (GREETING, ""))
    df = df.withColumn("_res", start).withColumn("_res", _without_closing(F.col("_res")))
    end = _replace(_cut_at_reply(F.col("_res")), (MANY_NEWLINES, "\n\n"), (MANY_SPACES, " "))
    return df.withColumn(out, strip(end)).drop("_res")


def index_text(df: DataFrame, out: str = "index_text") -> DataFrame:
    """Text for the vector index: subject and cleaned resolution."""
    df = clean_resolution(df, "_cleaned")
    return df.withColumn(
        out, F.concat(strip(_text("subject")), F.lit(" | "), F.col("_cleaned"))
    ).drop("_cleaned")


def embedding_text() -> Column:
    """Text for a ticket's embedding: subject, description, product, first log line."""
    def labelled(prefix: str, c: Column) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(prefix), c))

    return F.concat_ws(
        " | ", _text("subject"), _text("description"),
        labelled("Product: ", F.col("product")),
        F.when(F.length("error_logs") > 0,
               F.concat(F.lit("Error: "), first_line("error_logs"))),
    )


def classifier_text() -> Column:
    return F.concat(_text("subject"), F.lit(" [SEP] "), _text("description"))
