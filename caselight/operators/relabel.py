"""Label correction: prompts, answers, corrections and review samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.functions.text import strip
from caselight.schemas import PRIORITIES, SENTIMENTS, SUBCATEGORIES, with_columns
from caselight.session import kept_aside

FIELDS = {"subcategory": "subcategory", "priority": "priority", "sentiment": "customer_sentiment"}

# ---- fixed values: field titles of the prompt -----------------------------------
ALWAYS = {
    "Subject": "subject", "Description": "description", "Category": "category",
    "Product": "product", "Product module": "product_module",
    "Product version": "product_version", "Customer tier": "customer_tier",
    "Channel": "channel", "Environment": "environment", "Severity": "severity",
    "Affected users": "affected_users", "Business impact": "business_impact",
}
OPTIONAL = {
    "Error logs": "error_logs", "Stack trace": "stack_trace", "Resolution": "resolution",
    "Resolution code": "resolution_code", "Customer feedback": "feedback_text",
}
# lengths for a labeler with a short context; texts are whole unless these are passed
SHORT_TEXTS = {"error_logs": 300, "stack_trace": 200, "resolution": 300, "feedback_text": 200}
SHORT_TAGS = 10
# ---------------------------------------------------------------------------------


def _subcategories(category: Column) -> Column:
    pairs = [x for c, subs in SUBCATEGORIES.items()
             for x in (F.lit(c), F.array(*[F.lit(s) for s in subs]))]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), category), F.array().cast("array<string>"))


def prompt_fields(df: DataFrame, text_chars: dict[str, int] | None = None, n_tags: int | None = None) -> Column:
    """The ticket part of the prompt, one titled line per field.

    Texts and tags are whole; ``text_chars`` (length by column) and ``n_tags`` cut them.
    """
    lines = []
    for title, col in ALWAYS.items():
        missing = "UNKNOWN" if col == "category" else "N/A"
        lines.append(F.concat(F.lit(f"{title}: "), F.coalesce(F.col(col).cast("string"), F.lit(missing))))
    for title, col in OPTIONAL.items():
        chars = (text_chars or {}).get(col)
        value = F.col(col) if chars is None else F.left(col, F.lit(chars))
        lines.append(F.when(F.length(col) > 0, F.concat(F.lit(f"{title}: "), value)))
    escalated = F.coalesce("escalated", F.lit(False))
    lines.append(F.when(escalated, F.lit("Escalated: True")))
    lines.append(F.when(escalated & (F.length("escalation_reason") > 0),
                        F.concat(F.lit("Escalation reason: "), "escalation_reason")))
    lines.append(F.when(F.size("tags") > 0, F.concat(
        F.lit("Tags: "), F.array_join("tags" if n_tags is None else F.slice("tags", 1, n_tags), ", "))))
    return F.concat_ws("\n", *lines)


def with_prompt(tickets: DataFrame, out: str = "prompt", text_chars: dict[str, int] | None = None,
                n_tags: int | None = None) -> DataFrame:
    """Add the labelling prompt."""
    cols = [*ALWAYS.values(), *OPTIONAL.values(), "escalated", "escalation_reason", "tags"]
    df = with_columns(tickets, cols)
    category = F.coalesce("category", F.lit("UNKNOWN"))
    return df.withColumn(out, F.concat_ws(
        "\n",
        F.lit("Review the labels of this support ticket and give the correct values."),
        F.concat(F.lit('The category "'), category, F.lit('" is correct; keep it.')),
        F.lit("\nTICKET:"), prompt_fields(df, text_chars, n_tags), F.lit(""),
        F.concat(F.lit("subcategory, exactly one of: "), F.array_join(_subcategories(category), ", ")),
        F.lit("priority, exactly one of: " + ", ".join(PRIORITIES)),
        F.lit("sentiment, exactly one of: " + ", ".join(SENTIMENTS)),
        F.lit('Answer only with JSON: {"subcategory": "...", "priority": "...", "sentiment": "..."}'),
    ))


def _unfenced(raw: Column) -> Column:
    text = strip(raw)
    # the text after the first line, up to the last fence
    rest = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise(text)
    body = F.regexp_replace(rest, r"(?s)```(?!.*```).*\z", "")
    return F.when(text.startswith("```"), strip(body)).otherwise(text)


def parse_answers(answers: DataFrame, raw: str = "raw", category: str = "category") -> DataFrame:
    """Add subcategory / priority / sentiment, valid parts only, and ``status``.

    The whole answer or else its first {...} is read as JSON. An answer that is
    missing is api_fail, one without any valid part parse_fail.
    """
    df = answers.withColumn("_text", _unfenced(F.col(raw)))
    whole = F.try_parse_json("_text")
    first = F.try_parse_json(F.nullif(F.regexp_extract("_text", r"\{[^}]+\}", 0), F.lit("")))
    df = df.withColumn("_json", F.coalesce(whole, first))

    # each part is taken from the answer once, in a step of its own
    df = df.withColumns({f"_{n}": F.try_variant_get("_json", f"$.{n}", "string") for n in ("subcategory", "priority", "sentiment")})

    def part(name: str) -> Column:
        return F.col(f"_{name}")

    valid = _subcategories(F.col(category))
    exact = F.filter(valid, lambda v: v == part("subcategory"))
    folded = F.filter(valid, lambda v: F.lower(v) == F.lower(part("subcategory")))
    choice = lambda name, allowed: F.when(F.lower(part(name)).isin(allowed), F.lower(part(name)))
    df = df.withColumns({
        "new_subcategory": F.coalesce(F.get(exact, F.lit(0)), F.get(folded, F.lit(0))),
        "new_priority": choice("priority", PRIORITIES),
        "new_sentiment": choice("sentiment", SENTIMENTS),
    })
    some = F.coalesce("new_subcategory", "new_priority", "new_sentiment").isNotNull()
    status = F.when(F.col(raw).isNull(), "api_fail").when(some, "success").otherwise("parse_fail")
    return df.withColumn("status", status).drop("_text", "_json", "_subcategory", "_priority", "_sentiment")


def remaining(tickets: DataFrame, done: DataFrame) -> DataFrame:
    """Tickets without a correction row yet; this is how a run resumes."""
    return tickets.join(done.select("ticket_id"), "ticket_id", "left_anti")


def label_tickets(tickets: DataFrame, done: DataFrame, labeler: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prompt, label and parse the tickets not done yet.

    ``labeler`` maps (ticket_id, category, prompt) to the same rows plus ``raw``; it may
    be a ``mapInPandas`` job around a model client or a join with stored answers.
    """
    asked = with_prompt(remaining(tickets, done)).select("ticket_id", "category", "prompt")
    return parse_answers(labeler(asked)).select(
        "ticket_id", "new_subcategory", "new_priority", "new_sentiment", "status")


#: Prompts of a chunk that one task writes.
PROMPTS_PER_PART = 50_000
_PLAN, _COMMIT = "chunks int", "chunk int, n long, failed long, finished_at timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def plan_labelling(tickets: DataFrame, base: str, chunk_tickets: int = 10_000) -> int:
    """Write the prompts below ``base``, dealt into chunks by a hash of the ticket; their number.

    What an earlier run planned stays, so a chunk holds the same tickets in every run.
    """
    spark = tickets.sparkSession
    plan = _stored(spark, f"{base}/plan", _PLAN).first()  # written last
    if plan:
        return plan["chunks"]
    chunks = max(1, -(-tickets.count() // chunk_tickets))
    asked = with_prompt(tickets).select("ticket_id", "category", "prompt", F.pmod(F.xxhash64("ticket_id"), F.lit(chunks)).cast("int").alias("chunk"))
    # a chunk may be large: its prompts are dealt to parts, which later jobs read side by side
    per_chunk = -(-min(chunk_tickets, tickets.count()) // PROMPTS_PER_PART)
    if per_chunk > 1:
        asked = asked.repartition(chunks * per_chunk, "chunk", F.pmod(F.xxhash64("ticket_id", "prompt", F.lit(1)), F.lit(per_chunk)))
    else:
        asked = asked.repartition("chunk")
    asked.write.mode("overwrite").partitionBy("chunk").parquet(f"{base}/asked")
    spark.createDataFrame([(chunks,)], _PLAN).write.mode("overwrite").parquet(f"{base}/plan")
    return chunks


def label_in_chunks(
    tickets: DataFrame, base: str, labeler: Callable[[DataFrame], DataFrame], chunk_tickets: int = 10_000,
    retries: int = 2, most_chunks: int | None = None,
) -> DataFrame:
    """Label what earlier runs below ``base`` have not; all labels so far (``read_labels``).

    One job per chunk writes its labels and then a commit row: what a cut-off run had begun is
    done again, what it had finished is not. Answers that are missing (api_fail) are asked again
    up to ``retries`` times. ``most_chunks`` ends a run early.
    """
    spark = tickets.sparkSession
    chunks = plan_labelling(tickets, base, chunk_tickets)
    done = {r["chunk"] for r in _stored(spark, f"{base}/commits", _COMMIT).select("chunk").collect()}  # a row per chunk
    here = spark.read.parquet(f"{base}/asked")
    for chunk in [c for c in range(chunks) if c not in done][:most_chunks]:
        asked = here.filter(F.col("chunk") == chunk).drop("chunk")
        parts, failed = [], asked
        for attempt in range(retries + 1):
            answers = kept_aside(parse_answers(labeler(failed)).select(
                "ticket_id", "new_subcategory", "new_priority", "new_sentiment", "status", F.lit(attempt + 1).alias("attempts")))
            again = (F.col("status") == "api_fail") & F.lit(attempt < retries)
            parts.append(answers.filter(~again))
            missing = kept_aside(answers.filter(again).select("ticket_id"))
            if missing.isEmpty():
                break
            failed = asked.join(missing, "ticket_id", "left_semi")
        out = reduce(DataFrame.unionByName, parts)
        path = f"{base}/done/chunk={chunk}"
        out.write.mode("overwrite").parquet(path)
        facts = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "api_fail").alias("failed"))
        facts.select(F.lit(chunk).alias("chunk"), "n", "failed", F.current_timestamp().alias("finished_at")).write.mode("append").parquet(f"{base}/commits")
    return read_labels(spark, base)


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """The labels of all finished chunks, with the number of times each ticket was asked."""
    schema = "ticket_id string, new_subcategory string, new_priority string, new_sentiment string, status string, attempts int, chunk int"
    rows = _stored(spark, f"{base}/done", schema)
    finished = _stored(spark, f"{base}/commits", _COMMIT).select("chunk").distinct()
    return rows.join(finished, "chunk", "left_semi").drop("chunk")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def _joined(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    new = [f"new_{f}" for f in FIELDS]
    return with_columns(tickets, FIELDS.values()).join(
        corrections.select("ticket_id", *new), "ticket_id", "left")


def apply_corrections(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Tickets with corrected labels; one correction row per ticket."""
    df = _joined(tickets, corrections)
    return df.withColumns({
        col: F.coalesce(f"new_{f}", col) for f, col in FIELDS.items()
    }).drop(*[f"new_{f}" for f in FIELDS])


def _changed(field: str, col: str) -> Column:
    return F.col(f"new_{field}").isNotNull() & ~F.col(f"new_{field}").eqNullSafe(F.col(col))


def change_counts(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """(field, changed, total): labels the corrections change."""
    df = _joined(tickets, corrections)
    facts = df.agg(F.count("*").alias("total"),
                   *[F.count_if(_changed(f, c)).alias(f) for f, c in FIELDS.items()])
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("changed"), F.col("total").alias("total"))
        for f in FIELDS])
    return facts.select(F.inline(cells))


def spot_check(tickets: DataFrame, corrections: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """A repeatable random sample of n corrected tickets with old and new labels."""
    usable = corrections.filter(
        F.coalesce(*[F.col(f"new_{f}") for f in FIELDS]).isNotNull())
    sample = usable.orderBy(F.xxhash64("ticket_id", F.lit(seed)), "ticket_id").limit(n)
    df = with_columns(tickets, [*FIELDS.values(), "category"]).join(
        F.broadcast(sample.select("ticket_id", *[f"new_{f}" for f in FIELDS])), "ticket_id")
    return df.select(
        "ticket_id", "category",
        *[x for f, c in FIELDS.items() for x in (
            F.col(c).alias(f"old_{f}"), F.col(f"new_{f}"), _changed(f, c).alias(f"{f}_changed"))])


def first_tickets(tickets: DataFrame, n: int) -> DataFrame:
    """The processing cap of a trial run."""
    return tickets.orderBy("ticket_id").limit(n)

