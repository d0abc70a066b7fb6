"""The given tables seen as tickets, logs and queries.

Each binding is a projection with plain integer arithmetic over a whole table; its
SQL form is the view of the same name in ``views.sql_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.session import shared_dir, use_utc

TIERS = ["enterprise", "premium", "standard", "free"]
PRIORITIES = ["critical", "high", "medium", "low"]
CHANNELS = ["email", "chat", "phone", "portal", "api"]
SEVERITIES = ["S1", "S2", "S3", "S4"]
MOODS = ["angry", "frustrated", "anxious", "confused", "neutral", "satisfied", "grateful"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LANGS = ["en", "fr", "de", "es"]
SKILLS = ["network", "billing", "product"]
#: Events of a file that one task writes and one reads.
FILE_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """Element of a fixed list by 0-based position modulo its length."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _k() -> Column:
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")


def events_as_tickets(events: DataFrame) -> DataFrame:
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("_k")
    text = lambda c: c.cast("string")
    return events.withColumn("_k", _k()).select(
        text(i).alias("ticket_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        text(u).alias("customer_id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("S"), text(k % 3)).alias("subcategory"),
        F.concat(F.lit("P"), text(k % 5)).alias("product"),
        F.concat(F.lit("A"), text(k % 20)).alias("agent_id"),
        pick(PRIORITIES, k).alias("priority"),
        pick(SEVERITIES, k + i).alias("severity"),
        pick(MOODS, i).alias("customer_sentiment"),
        pick(TIERS, u).alias("customer_tier"),
        pick(CHANNELS, i).alias("channel"),
        pick(SKILLS, k).alias("agent_specialization"),
        F.when(k % 4 != 0, k % 60).alias("agent_experience_months"),
        F.col("value").alias("resolution_time_hours"),
        F.when(k % 10 != 0, (1 + i % 5).cast("int")).alias("satisfaction_score"),
        (i % 9 == 0).alias("escalated"),
        F.when(k % 7 != 0, i % 3 != 0).alias("resolution_helpful"),
        (1 + i % 8).cast("int").alias("response_count"),
        (1 + i % 4).cast("int").alias("resolution_attempts"),
        (k % 3).alias("transferred_count"),
        (100 + (i * 37) % 900).cast("int").alias("ticket_text_length"),
        (u % 20).cast("int").alias("previous_tickets"),
        ((u * 13) % 1500).cast("int").alias("account_age_days"),
        (F.col("value") * (10 + F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))))
        .alias("account_monthly_value"),
        (i % 11).cast("int").alias("similar_issues_last_30_days"),
        F.when(k % 6 != 0, (k * 3) % 200).alias("product_version_age_days"),
        (1 + i % 40).cast("int").alias("affected_users"),
        (k % 4).alias("attachments_count"),
        (i % 4 == 0).alias("contains_error_code"),
        (i % 6 == 0).alias("contains_stack_trace"),
        (F.weekday(F.col("ts").cast("timestamp")) >= 5).alias("weekend_ticket"),
        ((F.hour(F.col("ts").cast("timestamp")) < 8)
         | (F.hour(F.col("ts").cast("timestamp")) > 18)).alias("after_hours"),
    )


def tickets_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_tickets(table(spark, sf_dir, "events"))


def tickets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event tickets with a spike in two products, a bad mood in a third and a new category in
    a fourth, all near the end."""
    t = tickets_e(spark, sf_dir)
    newest = t.agg(F.max("created_at")).scalar()
    since = lambda days: F.col("created_at") >= newest - F.make_dt_interval(days=F.lit(days))
    product = F.col("product")
    copies = F.when(since(7) & (product == "P1"), 9).when(since(7) & (product == "P2"), 2).otherwise(1)
    new = since(2) & (product == "P4") & (F.col("ticket_id").cast("long") % 2 == 0)
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumns({
        "ticket_id": F.concat("ticket_id", F.lit("-"), "copy"),
        "category": F.when(new, "outage").otherwise(F.col("category")),
        "customer_sentiment": F.when(since(1) & (product == "P3"), "angry").otherwise(F.col("customer_sentiment")),
    }).drop("copy")


def event_files(spark: SparkSession, sf_dir: str, n: int = 4, times: int = 1, shift_days: int = 0,
                file_rows: int = FILE_ROWS) -> tuple[str, int]:
    """The events written for a stream of ``n`` batches, each over the whole time; every event is
    delivered ``times`` times, each time dated ``shift_days`` later. Events of the first week that
    have been delivered before come once more in a last batch. The folder, and the files of a
    batch: one up to ``file_rows`` events, more beyond, as one task writes a file and one reads it."""
    base = shared_dir(spark, "event-files")
    events = table(spark, sf_dir, "events")
    each = max(1, -(-events.count() * times // (n * file_rows)))
    if times > 1:
        events = events.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        later = F.make_dt_interval(days=F.col("_t") * shift_days)
        events = events.withColumn("ts", (F.col("ts").cast("timestamp") + later).cast(events.schema["ts"].dataType)).drop("_t")
    events.repartition(n * each).write.parquet(base)
    if times > 1:
        first = F.col("ts").cast("timestamp") < F.lit("2024-01-08").cast("timestamp")
        late = events.filter(first & (F.col("event_id") % 50 != 0))
        late = late.repartition(each) if each > 1 else late.coalesce(1)
        late.write.mode("append").parquet(base)
    return base, each


def tickets_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets: first line the subject, the rest the resolution."""
    # the given text tables are single row groups, which a scan can't split between tasks
    d = table(spark, sf_dir, "documents").repartition("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    code = F.concat(F.lit("ERROR_"), F.upper("source"), F.lit("_"), (i % 7).cast("string"))
    rest = F.when(
        F.contains(F.col("text"), F.lit("\n")),
        F.expr("substring(text, instr(text, '\\n') + 1)"))
    return d.select(
        i.cast("string").alias("ticket_id"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
        F.col("lang").alias("category"),
        F.concat(F.lit("S"), (i % 3).cast("string")).alias("subcategory"),
        F.col("source").alias("product"),
        pick(PRIORITIES, i).alias("priority"),
        pick(MOODS, i).alias("customer_sentiment"),
        F.concat(F.lit("C"), (i % 97).cast("string")).alias("customer_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.concat(F.col("text"), F.lit(" "), code).alias("description"),
        F.nullif(rest, F.lit("")).alias("resolution"),
        F.concat(F.lit("RC"), (i % 6).cast("string")).alias("resolution_code"),
        F.when(F.col("quality").isNotNull(), F.col("quality") == 1).alias("resolution_helpful"),
        (F.col("toxic") == 1).alias("escalated"),
        (1 + i % 5).cast("int").alias("satisfaction_score"),
        (F.col("n_chars") / 100.0).alias("resolution_time_hours"),
        F.when(i % 3 != 0, F.concat(
            code, F.lit(" retry "), code, F.lit(" then ERROR_NET_"), (i % 5).cast("string"),
            F.lit("\nsecond line"))).alias("error_logs"),
        F.array(F.concat(F.lit("tag"), (i % 9).cast("string"))).alias("tags"),
        (i % 4 == 0).alias("contains_error_code"),
        F.when(i % 5 != 0, i % 6 == 0).alias("contains_stack_trace"),
        F.when(i % 6 != 0, (i % 200).cast("int")).alias("product_version_age_days"),
    )


def tickets_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tickets: many equal times."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("category"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("product"),
        (F.col("o_totalprice") / 1000.0).alias("resolution_time_hours"),
    )


def tickets_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as tickets with HTML bodies."""
    return table(spark, sf_dir, "pages").repartition("page_id").select(
        F.col("page_id").cast("string").alias("ticket_id"), F.col("url").alias("subject"),
        F.col("html").alias("description"), F.col("html").alias("resolution"))


def queries_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as incoming tickets with predicted labels."""
    i = F.col("item_id")
    product = F.concat(F.lit("src"), (i % 20).cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("query_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.concat(F.col("text"), F.lit(" ERROR_SRC"), (i % 20).cast("string"), F.lit("_"),
                 (i % 7).cast("string"), F.lit(" ERROR_NET_"), (i % 5).cast("string")).alias("description"),
        product.alias("product"),
        pick([*LANGS, "xx"], i).alias("predicted_category"),
        F.concat(F.lit("S"), (i % 3).cast("string")).alias("predicted_subcategory"),
        pick(PRIORITIES, i).alias("predicted_priority"),
        pick(MOODS, i).alias("predicted_sentiment"),
    )


def vectors_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("ticket_id"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("category"),
        F.concat(F.lit("P"), (F.col("vec_id") % 5).cast("string")).alias("product"),
        F.col("embedding").alias("vector"))


def _shifted(every: int) -> Column:
    """The category, moved to the next one for every ``every``-th ticket."""
    i = F.col("ticket_id").cast("long")
    at = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("category"))
    return F.when(i % every == 0, pick(EVENT_TYPES, at)).otherwise(F.col("category"))


def log_of(tickets: DataFrame) -> DataFrame:
    i = F.col("ticket_id").cast("long")
    predicted = _shifted(6)
    truth = F.when(i % 4 == 0, F.col("category"))
    return tickets.select(
        "ticket_id", F.col("created_at").alias("timestamp"), predicted.alias("predicted_category"),
        (0.5 + (i % 50) / 100.0).alias("confidence"),
        F.concat(F.lit("model_"), (i % 2).cast("string")).alias("model_name"),
        truth.alias("true_category"),
        F.coalesce(predicted != truth, F.lit(False)).alias("was_corrected"),
        F.col("category").alias("actual_category"))


def pred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(tickets_e(spark, sf_dir))


def shadow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ticket_id").cast("long")
    return tickets_e(spark, sf_dir).select(
        "ticket_id", F.col("created_at").alias("timestamp"), _shifted(7).alias("predicted_category"),
        (0.52 + (i % 47) / 100.0).alias("confidence"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ticket_id").cast("long")
    return tickets_e(spark, sf_dir).select(
        "ticket_id", F.col("category").alias("predicted_category"),
        F.when(i % 6 == 0, pick(EVENT_TYPES, F.array_position(
            F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("category")))).alias("corrected_category"),
        F.when(i % 3 == 1, F.lit(True)).when(i % 3 == 2, F.lit(False)).alias("resolution_accepted"),
        "agent_id", F.col("created_at").alias("feedback_at"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review rows per ticket, the later one counts; most reviews correct nothing."""
    t = tickets_e(spark, sf_dir)
    i = F.col("ticket_id").cast("long")
    wrong = i % 5 == 0
    rows = F.array(
        F.struct(F.when(wrong, "first").alias("corrected"), F.col("created_at").alias("corrected_at")),
        F.struct(F.when(wrong, pick(EVENT_TYPES, i)).alias("corrected"),
                 (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("corrected_at")))
    return t.select("ticket_id", F.inline(rows))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as label requests with raw model answers of every kind."""
    i = F.col("event_id")
    category = pick(["Data Issue", "Technical Issue", "Feature Request", "Other"], i)
    sub = pick(["Corruption", "crash/bug", "UI ENHANCEMENT", "Sync Error", "Billing"], i)
    mood = pick(["Angry", "neutral", "grateful", "bored"], i)
    pri = pick(["HIGH", "low", "urgent"], i)
    body = F.concat(
        F.lit('{"subcategory": "'), sub, F.lit('", "priority": "'), pri,
        F.lit('", "sentiment": "'), mood, F.lit('"}'))
    raw = (
        F.when(i % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(i % 7 == 1, F.concat(F.lit("Here is the answer: "), body, F.lit(" I hope it helps.")))
        .when(i % 7 == 2, F.concat(F.lit("```"), body, F.lit("```")))
        .when(i % 7 == 3, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(i % 7 == 4, F.lit('{"subcategory": "Corruption", '))
        .when(i % 7 == 5, F.concat(F.lit('{"priority": "'), pri, F.lit('"}')))
    )
    return table(spark, sf_dir, "events").select(
        i.cast("string").alias("ticket_id"), category.alias("category"), raw.alias("raw"),
        sub.alias("subcategory"), F.lower(pri).alias("priority"),
        F.lower(mood).alias("customer_sentiment"))


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.cast("string").alias("event_id"), "event_type",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("latency_ms"),
        F.concat(F.lit("component_"), (i % 3).cast("string")).alias("component"),
        F.when(i % 10 == 0, "error").when(i % 25 == 1, "timeout").alias("status"))


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as model versions."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("model_"), (F.col("s_nationkey") % 7).cast("string")).alias("model_name"),
        F.col("s_name").alias("version"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("s_suppkey") * 7919 % 500) * 3600).alias("trained_at"))
