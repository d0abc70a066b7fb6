"""Dataset checks, the input contract and the ingest summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselight.schemas import INPUT_DEFAULTS, REQUIRED_COLUMNS, with_columns


def dataset_checks(df: DataFrame) -> DataFrame:
    """One row per check (check, passed, details), from a single aggregate."""
    complete = all(c in df.columns for c in REQUIRED_COLUMNS)
    df = with_columns(df, ["ticket_id", "category"])
    facts = df.agg(
        F.count("*").alias("n"),
        F.count_distinct("ticket_id").alias("ids"),
        F.count_if(F.col("category").isNull()).alias("nulls"),
    )
    rows = F.array(
        F.struct(F.lit("row_count").alias("check"), (F.col("n") > 0).alias("passed"),
                 F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("details")),
        F.struct(F.lit("no_duplicate_ids").alias("check"),
                 (F.col("ids") == F.col("n")).alias("passed"), F.lit("").alias("details")),
        F.struct(F.lit("required_fields").alias("check"), F.lit(complete).alias("passed"),
                 F.lit("").alias("details")),
        F.struct(F.lit("category_not_null").alias("check"),
                 (F.col("nulls") == 0).alias("passed"),
                 F.concat(F.lit("Null: "), F.col("nulls").cast("string")).alias("details")),
    )
    return facts.select(F.inline(rows))


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def enforce(checks: DataFrame, on_fail: str = "warn") -> list[str]:
    """Names of the failed checks; with ``on_fail="raise"`` they stop the job."""
    if on_fail not in ("warn", "raise"):
        raise ValueError(f"on_fail must be warn or raise, not {on_fail}")
    failed = sorted(r.check for r in checks.filter(~F.col("passed")).collect())
    if failed and on_fail == "raise":
        raise ValueError("failed checks: " + ", ".join(failed))
    return failed


def with_input_defaults(df: DataFrame) -> DataFrame:
    """Defaults of the input contract, text length included."""
    df = with_columns(df, [*INPUT_DEFAULTS, "ticket_text_length", "subject", "description"])
    return df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in INPUT_DEFAULTS.items()},
        "ticket_text_length": F.coalesce("ticket_text_length", F.length("description")),
    })


def input_contract(df: DataFrame) -> DataFrame:
    """Add ``reasons``: why a row breaks the contract; empty for a valid row."""
    def text_rule(col: str, longest: int):
        size = F.length(col)
        return (
            F.when(F.col(col).isNull(), f"{col} missing")
            .when(size < 1, f"{col} empty")
            .when(size > longest, f"{col} too long")
        )

    return with_input_defaults(df).withColumn(
        "reasons",
        F.array_compact(F.array(text_rule("subject", 500), text_rule("description", 10000))),
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons)."""
    checked = input_contract(df)
    ok = F.size("reasons") == 0
    return checked.filter(ok).drop("reasons"), checked.filter(~ok)


def ingest_summary(df: DataFrame) -> DataFrame:
    """Rows in total, per split and per category.

    The rows are counted once per (split, category); the grouping sets then run over
    that small table, so the data itself is not expanded.
    """
    counts = df.groupBy("data_split", "category").agg(F.count("*").alias("n"))
    sets = counts.groupingSets(
        [["data_split"], ["category"], []], "data_split", "category"
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 1, "split").when(F.col("gid") == 2, "category").otherwise("total")
    name = F.when(F.col("gid") == 1, F.col("data_split")).when(F.col("gid") == 2, F.col("category"))
    return sets.select(kind.alias("kind"), name.alias("name"), "n")
