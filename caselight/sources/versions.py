"""Tables replaced as a whole and model versions, so that readers never see a half of either.

A new version of a set of tables is written into a folder of its own; only then does a row of
the manifest name it, and a reader opens the folder of the newest row. A writer that fails leaves
files that no row names, and readers go on with the version before.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselight.operators.scale import top_n_per_group

_MANIFEST = "version long, folder string, published_at timestamp"
_MODELS = "model_name string, version string, metrics map<string,double>, trained_at timestamp, activated_at timestamp, recorded_at timestamp"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest version; of versions with the same number, written by two jobs
    at once, the one published last."""
    newest = _read(spark, f"{base}/manifest", _MANIFEST).orderBy(F.desc("version"), F.desc("published_at"), F.desc("folder"))
    row = newest.first()  # a row per version
    return row and row["folder"]


def replace_tables(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> str:
    """Write ``tables`` by name as the next version and publish it; its folder.

    Input may come from the version before: that is left as it is.
    """
    folder = f"{base}/versions/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    last = _read(spark, f"{base}/manifest", _MANIFEST).agg(F.max("version")).first()[0]
    row = spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at"))
    row.write.mode("append").parquet(f"{base}/manifest")
    return folder


def read_tables(spark: SparkSession, base: str, names: list[str]) -> list[DataFrame]:
    """The named tables, all of the same version."""
    folder = current(spark, base)
    if folder is None:
        raise ValueError(f"nothing has been published below {base}")
    return [spark.read.parquet(f"{folder}/{name}") for name in names]


def record_models(models: DataFrame, path: str, activate: bool = True) -> None:
    """Append model versions (model_name, version, trained_at and optionally metrics); with
    ``activate`` they become the active ones. Recording a version again activates it anew."""
    metrics = F.col("metrics") if "metrics" in models.columns else F.lit(None)
    now = F.current_timestamp()
    models.select(
        "model_name", "version", metrics.cast("map<string,double>").alias("metrics"), F.col("trained_at").cast("timestamp").alias("trained_at"),
        F.when(F.lit(activate), now).alias("activated_at"), now.alias("recorded_at"),
    ).write.mode("append").parquet(path)


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per model and version: its last recorded facts and ``is_active``.

    Active is, per model, the version activated last; of several at once the one trained last.
    """
    rows = _read(spark, path, _MODELS)
    keys = ["model_name", "version"]
    facts = rows.groupBy(*keys).agg(
        F.max_by(F.struct("metrics", "trained_at"), "recorded_at").alias("last"), F.max("activated_at").alias("activated_at"))
    facts = facts.select(*keys, "last.*", "activated_at")
    order = [F.desc_nulls_last("activated_at"), F.desc("trained_at"), F.desc("version")]
    first = top_n_per_group(facts.filter(F.col("activated_at").isNotNull()), ["model_name"], order, 1)
    active = first.select(F.col("model_name").alias("m"), F.col("version").alias("v"))
    joined = facts.join(active, F.col("model_name").eqNullSafe(F.col("m")) & F.col("version").eqNullSafe(F.col("v")), "left")
    return joined.select(*facts.columns, F.col("v").isNotNull().alias("is_active"))
