"""Writing results of any of the scrubs: texts and vault always apart, and published together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkblot.operators.findings import findings_table
from inkblot.plans.scrub import vault_table
from inkblot.session import stored


def _apart(path: str, vault_path: str | None) -> None:
    if vault_path is not None and f"{vault_path.rstrip('/')}/".startswith(path.rstrip("/") + "/"):
        raise ValueError("the vault must not be kept below the scrubbed texts")


def write_scrubbed(scrubbed: DataFrame, path: str, vault_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``id, text, engine`` to ``path`` and, only if a place is given, the vault to that place.

    With a vault, what was detected is stored in scratch first, originals included, so that both come from it.
    """
    _apart(path, vault_path)
    if vault_path is not None:
        scrubbed = stored(scrubbed.select(id_col, text_col, "engine", "placed"), "scrubbed")
        vault_table(scrubbed, id_col).write.mode("overwrite").parquet(vault_path)
    scrubbed.select(id_col, text_col, "engine").write.mode("overwrite").parquet(path)


def publish_scrubbed(
    scrubbed: DataFrame, path: str, vault_path: str, run: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Add texts and vault of one run so that readers see both or neither; returns the name of the run.

    What was detected is written once, below ``vault_path``; the texts are taken from there. A run counts
    when its name stands in the manifest, which is written last. One that ended before leaves files that no
    reader looks at, and one that is done again under its name replaces them.
    """
    _apart(path, vault_path)
    spark = scrubbed.sparkSession
    run = run or uuid.uuid4().hex
    held = scrubbed.select(F.col(id_col), F.col(text_col), "engine", "placed")
    at = f"{vault_path}/runs/run={run}"
    held.write.mode("overwrite").parquet(at)
    texts = spark.read.schema(held.schema).parquet(at).select(id_col, text_col, "engine")
    texts.write.mode("overwrite").parquet(f"{path}/runs/run={run}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return run


def _published(spark: SparkSession, path: str, rows_at: str) -> DataFrame:
    runs = spark.read.schema("run string").json(f"{path}/manifest").distinct()
    rows = spark.read.option("basePath", f"{rows_at}/runs").parquet(f"{rows_at}/runs")
    # a name for each run; partitions of runs that are not in the list are not read
    return rows.withColumn("run", F.col("run").cast("string")).join(F.broadcast(runs), "run", "left_semi").drop("run")


def published_texts(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, engine`` of all runs that were published."""
    return _published(spark, path, path)


def published_vault(spark: SparkSession, path: str, vault_path: str, id_col: str = "doc_id") -> DataFrame:
    """The vault of all runs that were published: ``id, placeholder, label, n, original``."""
    return vault_table(_published(spark, path, vault_path).select(id_col, "placed"), id_col)


def write_findings(scanned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    findings_table(scanned, id_col).write.mode("overwrite").json(path)
