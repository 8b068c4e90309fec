"""The same scans and scrubs over streams.

Scrubbing is a projection, so a stream of documents or log records needs no state: each record is
its own document. Only totals over time keep state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from inkblot.operators.restore import restore
from inkblot.operators.risk import count_of, score_of
from inkblot.plans.scrub import scan, scrub, vault_table
from inkblot.rules import ScanConfig
from inkblot.session import scratch_dir, stored


def scrub_stream(
    docs: DataFrame, text_path: str, vault_path: str | None = None, config: ScanConfig | None = None,
    kind: str | None = None, checkpoint: str | None = None, id_col: str = "doc_id", trigger: dict | None = None,
    spread_over: int | None = None,
) -> StreamingQuery:
    """Scrub a stream into ``text_path`` and, if given, its vault into ``vault_path``.

    Each micro-batch writes both under its batch number, so that one that is run again after a
    failure replaces what it wrote before. ``trigger`` is that of ``DataStreamWriter.trigger``; by
    default what is there is worked off, and the query ends. A batch is dealt out over ``spread_over``
    partitions, as many as there are cores if none are given.
    """

    def write(batch: DataFrame, number: int) -> None:
        # a batch of few files has few partitions, whatever the size of its texts
        done = scrub(batch.repartition(spread_over or batch.sparkSession.sparkContext.defaultParallelism), config, kind, id_col=id_col)
        if vault_path is not None:
            done = done.persist()
        try:
            if vault_path is not None:
                vault_table(done, id_col).write.mode("overwrite").parquet(f"{vault_path}/batch={number}")
            done.select(id_col, "text", "engine").write.mode("overwrite").parquet(f"{text_path}/batch={number}")
        finally:
            done.unpersist()

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_dir(docs.sparkSession, "scrub-stream"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def restore_stream(
    scrubbed: DataFrame, vault: Callable[[], DataFrame], out_path: str, waiting_path: str, patience: int = 10,
    checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text", trigger: dict | None = None,
) -> StreamingQuery:
    """Put originals back into a stream of scrubbed texts, as :func:`restore` does for a table.

    Each micro-batch is joined with the vault as it is then (``vault`` reads it). A row with a placeholder that
    the vault does not have yet waits below ``waiting_path`` and is tried again with the next batches, at
    most ``patience`` of them; then it is written with what could be put back. So the state is bounded by the
    rows of that many batches. Both places are written under the number of the batch, and a batch that is run
    again after a failure reads and replaces the same ones. :func:`read_restored` gives all rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("*", F.lit(0).alias("_tries"))
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{waiting_path}/batch={number - 1}"))
        tried = stored(restore(rows.withColumn("_asked", F.col(text_col)), vault(), id_col, text_col, "_open"), "restore-stream")
        waits = F.col("_open") & (F.col("_tries") < patience)
        again = tried.where(waits).withColumn(text_col, F.col("_asked")).withColumn("_tries", F.col("_tries") + 1)
        again.select(*rows.columns).write.mode("overwrite").parquet(f"{waiting_path}/batch={number}")
        tried.where(~waits).select(*batch.columns).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        scrubbed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_dir(scrubbed.sparkSession, "restore-stream"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_restored(
    spark: SparkSession, vault: Callable[[], DataFrame], schema: StructType, out_path: str, waiting_path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """What :func:`restore_stream` wrote, and the rows that still wait, with what the vault has for them by now."""
    held = StructType([*schema.fields, StructField("batch", LongType())])
    done, waiting = spark.read.schema(held).parquet(out_path), spark.read.schema(held).parquet(waiting_path)
    # of the rows that waited, those of the last batch still do; the others were taken up by the next one
    last = done.select("batch").union(waiting.select("batch")).agg(F.max("batch").alias("_last"))
    still = waiting.join(F.broadcast(last), F.col("batch") == F.col("_last")).select(*schema.names)
    return done.select(*schema.names).unionByName(restore(still, vault(), id_col, text_col))


def write_risk(windows: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keep the windows of :func:`risk_by_window` in ``path``: every one that has a record, the last ones too.

    Windows are written each time they change, under the number of the batch; :func:`read_risk` takes the
    newest. A sink that waits for the watermark would hold back the last windows of a stream that ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        windows.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint or scratch_dir(windows.sparkSession, "risk-stream"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_risk(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every window that :func:`write_risk` kept."""
    kept = spark.read.schema("window_start timestamp, n_records bigint, n_findings bigint, score bigint, batch bigint").parquet(path)
    newest = F.max_by(F.struct("n_records", "n_findings", "score"), "batch").alias("w")
    return kept.groupBy("window_start").agg(newest).select("window_start", "w.*")


def risk_by_window(
    records: DataFrame, ts_col: str, config: ScanConfig | None = None, late: str = "10 minutes",
    every: str = "1 hour", kind: str = "DOC", text_col: str = "text",
) -> DataFrame:
    """Findings and score per event-time window; records later than the watermark are dropped."""
    scanned = scan(records, config, kind, text_col)
    at = F.col(ts_col).cast("timestamp").alias(ts_col)
    rated = scanned.select(at, count_of(F.col("findings")).alias("n"), score_of(F.col("findings")).alias("score"))
    return (
        rated.withWatermark(ts_col, late)
        .groupBy(F.window(ts_col, every))
        .agg(F.count("*").alias("n_records"), F.sum("n").alias("n_findings"), F.sum("score").alias("score"))
        .select(F.col("window.start").alias("window_start"), "n_records", "n_findings", "score")
    )
