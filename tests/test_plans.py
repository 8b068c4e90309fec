"""What the plans must and must not contain, and that the registry is whole."""

from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from inkblot import scan, scrub, vault_table
from inkblot.operators.findings import findings_table
from inkblot.operators.restore import restore
from inkblot.operators.risk import risk
from inkblot.operators.structured import scrub_table
from inkblot.plans import oracles, queries
from inkblot.session import spread

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_work_does_not_shuffle(spark, texts):
    docs = texts(["10.0.0.1"])
    for df in (scrub(docs), risk(scan(docs)), findings_table(scan(docs)), vault_table(scrub(docs))):
        assert "Exchange" not in plan(df)


def test_findings_are_detected_once(spark, texts):
    """A rule's pattern tests and cuts, and again for texts with NULs: four uses for one detection."""
    for df in (findings_table(scan(texts(["x"]))), vault_table(scrub(texts(["x"]))), scrub(texts(["x"])), risk(scan(texts(["x"])))):
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("sk_live_[0-9a-zA-Z]+") == 4
    # a table is detected before its plan is returned, and read from there for counts and rows
    table = scrub_table(texts(["x"]), ["text"], "doc_id", F.lit(0))
    assert "sk_live_" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_only_needed_columns_are_read(spark):
    df = spark_entry.queries()["scrub_text"](spark, SF)
    assert "struct<doc_id:bigint,text:string>" in plan(df)


def test_entry_and_registry(spark):
    rows = spark_entry.entry(spark).collect()
    assert len(rows) == 200
    assert set(oracles.oracle_sql()) == set(queries.queries())
    assert set(queries.queries()) <= set(spark_entry.queries()) and set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_one_row_group(spark, tmp_path):
    """A file of one row group has many splits, of which one has all rows: it is dealt out all the same."""
    at = str(tmp_path / "one")
    spark.range(4000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text").coalesce(1).write.parquet(at)
    small = {"spark.sql.files.maxPartitionBytes": "8000", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        docs = spark.read.parquet(at)
        assert docs.rdd.getNumPartitions() >= 8
        dealt = spread(docs, "doc_id")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1000
        even = spark.range(4000).repartition(16)
        assert spread(even) is even
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_restore_gathers_behind_the_shuffle(spark, texts):
    """Vault rows are sorted in shares of a shuffle, not split by split."""
    done = scrub(texts(["10.0.0.1 and 10.0.0.2", None, "10.0.0.3"]), kind="DOC").select("doc_id", "text", "placed")
    lines = plan(restore(done.select("doc_id", "text"), vault_table(done))).splitlines()
    (at,) = [i for i, line in enumerate(lines) if "partial_min" in line]
    below = [line.lstrip(" :+-") for line in lines[at + 1 :]]
    assert next(line for line in below if "Aggregate" in line or "Exchange" in line or "Scan" in line).startswith("Exchange")
