"""Publishing texts and vault together, restoring streams, models, lists on both sides of the plan's limit."""

import pytest
from pyspark.sql import functions as F

from inkblot import ScanConfig, scan, scrub
from inkblot.operators.findings import findings_table
from inkblot.operators.models import EntityModel
from inkblot.operators.names import name_spans
from inkblot.operators.restore import restore
from inkblot.plans.scrub import vault_table
from inkblot.sources import sinks
from inkblot.sources.sinks import publish_scrubbed, published_texts, published_vault
from inkblot.streaming.streams import read_restored, restore_stream

TEXTS = ["from 10.0.0.1 to 10.0.0.2", "nothing", None, "user=bob <IPV4_1> é", "a@b.example.com 12345"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_a_run_that_ends_between_the_writes_is_not_seen(texts, tmp_path, monkeypatch):
    at, vault_at = str(tmp_path / "t"), str(tmp_path / "v")
    done = scrub(texts(TEXTS))
    publish_scrubbed(done, at, vault_at, "one")
    want = rows(published_texts(done.sparkSession, at), "doc_id", "text"), rows(published_vault(done.sparkSession, at, vault_at), "doc_id", "placeholder", "original")
    assert len(want[0]) == 5 and len(want[1]) == 5
    later = scrub(texts(["10.1.1.1"]))
    written = []

    def failing(writer, path, *args, **kwargs):
        written.append(path)
        if len(written) == 2:
            raise OSError("lost")
        return real(writer, path, *args, **kwargs)

    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        publish_scrubbed(later, at, vault_at, "two")
    monkeypatch.undo()
    assert len(written) == 2 and "run=two" in written[0]
    spark = done.sparkSession
    assert (rows(published_texts(spark, at), "doc_id", "text"), rows(published_vault(spark, at, vault_at), "doc_id", "placeholder", "original")) == want
    publish_scrubbed(later, at, vault_at, "two")  # done again under its name
    publish_scrubbed(later, at, vault_at, "two")
    assert len(rows(published_texts(spark, at), "doc_id")) == 6 and len(rows(published_vault(spark, at, vault_at), "doc_id")) == 6
    with pytest.raises(ValueError):
        publish_scrubbed(later, at, f"{at}/vault")


def test_what_is_written_with_a_vault_is_detected_once(texts, tmp_path, monkeypatch):
    plans = []
    real = sinks.vault_table
    monkeypatch.setattr(sinks, "vault_table", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    sinks.write_scrubbed(scrub(texts(TEXTS)), str(tmp_path / "t"), str(tmp_path / "v"))
    assert plans and "sk_live_" not in plans[0]


def test_a_restored_stream_waits_for_its_vault(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    done = scrub(docs)
    vault = vault_table(done)
    texts_at = str(tmp_path / "texts")
    known = []
    for i, ids in enumerate(((0, 1), (2, 3), (4,))):
        done.where(F.col("doc_id").isin(*ids)).select("doc_id", "text").coalesce(1).write.mode("append").parquet(texts_at)
    source = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(texts_at)

    def late_vault():  # grows by a document each time it is read, and never has what stands in document 3 itself
        known.append(len(known))
        return vault.where(F.col("doc_id") < len(known) - 1)

    out, waiting = str(tmp_path / "out"), str(tmp_path / "waiting")
    restore_stream(source, late_vault, out, waiting, patience=50).awaitTermination()
    got = read_restored(spark, lambda: vault, source.schema, out, waiting)
    assert rows(got, "doc_id", "text") == rows(restore(done.select("doc_id", "text"), vault), "doc_id", "text")
    short, shorter = str(tmp_path / "out2"), str(tmp_path / "waiting2")
    restore_stream(source, lambda: vault.where("false"), short, shorter, patience=0).awaitTermination()
    assert rows(spark.read.parquet(short), "doc_id", "text") == rows(done, "doc_id", "text")


def load_model():
    def predict(texts):
        return [[(0, 3, "PERSON"), (0, 3, "PERSON"), (2, 2, "PERSON"), (-1, 2, "ORG"), (1, 99, "ORG"), (1, 2, "NEW"), (4, 6, "ORG")] for _ in texts]

    return predict


def test_spans_of_a_model(texts):
    config = ScanConfig(model=EntityModel(load_model, ("PERSON", "ORG")))
    found = findings_table(scan(texts(["é😀a bc 10.0.0.1", "", None, "Bob", "x_1 yy"]), config, "DOC"))
    got = {(r.doc_id, r.start, r.end, r.label, r.snippet, r.detector) for r in found.collect()}
    assert got == {
        (0, 0, 3, "PERSON", "é😀a", "model"), (0, 4, 6, "ORG", "bc", "model"), (0, 7, 15, "IPV4", "10.0.0.1", "pattern"), (0, 7, 15, "IP_ADDRESS", "10.0.0.1", "entity"),
        (3, 0, 3, "PERSON", "Bob", "model"), (4, 0, 3, "PERSON", "x_1", "model"), (4, 4, 6, "ORG", "yy", "model"),
    }
    assert "x_1" not in {r.snippet for r in findings_table(scan(texts(["x_1 yy"]), config, "CODE")).collect()}
    (r,) = scrub(texts(["é😀a bc 10.0.0.1"]), config, "DOC").collect()
    assert r.text == "<PERSON_1> <ORG_1> <IPV4_1>"
    with pytest.raises(ValueError):
        EntityModel(load_model, ())


LISTED = ["Anna Berg\t", " Bob Tall", "CARL", "de  la Cruz", " ", "", "O'Neil", "Zoë-Ann\n"]


def test_lists_find_the_same_on_both_sides_of_the_limit(spark, texts):
    docs = texts(["Anna Berg met bob tall, Carl and De la\tCruz", "ANNA  BERG; O'Neil: zoë-ann", "anna", "Berg Anna Berg", None, ""])
    inline = ScanConfig(names=tuple((n, "PERSON") for n in LISTED))
    table = spark.createDataFrame([(n, "PERSON") for n in LISTED] + [(f"name{i} x", "PERSON") for i in range(10_001)], "value string, label string")
    shown = lambda config: sorted((r.doc_id, r.start, r.end, r.snippet) for r in findings_table(scan(docs, config, "DOC")).where("label = 'PERSON'").collect())
    assert shown(inline) == shown(ScanConfig.from_tables(names=table)) and len(shown(inline)) == 8


@pytest.mark.parametrize("value", ["10.0.0.1", "a@b.example.com", "bob", "10.0.0.2\t"])
def test_allow_lists_on_both_sides_of_the_limit(spark, texts, value):
    docs = texts(TEXTS)
    many = spark.range(10_001).select(F.concat(F.lit("v"), F.col("id")).alias("value"))
    table = many.union(spark.createDataFrame([(value,)], "value string"))
    shown = lambda config: sorted((r.doc_id, r.start, r.label) for r in findings_table(scan(docs, config, "DOC")).collect())
    assert shown(ScanConfig(ignore=frozenset([value]))) == shown(ScanConfig.from_tables(ignore=table))


def test_only_what_may_be_listed_is_shuffled(spark, texts):
    docs = texts([" ".join(f"word{i} other{i % 7}" for i in range(400)) + " Anna Berg"])
    names = spark.createDataFrame([("Anna Berg", "PERSON"), ("Carl X", "PERSON")], "value string, label string")
    spans = name_spans(docs, names)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and spans.count() == 1
