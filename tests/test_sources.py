import pytest
from pyspark.sql import functions as F

from inkblot import scan, scrub, vault_table
from inkblot.operators.structured import scrub_table
from inkblot.plans import queries
from inkblot.sources.files import assemble_pages, read_csv_rows, read_documents
from inkblot.sources.sinks import write_findings, write_scrubbed
from inkblot.streaming.streams import read_risk, risk_by_window, scrub_stream, write_risk
from tests.test_functions import odd_texts


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9 \ufffd\r\nx\ry".encode() + b"\xff\xe9z")
    (tmp_path / "b.PY").write_bytes("key = 'é'\r\n".encode())
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "café \ufffd\nx\nyz" and rows["a.txt"].kind == "DOC" and rows["a.txt"].error is None
    assert rows["b.PY"].text == "key = 'é'\n" and rows["b.PY"].kind == "CODE"
    strict = {r.path.rsplit("/", 1)[1]: r for r in read_documents(spark, str(tmp_path), strict=True).collect()}
    assert strict["a.txt"].text is None and strict["a.txt"].error and strict["b.PY"].error is None


def test_text_that_begins_with_error_is_a_text(spark, tmp_path):
    (tmp_path / "e.log").write_text("Error at 10.0.0.1")
    assert scrub(read_documents(spark, str(tmp_path))).first().text == "Error at <IPV4_1>"


def test_assemble_pages(spark):
    pages = [(d, p, f"{d}:{p}" if p % 5 else None) for d in (1, 2) for p in range(700 if d == 1 else 3)]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string").repartition(4)
    got = {r.doc_id: r.text for r in assemble_pages(df).collect()}
    assert got == {d: "\n".join(t or "" for e, _, t in pages if e == d) for d in (1, 2)}


@pytest.mark.parametrize("multiline", [True, False])
def test_csv_files_are_documents_of_their_own(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text("10.0.0.1,h\n" + "".join(f"10.0.{i // 200}.{i % 200},x{i}\n" for i in range(500)))
    (tmp_path / "b.csv").write_text('10.9.9.9,"q ""x"", user=u"\n')
    rows = read_csv_rows(spark, str(tmp_path), multiline)
    done = scrub_table(rows, ["_c0", "_c1"], "_order", F.col("_part"), "_path").orderBy("_path", "_order").collect()
    assert [r._c0 for r in done if r._path.endswith("a.csv")] == [f"<IPV4_{k}>" for k in range(1, 502)]
    assert [(r._c0, r._c1) for r in done if r._path.endswith("b.csv")] == [("<IPV4_1>", 'q "x", user=<USERNAME_1>')]


@pytest.mark.parametrize("multiline", [True, False])
def test_csv_rows_keep_all_they_have(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text('h1,h2\n10.0.0.1,b,10.0.0.2\n\n,"",z\nx\n')
    rows = read_csv_rows(spark, str(tmp_path / "a.csv"), multiline)
    done = scrub_table(rows, ["_c0", "_c1", "_c2"], "_order", F.col("_part"), "_path").orderBy("_order").collect()
    assert [(r._c0, r._c1, r._c2) for r in done] == [("h1", "h2", None), ("<IPV4_1>", "b", "<IPV4_2>"), (None, None, None), ("", "", "z"), ("x", None, None)]


@pytest.mark.parametrize("multiline", [True, False])
def test_csv_cells_of_any_length(spark, tmp_path, multiline):
    long = "x" * 1_000_000
    (tmp_path / "a.csv").write_text(f'h,{long}\n10.0.0.1,"{long}, y"\nb,"open {long}\n')
    rows = read_csv_rows(spark, str(tmp_path / "a.csv"), multiline).orderBy("_order").collect()
    end = "\n" if multiline else ""
    assert [(r._c0, r._c1) for r in rows] == [("h", long), ("10.0.0.1", f"{long}, y"), ("b", f"open {long}{end}")]


def test_files_have_ids_of_their_own(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text("same")
    ids = [r.doc_id for r in read_documents(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 5 and all(len(i) == 32 for i in ids)


def test_risk_of_every_window(spark, texts, tmp_path):
    rows = [(i, f"2024-01-01 {i // 4:02d}:{i % 4 * 15:02d}:00", "10.0.0.1") for i in range(96)]
    spark.createDataFrame(rows, "doc_id int, ts string, text string").selectExpr("doc_id", "cast(ts as timestamp) ts", "text").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_risk(risk_by_window(stream, "ts", late="2 days"), str(tmp_path / "out")).awaitTermination()
    got = read_risk(spark, str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n_records) for r in got] == [(h, 4) for h in range(24)]


def test_sinks(spark, texts, tmp_path):
    done = scrub(texts(["10.0.0.1", "plain"]))
    with pytest.raises(ValueError):
        write_scrubbed(done, str(tmp_path / "t"), str(tmp_path / "t/vault"))
    write_scrubbed(done, str(tmp_path / "t"), str(tmp_path / "v"))
    write_findings(scan(texts(["10.0.0.1"])), str(tmp_path / "f"))
    assert sorted(spark.read.parquet(str(tmp_path / "t")).columns) == ["doc_id", "engine", "text"]
    assert spark.read.parquet(str(tmp_path / "v")).first().original == "10.0.0.1"
    assert spark.read.json(str(tmp_path / "f")).count() == 2


def test_stream_equals_batch(spark, texts, tmp_path):
    docs = texts(odd_texts(200, 17, 20))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scrub_stream(stream, str(tmp_path / "out"), str(tmp_path / "vault")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3
    done = scrub(docs)
    assert sorted(map(tuple, got.select("doc_id", "text").collect())) == sorted(map(tuple, done.select("doc_id", "text").collect()))
    vault = spark.read.parquet(str(tmp_path / "vault")).select("doc_id", "placeholder", "original")
    assert sorted(map(tuple, vault.collect())) == sorted(map(tuple, vault_table(done).select("doc_id", "placeholder", "original").collect()))


def test_streams_of_a_table_in_several_files(spark, texts, tmp_path):
    texts(["from 10.0.0.1", "user=bob", None]).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries.query_stream_scrub(spark, str(tmp_path)).collect()}
    assert got == {0: "from <IPV4_1>", 1: "user=<USERNAME_1>", 2: None}


def test_files_of_keys_that_repeat(spark, tmp_path):
    """Rows of one key stay in one file, in the order of the table, whichever task writes it."""
    rows = [(i % 40, f"S{i}") for i in range(120)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_suppkey: r.text for r in queries.query_read_files(spark, str(tmp_path)).collect()}
    assert len(got) == 40
    assert all([line.split(" of ")[0] for line in got[k].split("\n") if " of " in line] == [f"S{i}" for i in range(k, 120, 40)] for k in got)


def test_a_vault_that_is_read_twice_is_made_once(spark, tmp_path):
    spark.createDataFrame([(7, "Customer#7", "BUILDING")], "c_custkey bigint, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    df = queries.query_restore_dup(spark, str(tmp_path))
    assert "sk_live_" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = queries.logs(spark, str(tmp_path)).collect()
    assert df.collect() == want
