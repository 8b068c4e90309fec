"""The pipeline against its stages done plainly, and the registered queries."""

import pytest

import corpus_pipeline
from inkblot.llm import mixing, pieces, queries
from tests.llm import plain
from tests.llm.test_models import lang_rows


def test_stages_do_what_plain_counterparts_do(make_docs, spark):
    rows = lang_rows(150)
    long = rows[0][1]
    rows += [(500, long.lower(), "en"), (501, "1 2 3", "en"), (502, None, "fr"), (503, "Zürich " + rows[3][1] + " am See und das Haus mit Wasser " * 3, "de")]
    docs = make_docs(rows, "score")
    steps = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "")
        at = spark.createDataFrame(at.collect(), at.schema)
        steps[name] = at
        if name != "pieces":
            assert at.columns == docs.columns
    kept = {r.doc_id: r.text for r in steps["language"].collect()}
    assert not {501, 502} & set(kept) and len(kept) >= 0.97 * (len(rows) - 2)
    groups = plain.component_ids(kept)
    alone = {r.doc_id: r.text for r in steps["near_duplicates"].collect()}
    assert alone == {i: t for i, t in kept.items() if groups[i] == i} and 500 not in alone
    order = sorted(alone)
    cut = {i: w[1] for i, w in zip(order, plain.without_repeats([alone[i].encode() for i in order]))}
    left = {r.doc_id: r for r in steps["repeats"].collect()}
    assert {i for i in alone if i not in left} == {i for i in alone if cut[i] == len(alone[i].encode())}
    assert all(len(r.text.encode()) == len(alone[i].encode()) - cut[i] and r.n_chars == len(r.text) for i, r in left.items() if i != 503)
    assert cut[503] and len(left[503].text) < len(alone[503])
    want = {r.doc_id: r.copies for r in mixing.mix_report(steps["repeats"]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in steps["mix"].groupBy("doc_id").count().collect()} == want
    last = steps["pieces"]
    assert last.columns == [*docs.columns, "ids", "exact"]
    assert all(r.exact and r.decoded == r.text for r in pieces.decode(last).collect())
    assert last.count() == steps["mix"].count()


def test_pipeline_over_an_empty_table(make_docs, spark):
    at = make_docs(lang_rows(10)).where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, "").collect(), at.schema) if stage is not corpus_pipeline.encoded else stage(spark, at, "")
    assert at.collect() == []


@pytest.mark.parametrize("name", ["op1_ppm", "op3_set_join", "op5_language", "op7_suffixes", "op8_sharding", "op2_quality_rules", "op4_pieces", "op6_mixing"])
def test_queries_return_a_row_for_each_document(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_names():
    names = list(queries.queries())
    assert names[-1] == "pipeline" and [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_pieces_are_made_in_small_batches(make_docs, spark):
    """A batch stands in memory as texts, words and ids."""
    rows = [(i, f"word{i} some text " * 40_000) for i in range(9)]
    coded = pieces.encode(make_docs(rows).repartition(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    assert all(r.exact and r.decoded == r.text for r in pieces.decode(coded).collect())
