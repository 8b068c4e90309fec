"""Findings as rows, in islands and blocks, beside the row expressions."""

import random

import pytest
from pyspark.sql import functions as F

from inkblot.operators.islands import island_rows, number_islands, resolve_islands, scrub_islands, with_islands
from inkblot.operators.resolve import number, resolve
from inkblot.plans.scrub import scan, scrub

ODD = [
    "", None, "no findings at all", "10.0.0.1", "x 10.0.0.1 y 10.0.0.2 z", "é10.0.0.1ü 😀 user=bob 12345 a@b.example.com" * 3,
    "user: a.b@c.example.org token=abc-def sk_live_abc Bearer x.y 10.1.2.3" * 40, "12345 Main Street Suite 12 10.0.0.1", "1.1.1.1" * 200,
    "a@b.example.com" + "é" * 300 + "10.0.0.1",
]


@pytest.mark.parametrize("kind,block", [("DOC", 16), ("CODE", 200)])
def test_scrub_islands_equals_scrub(texts, kind, block):
    docs = texts(ODD).repartition(3)
    want = {r.doc_id: (r.text, r.kind, r.engine, [(p.start, p.end, p.label, p.n, p.placeholder, p.original) for p in r.placed]) for r in scrub(docs, kind=kind).collect()}
    done, placed = scrub_islands(docs, kind=kind, block=block)
    spans = {}
    ids = {r["_row"]: r.doc_id for r in done.collect()}
    for p in placed.orderBy("_row", "start").collect():
        spans.setdefault(ids[p["_row"]], []).append((p.start, p.end, p.label, p.n, p.placeholder, p.snippet))
    assert {r.doc_id: (r.text, r.kind, r.engine, spans.get(r.doc_id, [])) for r in done.collect()} == want


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "10.0.0.1 a"), (None, "b 10.0.0.2 10.0.0.3"), (1, "10.0.0.1 a"), (1, "x"), (1, None)], "doc_id bigint, text string")
    done, _ = scrub_islands(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in done.collect()) == [(0, "<IPV4_1> a"), (0, "b <IPV4_2> <IPV4_1>"), (1, ""), (1, "<IPV4_1> a"), (1, "x")]


def test_empty_table(texts):
    done, placed = scrub_islands(texts([]))
    assert done.collect() == [] and placed.collect() == []


def made_up(rng, n, reach):
    """Findings as a scan lists them, at random places, many of them over others."""
    rows = []
    for i in range(n):
        start = rng.randrange(reach)
        end = start + rng.choice([1, 2, 5, 9, 40])
        rows.append((-start, -rng.randrange(3), i % 7, i, start, end, start, end, rng.choice("AB"), "s", "pattern", 1, 1))
    return rows


FIELDS = ("from_end", "rank", "ordinal", "sub", "start", "end", "bstart", "bend", "label", "snippet", "detector", "weight", "copies")


@pytest.mark.parametrize("block", [7, 100])
def test_islands_of_random_findings(spark, block):
    rng = random.Random(block)
    rows = [(d, *f) for d in range(12) for f in made_up(rng, rng.randrange(1, 60), 300)] + [(None, *f) for f in made_up(rng, 30, 200)]
    found = spark.createDataFrame(rows, "doc bigint, " + ", ".join(f"{c} {'string' if c in ('label', 'snippet', 'detector') else 'int'}" for c in FIELDS))
    for r in with_islands(found, ["doc"], block).groupBy("doc", "island").agg(F.min("start").alias("a"), F.max("end").alias("b")).orderBy("doc", "a").collect():
        assert r.island == r.a
    got = number_islands(resolve_islands(found, ["doc"], block), ["doc"], block)
    struct = F.struct(*FIELDS)
    grouped = found.groupBy("doc").agg(F.sort_array(F.collect_list(struct)).alias("fs"))
    placed = number(F.array(resolve(F.col("fs"))))
    want = grouped.select("doc", F.explode(placed).alias("p")).select("doc", "p.start", "p.end", "p.label", "p.n", "p.placeholder")
    pick = lambda df: sorted((r.doc is None, r.doc or 0, r.start, r.end, r.label, r.n, r.placeholder) for r in df.collect())
    assert pick(got) == pick(want)


def test_a_document_of_very_many_findings(spark):
    n = 60_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("10.0."), (i % 250).cast("string"), F.lit(".1 é"))), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    done, placed = scrub_islands(docs)
    want = scrub(docs, kind="DOC").select(F.sha2("text", 256).alias("h"), F.size("placed").alias("n")).first()
    assert (done.select(F.sha2("text", 256)).first()[0], placed.count()) == (want.h, want.n) and want.n == n


def test_only_small_rows_run_over_blocks(texts):
    """No array or window is by document alone, but for one row a block and for the pieces of a text."""
    found = island_rows(scan(texts(ODD), kind="DOC"), ["doc_id"])
    plan = resolve_islands(found, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "ArrowEval" not in plan and "Python" not in plan
