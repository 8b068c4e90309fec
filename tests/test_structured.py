import json
import re

import pytest
from pyspark.sql import functions as F

from inkblot import ScanConfig
from inkblot.operators.detect import FINDING
from inkblot.operators.findings import findings_table
from inkblot.operators.resolve import FEW, number, resolve
from inkblot.operators.risk import risk
from inkblot.operators.structured import scrub_any, scrub_columns, scrub_structured, scrub_table
from inkblot.sources.sinks import write_scrubbed
from tests import brute

CASES = [
    ("json", '{"a":["10.0.0.1",{"k":5}],"10.0.0.2":"x"}'), ("json", '"user=a"'), ("json", "[1, null, true, 1.5]"),
    ("json", '{"x": "10.0.0.1 and \\u00e9 10.0.0.2", "y": "10.0.0.3"}'), ("json", "{10.0.0.1"), ("json", ""),
    ("csv", "10.0.0.1,b\r\n\"x, user=u\",12345\r\n"), ("csv", 'a,"line\n10.0.0.1 ""q"""\n\nz'), ("csv", "x" * 140_000 + " 10.0.0.1"),
    ("xml", '<r a="10.0.0.1"><b>10.0.0.2</b>tail 10.0.0.3</r>'), ("xml", "<r><!-- 10.0.0.9 -->10.0.0.1</r>"), ("xml", "<r>10.0.0.1"),
    ("txt", "10.0.0.1 {"), ("", "user=a"),
]


def by_hand(fmt, text):
    counters, vault = {}, {}

    def one(value):
        return brute.scrub(value, brute.doc_scan(value), counters, vault)

    try:
        return brute.scrub_format(fmt, text, one), vault
    except Exception:
        return one(text), vault


def test_formats(spark):
    docs = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(CASES)], "doc_id int, fmt string, text string")
    rows = {r.doc_id: r for r in scrub_structured(docs).collect()}
    for i, (fmt, text) in enumerate(CASES):
        want, vault = by_hand(fmt, text)
        assert rows[i].text == want, (fmt, text[:100])
        assert {p.placeholder: p.original for p in rows[i].placed} == vault
    assert [rows[i].fallback for i in range(len(CASES))] == [i in (4, 5, 8, 11) for i in range(len(CASES))]


def test_format_by_path_and_null_text(spark):
    docs = spark.createDataFrame([(0, "a.json", '{"k": "10.0.0.1"}'), (1, "b.yaml", "k: 10.0.0.1"), (2, "c.json", None)], "doc_id int, path string, text string")
    rows = {r.doc_id: r.text for r in scrub_structured(docs).collect()}
    assert json.loads(rows[0]) == {"k": "<IPV4_1>"} and rows[1] == "k: <IPV4_1>" and rows[2] is None


def test_columns(spark):
    schema = "id int, s string, n struct<a:array<struct<x:string,k:int>>,m:map<string,array<string>>,d:date>, e array<string>"
    rows = [
        (1, "10.0.0.1", ([("10.0.0.2", 5), (None, 6)], {"10.0.0.9": ["10.0.0.3", "ok"]}, None), []),
        (2, None, None, ["user=a", None, "user=b"]),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in scrub_columns(df, ["s", "n", "e"]).collect()}
    assert got[1].s == "<IPV4_1>" and [(x.x, x.k) for x in got[1].n.a] == [("<IPV4_2>", 5), (None, 6)]
    assert got[1].n.m == {"10.0.0.9": ["<IPV4_3>", "ok"]}
    assert got[2].s is None and got[2].n is None and got[2].e == ["user=<USERNAME_1>", None, "user=<USERNAME_2>"]
    assert scrub_columns(df, ["s", "n", "e"]).select("s", "n", "e").schema.simpleString() == df.select("s", "n", "e").schema.simpleString()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_a_table_as_one_document(spark, block):
    rows = [(i, f"10.0.0.{i} 10.1.0.{i}" if i % 3 else None, f"user=u{i}" if i % 2 else "10.2.0.1") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(5)
    done = scrub_table(df, ["a", "b"], "i", F.floor(F.col("i") / block)).select("i", "a", "b")
    counters = {}
    want = [tuple([i] + [None if v is None else brute.scrub(v, brute.doc_scan(v), counters, {}) for v in (a, b)]) for i, a, b in rows]
    assert sorted(map(tuple, done.collect())) == want


def test_scopes_number_apart(spark):
    rows = [(i, "big" if i % 3 else f"s{i}", f"10.0.0.{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, file string, a string")
    done = scrub_table(df, ["a"], "i", F.floor(F.col("i") / 10), "file").orderBy("i").collect()
    big = [r.a for r in done if r.file == "big"]
    assert big == [f"<IPV4_{k}>" for k in range(1, len(big) + 1)]
    assert all(r.a == "<IPV4_1>" for r in done if r.file != "big")


def test_one_dispatch_for_all_formats(spark, tmp_path):
    rows = [
        (0, "/x/a.py", "password = 'hunter2 x'\nprint('hunter2 x')"), (1, "/x/a.json", '{"10.0.0.1": "10.0.0.2"}'), (2, "/x/b.csv", "10.0.0.1,x\n"),
        (3, "/x/c.xml", "<a b='10.0.0.1'/>"), (4, "/x/d.txt", "10.0.0.1"), (5, "/x/e.json", "{10.0.0.1"), (6, "/x/f.txt", None),
    ]
    done = scrub_any(spark.createDataFrame(rows, "doc_id int, path string, text string"))
    got = {r.doc_id: (r.text, r.engine) for r in done.collect()}
    assert got == {
        0: ("password = '<SECRET_VAR_ASSIGNMENT_2>'\nprint('<SECRET_VAR_ASSIGNMENT_1>')", "CODE"), 1: ('{\n  "10.0.0.1": "<IPV4_1>"\n}', "DOC"),
        2: ("<IPV4_1>,x\r\n", "DOC"), 3: ('<a b="<IPV4_1>" />'.replace("<IPV4_1>", "&lt;IPV4_1&gt;"), "DOC"), 4: ("<IPV4_1>", "DOC"),
        5: ("{<IPV4_1>", "DOC"), 6: (None, "DOC"),
    }
    found = [(r.doc_id, r.leaf, r.start, r.label) for r in findings_table(done).orderBy("doc_id", "ord").collect()]
    assert found[:2] == [(0, 0, 30, "SECRET_VAR_ASSIGNMENT"), (0, 0, 12, "SECRET_VAR_ASSIGNMENT")]
    assert (1, 0, 0, "IPV4") in found and (2, 0, 0, "IPV4") in found
    assert {r.doc_id: r.n_findings for r in risk(done).collect()}[0] == 2
    write_scrubbed(done, str(tmp_path / "t"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7
    assert {r.original for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"hunter2 x", "10.0.0.1", "10.0.0.2"}


def test_leaves_are_told_apart(spark):
    docs = spark.createDataFrame([(0, "csv", "a,10.0.0.1\n10.0.0.2,b\n")], "doc_id int, fmt string, text string")
    found = findings_table(scrub_structured(docs)).where("label = 'IPV4'").orderBy("ord").collect()
    assert [(r.leaf, r.start, r.snippet) for r in found] == [(1, 0, "10.0.0.1"), (2, 0, "10.0.0.2")]


def test_wide_rows(spark):
    """Two hundred fields and as many columns: the work grows with their number, not faster."""
    inner = F.struct(*(F.concat(F.lit(f"10.0.{i}."), F.col("id").cast("string")).alias(f"f{i}") for i in range(100)))
    df = spark.range(50).select("id", inner.alias("s"), *(F.lit(f"user=u{i}").alias(f"c{i}") for i in range(100)))
    done = scrub_columns(df, ["s"] + [f"c{i}" for i in range(100)])
    optimized = done._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("sk_live_[0-9a-zA-Z]+") == 4
    row = done.where("id = 7").first()
    assert [row.s[i] for i in range(100)] == [f"<IPV4_{i + 1}>" for i in range(100)]
    assert [row[f"c{i}"] for i in range(100)] == [f"user=<USERNAME_{i + 1}>" for i in range(100)]


def test_long_lists_reach_every_leaf(spark, tmp_path):
    """With lists of more than 10,000 entries, leaves, columns and tables are scrubbed as with short ones."""
    names, allow = [("Robin Doe", "PERSON"), ("Kim", "PERSON"), ("New York", "LOCATION")], ["10.0.0.1"]
    few = ScanConfig(ignore=frozenset(allow), names=tuple(names))
    many = ScanConfig(ignore=frozenset([*allow, *(f"v{i}" for i in range(10_000))]), names=(*names, *((f"Nobody{i}", "PERSON") for i in range(10_000))))
    rows = [
        (1, "/x/a.json", '{"a": ["Robin Doe", null, "10.0.0.1"], "b": {"c": "by Kim at 10.0.0.2 in New York"}}'), (1, "/x/b.csv", "Kim,x\n10.0.0.1,Robin Doe and Kim\n"),
        (None, "/x/c.xml", "<a b='Kim'>New York</a>"), (None, "/x/d.txt", "Robin Doe 10.0.0.1 Kim"), (2, "/x/e.py", "x = 'Robin Doe'\npassword = 'hunter2 x'"),
        (2, "/x/f.json", "{Kim"), (3, "/x/g.txt", None), (3, "/x/h.json", "[]"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, path string, text string")
    columns = ["path", "text", "engine", "findings", "finding_leaves", "placed"]
    want, got = (sorted(map(repr, scrub_any(docs, c).select(columns).collect())) for c in (few, many))
    assert got == want
    assert not any(n in str([r.text for r in scrub_any(docs, many).collect()]) for n in ("Robin", "Kim", "York"))
    nested = spark.createDataFrame([(1, "Kim", (["Robin Doe", None, "10.0.0.1"], "x")), (1, None, (None, "New York"))], "id int, kind string, n struct<a:array<string>,b:string>")
    want, got = (sorted(map(repr, scrub_columns(nested, ["kind", "n"], c).collect())) for c in (few, many))
    assert got == want and "Kim" not in [r.kind for r in scrub_columns(nested, ["kind", "n"], many).collect()]
    lines = spark.createDataFrame([(i, "Kim" if i % 2 else "10.0.0.1", f"Robin Doe {i}") for i in range(20)], "i int, a string, b string")
    want, got = (sorted(map(repr, scrub_table(lines, ["a", "b"], "i", F.floor(F.col("i") / 7), None, c).collect())) for c in (few, many))
    assert got == want and "<PERSON_30>" in str(got)


def test_numbers_of_few_and_many_findings(spark):
    """Counted one by one or sorted by label, on both sides of the limit: the same numbers."""
    for n in (1, FEW, FEW + 1, 300):
        text = " ".join(f"10.0.{i // 256}.{i % 256} user=u{i}" for i in range(n))
        df = spark.createDataFrame([(1, text, [text, None, "10.9.9.9"])], "id int, s string, more array<string>")
        row = scrub_columns(df, ["s", "more"]).first()
        want, again = [" ".join(f"<IPV4_{k - i}> user=<USERNAME_{u - i}>" for i in range(n)) for k, u in ((n, n), (2 * n, 2 * n))]
        assert row.s == want and row.more == [again, None, f"<IPV4_{2 * n + 1}>"]
        assert [(p.leaf, p.start) for p in row.placed] == sorted((p.leaf, p.start) for p in row.placed)


def test_passes_gather_numbers_only(spark):
    """A step of a fold copies what was gathered: were it what was found, its cost would grow with the square."""
    schema = f"fs array<array<{FINDING}>>"
    plan = spark.createDataFrame([], schema).select(number(F.transform("fs", resolve)))._jdf.queryExecution().analyzed().toString()
    assert "array_append(" in plan and not re.search(r"array_append\([^,]*, (?:named_struct|struct)\((?:leaf|from_end)", plan)
    assert "cast(array() as array<struct<leaf" not in plan and "cast(array() as array<struct<from_end" not in plan


def test_leaves_on_one_sheet(spark):
    """A row's leaves are asked by every rule once, together; nothing is found across leaves, and offsets count within them."""
    mark, nul = "\x01", "\0"
    odd = [
        ["10.0.0.1", None, "", "10.0.0.2 é 10.0.0.3"], ["10.0.0.", "1", "Bearer ", "abc", "12 ", "Main Street"], ["10.0.0.1", "10.0.0.2", "ü€𝄞 user=u1 zip 12345"],
        [f"10.0.0.1{mark}10.0.0.2", mark, f"{mark}user=u", "x"], [f"10.0.0.1{nul}user=u é", "a@b.example", nul], [None, None], [""], [], [mark],
        ["1.2.3.4.5.6.7.8", "4111-1111-1111-1111 123-45-6789", "call 212-555-0100 user=u user: v@x.example.com"], ["999.1.1.1 fe80::1 10.0.0.9"] * 40,
    ]
    df = spark.createDataFrame([(i, leaves) for i, leaves in enumerate(odd)], "id int, a array<string>")
    done = scrub_columns(df, ["a"])
    optimized = done._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in optimized and not re.search(r"RLIKE\(lambda|lambda \w+#\d+ RLIKE", optimized)
    got = {r.id: r for r in done.collect()}
    for i, leaves in enumerate(odd):
        counters, vault = {}, {}
        assert got[i].a == [None if v is None else brute.scrub(v, brute.doc_scan(v), counters, vault) for v in leaves], leaves
        assert {p.placeholder: p.original for p in got[i].placed} == vault
        for p in got[i].placed:
            leaf = leaves[p.leaf]
            assert leaf[p.start:p.end] == p.original == leaf.encode()[p.bstart:p.bend].decode()
    rows = spark.createDataFrame([(i, "json", json.dumps([v for v in leaves if v is not None])) for i, leaves in enumerate(odd)], "doc_id int, fmt string, text string")
    few, each = ScanConfig(), ScanConfig.from_mapping({"custom_rules": [{"name": "NEVER", "regex": "never to be found", "score": 1}]})  # rules of users: leaf by leaf
    columns = ["doc_id", "text", "placed", "finding_leaves", F.transform("findings", lambda f: F.struct(f["start"], f["end"], f["bstart"], f["bend"], f["label"], f["snippet"], f["weight"], f["copies"])).alias("f")]
    one, other = (sorted(map(repr, scrub_structured(rows, c).select(*columns).collect())) for c in (few, each))
    assert one == other
    one, other = (sorted(map(repr, findings_table(scrub_structured(rows, c)).select("doc_id", "ord", "leaf", "start", "end", "label", "snippet").collect())) for c in (few, each))
    assert one == other
