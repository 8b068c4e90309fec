"""Rules from a table beside the same rules in the plan."""

import pytest
from pyspark.sql import functions as F

from inkblot import ScanConfig, scan, scrub
from inkblot.functions.dialect import RuleError
from inkblot.operators.findings import findings_table
from inkblot.operators.manyrules import _candidates, required_literal, rule_index
from inkblot.operators.models import EntityModel
from inkblot.operators.structured import scrub_any, scrub_columns
from inkblot.rules import CustomRule

RULES = [
    ("TICKET", r"\bTK-\d{6}\b", 20), ("LONG", r"order number \d+", None), ("CASE", r"(?i)secret\w+", 60), ("SHORT", r"q\d", 5), ("ALT", r"(?:alpha|beta)-\d", 7), ("BOTH", r"10\.0\.0\.\d", 90),
    ("IPV4", r"192\.168\.\d+\.\d+", 3), ("GROUP", r"(id)=(\d+)", 1), ("OPT", r"colou?r-code", 2), ("REP", r"(?:ab){2,3}cdef", 4), ("E", r"é😀-\w+", 8), ("SAME", r"shared \w+", 9), ("SAMETOO", r"shared \w+", 9),
]
TEXTS = [
    "TK-123456 and order number 77", "SecretSauce q1 alpha-2 beta-3", "10.0.0.1 192.168.1.1", "id=7 color-code colour-code ababcdef", "é😀-x 😀 shared text TK-1 TK-999999", "", None, "nothing of note", "a@b.example.com 10.0.0.9 shared 12345",
]


@pytest.fixture()
def both(spark):
    more = spark.range(300).select(F.concat(F.lit("N"), "id").alias("name"), F.concat(F.lit("never-"), "id", F.lit("-seen")).alias("regex"), F.lit(1).alias("score"), (F.col("id") + 100).alias("ordinal"))
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "name string, regex string, score int, ordinal long").union(more)
    return ScanConfig(custom_rules=tuple(CustomRule(*r) for r in RULES)), ScanConfig.from_tables(rules=table)


@pytest.mark.parametrize("kind", ["DOC", "CODE"])
def test_the_same_findings_as_in_the_plan(texts, both, kind):
    inline, table = both
    docs = texts(TEXTS)
    assert table.rules_table is not None and [r.name for r in table.custom_rules] == ["IPV4"]
    shown = lambda config: [tuple(r[c] for c in ("doc_id", "ord", "start", "end", "label", "snippet", "priority", "weight")) for r in findings_table(scan(docs, config, kind)).orderBy("doc_id", "ord").collect()]
    assert shown(inline) == shown(table) and len(shown(table)) > 15
    text = lambda config: {r.doc_id: r.text for r in scrub(docs, config, kind).collect()}
    assert text(inline) == text(table)


def test_structured_texts_columns_and_models(spark, both):
    """What a text finds, the strings of structured texts find too."""
    inline, table = both
    model = EntityModel(lambda: lambda texts: [[(0, 2, "ORG")] if t.startswith("TK") else [] for t in texts], ("ORG",))
    docs = spark.createDataFrame(
        [(1, "/a.json", '{"a": "TK-123456", "b": ["order number 5", "10.0.0.1"]}'), (2, "/a.csv", "TK-123456,shared x\r\n"), (3, "/a.txt", "TK-654321 q7"), (4, "/a.json", "{TK-123456"), (None, "/b.json", '["TK-123456"]')],
        "doc_id bigint, path string, text string")
    shown = lambda config: sorted((r.path, r.text, len(r.findings)) for r in scrub_any(docs, config).collect())
    got = shown(table)
    assert got == shown(inline) and "<TICKET_1>" in got[0][1] and all(n for *_, n in got)
    rows = lambda config: [(r.text, r.path) for r in scrub_columns(docs.where("doc_id = 3"), ["text", "path"], config).collect()]
    assert rows(table) == rows(inline) == [("<TICKET_1> <SHORT_1>", "/a.txt")]
    (r,) = scrub_any(docs.where("doc_id = 2"), ScanConfig(model=model)).collect()
    assert r.text == "<ORG_1>-123456,shared x\r\n"


def test_rows_of_both_kinds_and_without_id(spark, both):
    _, table = both
    docs = spark.createDataFrame([(None, "TK-123456", "/a.py"), (None, "TK-123456 TK-654321", "/a.txt"), (1, None, "/a.py")], "doc_id bigint, text string, path string")
    found = scan(docs, table).select("path", "text", F.size("findings").alias("n")).collect()
    assert {(r.path, r.text or ""): r.n for r in found} == {("/a.py", "TK-123456"): 1, ("/a.txt", "TK-123456 TK-654321"): 2, ("/a.py", ""): 0}


def test_a_rule_that_cannot_run_is_refused(spark, texts):
    rows = [(f"R{i}", f"word{i}", 1) for i in range(300)] + [("BAD", "a*", 1)]
    config = ScanConfig.from_tables(rules=spark.createDataFrame(rows, "name string, regex string, score int"))
    with pytest.raises(RuleError, match="BAD"):
        scan(texts(["x"]), config)


@pytest.mark.parametrize("regex,literal", [
    (r"\bTK-\d{6}\b", "TK-"), ("abc|abd", "ab"), ("(?:alpha|beta)", ""), ("(?i)secret", ""), ("a?bcd+e", "bc"), ("x(ab)y", "xaby"), ("(?:ab){2}cdef", "cdef"), ("[ab]cd", "cd"), (r"(?<=token=)\w+", ""), (r"a\.b", "a.b"),
])
def test_literals_that_every_match_holds(regex, literal):
    assert required_literal(regex) == literal


def test_a_text_meets_only_rules_whose_literal_it_may_hold(spark, texts):
    """Digits that many literals end with are no reason to look at their rules."""
    rules = spark.range(3000).select(F.concat(F.lit("R"), "id").alias("name"), F.concat(F.lit("bkt-"), "id", F.lit(r"\b")).alias("regex"))
    long = spark.createDataFrame([("LONG", "one long literal of a rule"), ("ASTRAL", "😀😀 smiling and more")], "name string, regex string")
    index = rule_index(rules.union(long))
    docs = texts(["card 1234 2345 1999 and bkt-77 here", "1234", "bkt-2999", "a bkt-", "no one long literal of a rule", "x😀😀 smiling and more"])
    met = {r._key: {x.name for x in r._rules} for r in _candidates(docs.withColumnRenamed("doc_id", "_key"), index, "text").collect()}
    assert met[0] <= {"R7", "R77"} and "R77" in met[0] and 1 not in met and 3 not in met
    assert "R2999" in met[2] and len(met[2]) <= 4 and met[4] == {"LONG"} and met[5] == {"ASTRAL"}
