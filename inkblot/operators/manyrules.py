"""Custom rules from a table too large for the plan: a text meets only the rules whose literal it holds.

Of each rule's pattern, the longest run of characters that every match holds is taken. Rules stand in an
index under the eight characters of it that the fewest rules have, or under all of it if it is shorter. The runs of four
to eight characters of a text, told apart by two bit maps of the index inside the row, are looked up there; the literal
itself is then sought in the text, and only the rules that are left run their pattern. Rules without such a literal run on every text.
Patterns are columns here, so a rule is a row and not a part of the plan.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator
from dataclasses import replace
from re import _constants as ops
from re import _parser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.functions import dialect
from inkblot.functions.arrays import empty, let
from inkblot.functions.bitmap import BitMap
from inkblot.functions.dialect import RuleError, java_pattern
from inkblot.functions.spans import pattern_hit, place
from inkblot.operators.detect import FINDING
from inkblot.operators.findings import content_key
from inkblot.rules import CUSTOM_PRIORITY_OFFSET, DEFAULT_PRIORITY, DEFAULT_WEIGHT, ScanConfig
from inkblot.session import stored

# The helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(dialect)

# So many characters of a literal, at most, are its key in the index: those that the fewest rules have. A key is as long
# as its literal lets it be: four digits, say, stand in most log lines.
LEAST, MOST = 4, 8
KEYS = rf"(?s)(?=(.{{{MOST}}}))"
RUNS = rf"(?s)(?=(.{{{LEAST},{MOST}}}))"


def required_literal(regex: str) -> str:
    """The longest run of characters that every match of a pattern holds; empty if there is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = _parser.parse(regex)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    best, run = "", ""

    def walk(items) -> None:
        nonlocal best, run
        for op, value in items:
            if op is ops.LITERAL:
                run += chr(value)
                best = max(best, run, key=len)
            elif op is ops.SUBPATTERN and not (value[1] or value[2]):
                walk(value[3])
            elif op is ops.AT:
                continue  # takes no room, so the run goes on
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
                run = ""
                walk(value[2])
                run = ""
            else:
                run = ""

    walk(parsed)
    return best


def rule_index(rules: DataFrame) -> DataFrame:
    """``name, java, literal, key, score, number`` of a table ``rules(name, regex, score)``, stored in scratch.

    Of rules with one name the last counts, by ``ordinal`` if the table has one, or else by pattern. Those that
    cannot be run raise the error that a short list raises.
    """
    given = rules.select("name", "regex", F.col("score").cast("int").alias("score") if "score" in rules.columns else F.lit(None).cast("int").alias("score"),
                         F.col("ordinal").cast("long").alias("ordinal") if "ordinal" in rules.columns else F.lit(0).cast("long").alias("ordinal"))
    last = F.max_by(F.struct("regex", "score"), F.struct("ordinal", F.coalesce("regex", F.lit("")))).alias("r")
    chosen = given.groupBy("name").agg(last, F.min("ordinal").alias("ordinal")).select("name", "r.*", "ordinal")

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, regex in zip(b["name"], b["regex"]):
                try:
                    if not name or any(c in "<>" for c in name):
                        raise RuleError("a rule needs a name, without '<' and '>'")
                    if not regex:
                        raise RuleError(f"rule {name!r} has no regex")
                    out.append((java_pattern(regex), required_literal(regex), None))
                except RuleError as exc:
                    out.append((None, None, f"rule {name!r}: {exc}"))
            done = pd.DataFrame(out, columns=["java", "literal", "error"])
            yield pd.concat([b[["name", "score", "ordinal"]].reset_index(drop=True), done], axis=1)

    read = stored(chosen.mapInPandas(compiled, "name string, score int, ordinal long, java string, literal string, error string"), "rules")
    bad = read.where("error is not null").select("error").orderBy("name").first()
    if bad:
        raise RuleError(bad["error"])
    # one window over a row for each rule
    number = (F.row_number().over(Window.orderBy("ordinal", "name")) - 1).cast("int")
    numbered = stored(read.select("name", "java", "literal", "score", number.alias("number")), "rule-numbers")
    size = F.char_length("literal")
    whole = F.when(size >= LEAST, F.array("literal")).otherwise(empty("string"))
    keys = F.when(size > MOST, F.array_distinct(F.regexp_extract_all("literal", F.lit(KEYS), F.lit(1)))).otherwise(whole)
    runs = numbered.select("number", F.explode(keys).alias("key"))
    often = runs.groupBy("key").agg(F.count("*").alias("n"))
    rarest = runs.join(often, "key").groupBy("number").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    return stored(numbered.join(rarest, "number", "left").select("name", "java", "literal", "key", "score", "number"), "rule-index")


def with_rule_index(config: ScanConfig) -> ScanConfig:
    """A configuration whose table of rules, if it has one, is made into an index."""
    if config.rules_table is None:
        return config
    index = rule_index(config.rules_table)
    return replace(config, rules_table=None, rules_index=index, joined_rules=index.count())


def _candidates(rows: DataFrame, index: DataFrame, text_col: str) -> DataFrame:
    """``_key`` and ``_rules``: for each text, the rules whose literal it holds, or that have none."""
    keyed = index.where("key is not null")
    known = BitMap(keyed.select("key").distinct(), "key")
    begun = BitMap(keyed.select(F.substring("key", 1, LEAST).alias("key")).distinct(), "key")
    sizes = sorted(r["n"] for r in keyed.select(F.char_length("key").alias("n")).distinct().collect()) or [LEAST]
    text = F.col(text_col)
    # runs that begin like a key; each is then as long as the keys are
    runs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))), lambda r: begun.may_have(F.substring(r, 1, LEAST)))
    cut = F.flatten(F.transform(runs, lambda r: F.array(*[F.substring(r, 1, n) for n in sizes])))
    held = rows.select("_key", F.explode_outer(F.array_distinct(F.filter(cut, known.may_have))).alias("key")).where("key is not null").distinct()
    met = held.join(keyed, "key").select("_key", F.struct("number", "name", "java", "literal", "score").alias("r"))
    return met.groupBy("_key").agg(F.collect_list("r").alias("_rules"))  # bounded by the runs of one text and their rules


def _rule_findings(text: Column, rules: Column, first: int, code: bool) -> Column:
    def of_rule(r: Column) -> Column:
        weight = F.coalesce(r["score"], F.lit(DEFAULT_WEIGHT))
        priority = F.coalesce(r["score"] + CUSTOM_PRIORITY_OFFSET, F.lit(DEFAULT_PRIORITY)) if code else F.lit(0)

        def finding(s: Column) -> Column:
            return F.struct(
                (-s["start"]).alias("from_end"), (-priority).alias("rank"), (r["number"] + first).alias("ordinal"), F.lit(0).alias("sub"),
                s["start"].alias("start"), s["end"].alias("end"), s["bstart"].alias("bstart"), s["bend"].alias("bend"), r["name"].alias("label"),
                s["snippet"].alias("snippet"), F.lit("pattern").alias("detector"), weight.alias("weight"), F.lit(1).alias("copies"),
            ).cast(FINDING)

        holds = (r["literal"] == "") | F.contains(text, r["literal"])
        return F.when(holds, F.transform(let(pattern_hit(text, r["java"]), place), finding)).otherwise(empty(FINDING))

    return F.flatten(F.transform(rules, of_rule))


def add_rules(scanned: DataFrame, index: DataFrame, kind: str, config: ScanConfig, text_col: str = "text") -> DataFrame:
    """A scan (of one engine) with the findings of the rules of an index.

    They depend on the text alone, so its hash is what candidates come back by: ids may be null or repeated.
    """
    first = config.first_joined(kind)
    keyed = scanned.withColumn("_key", content_key(F.array(text_col)))
    per_text = _candidates(keyed, index, text_col)
    item = "struct<number:int,name:string,java:string,literal:string,score:int>"
    # one row: the rules that every text meets
    broad = index.where("key is null").agg(F.collect_list(F.struct("number", "name", "java", "literal", "score")).alias("_broad"))
    joined = keyed.join(per_text, "_key", "left").join(F.broadcast(broad)).drop("_key")
    met = F.concat(F.coalesce("_rules", empty(item)), "_broad")
    found = _rule_findings(F.col(text_col), met, first, kind == "CODE")
    if config.ignore:
        found = F.filter(found, lambda f: ~f["snippet"].isin(sorted(config.ignore)))
    merged = F.when(F.col(text_col).isNotNull(), F.sort_array(F.concat("findings", found))).otherwise(F.col("findings"))
    return joined.withColumn("findings", merged).drop("_rules", "_broad")
