"""Detection: the findings of a text as one array, worked out inside its row.

No shuffle, no state: the same expression serves tables, streams and the leaves of structured
records. Findings come sorted the way overlaps are resolved, last start first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty
from inkblot.functions.dialect import DIGIT
from inkblot.functions.entropy import high_entropy_hit
from inkblot.functions.spans import HIT, ngram_hits, place_as, regex_hit
from inkblot.operators.context import assigned_hits
from inkblot.rules import Rule, ScanConfig

# The first four fields make the natural order of findings the order in which overlaps are
# resolved: later start first, then higher priority, then emission order.
FINDING = (
    "struct<from_end:int,rank:int,ordinal:int,sub:int,start:int,end:int,bstart:int,bend:int,"
    "label:string,snippet:string,detector:string,weight:int,copies:int>"
)


ENTRY = f"struct<rule:int,sub:int,copies:int,hit:{HIT}>"


def _names(text: Column, rule: Rule, names: Sequence[str]) -> Column:
    by_words: dict[int, list[str]] = {}
    for name in names:
        by_words.setdefault(len(name.split(" ")), []).append(name)
    keep = {n: (lambda key, listed=listed: key.isin(listed)) for n, listed in by_words.items()}
    return F.transform(ngram_hits(text, keep), lambda hit: _entry(rule, hit))


def _assigned(text: Column, rule: Rule, literals: Column) -> Column:
    return F.transform(assigned_hits(text, literals), lambda x: _entry(rule, x["hit"], x["sub"], x["copies"]))


def _entry(rule: Rule, hit: Column, sub: Column | None = None, copies: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule.place).alias("rule"),
        (F.lit(0) if sub is None else sub).alias("sub"),
        (F.lit(1) if copies is None else copies).alias("copies"),
        hit.alias("hit"),
    )


def looks_like_person(snippet: Column) -> Column:
    """In source code, "names" with an underscore or a digit are identifiers."""
    return ~snippet.rlike(r"[_\p{Nd}]")


def _entries(text: Column, rules: Sequence[Rule], config: ScanConfig, literals: Column | None) -> Column:
    """What each rule hits, as one array."""
    single, digits, several = [], [], []
    for rule in rules:
        if rule.detector == "context":
            several.append(_assigned(text, rule, literals))
        elif rule.detector == "names":
            listed = config.names_for(rule.label)  # none if they are joined in later
            several += [_names(text, rule, listed)] if listed else []
        elif rule.detector == "entropy":
            single.append(_entry(rule, high_entropy_hit(text, config.entropy_threshold)))
        else:
            (digits if rule.with_digit else single).append(_entry(rule, regex_hit(text, rule.java, rule.guard)))
    if digits:
        several.append(F.when(text.rlike(f"[{DIGIT}]"), F.array(*digits)).otherwise(empty(ENTRY)))
    return F.concat(*([F.array(*single)] if single else []), *several)


def findings_of(text: Column, kind: str, config: ScanConfig, literals: Column | None = None) -> Column:
    """All findings of an engine in one text, allow-listed values left out, in resolving order.

    ``literals`` holds the suspicious literals of a source (the context detector's input).
    """
    rules = [r for r in config.rules(kind) if r.detector != "context" or literals is not None]

    def of_rule(values: Sequence, entry: Column) -> Column:
        # what a rule has besides its pattern is looked up by its place in the rule set
        return F.get(F.array(*map(F.lit, values)), entry["rule"])

    def findings(entry: Column) -> Column:
        def finding(start: Column, end: Column, bstart: Column, bend: Column, snippet: Column) -> Column:
            return F.struct(
                (-start).alias("from_end"),
                of_rule([-r.priority for r in rules], entry).alias("rank"),
                of_rule([r.ordinal for r in rules], entry).alias("ordinal"),
                entry["sub"].alias("sub"),
                start.alias("start"), end.alias("end"), bstart.alias("bstart"), bend.alias("bend"),
                of_rule([r.label for r in rules], entry).alias("label"),
                snippet.alias("snippet"),
                of_rule([r.detector for r in rules], entry).alias("detector"),
                of_rule([r.weight for r in rules], entry).alias("weight"),
                entry["copies"].alias("copies"),
            )

        return place_as(entry["hit"], finding, FINDING)

    hits = F.filter(_entries(text, rules, config, literals), lambda e: e["hit"].isNotNull())
    found = F.flatten(F.transform(hits, findings))
    if config.ignore:
        ignored = sorted(config.ignore)
        found = F.filter(found, lambda f: ~f["snippet"].isin(ignored))
    if kind == "CODE" and any(r.detector == "names" for r in rules):
        found = F.filter(found, lambda f: (f["label"] != "PERSON") | looks_like_person(f["snippet"]))
    return F.sort_array(found)
