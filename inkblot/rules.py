"""Rules, names, allow-list and weights: what to look for, and how much it counts.

Everything here is small by nature (a rule set), so it travels inside the plan as literals. Tables
that may be large (allow-lists, name lists) have a join form as well; see ``operators.allow`` and
``operators.names``.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession

from inkblot.functions.dialect import WORD, RuleError, java_pattern
from inkblot.functions.entropy import ENTROPY_THRESHOLD

# ---------------------------------------------------------------------------------------------
# Patterns, names, priorities and weights must be these for the results to be right.
# ---------------------------------------------------------------------------------------------

CODE_PATTERNS = {
    "AWS_KEY": r"(?<![A-Z0-9])[A-Z0-9]{20}(?![A-Z0-9])",
    "IPV4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "IPV6": r"([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:)",
}

DOC_PATTERNS = {
    "IPV4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "AUTH_BEARER": r"Bearer [a-zA-Z0-9\-\._~\+\/]+",
    "AWS_KEY": r"(?<![A-Z0-9])[A-Z0-9]{20}(?![A-Z0-9])",
    "S3_BUCKET": r"(?<=s3://)[a-z0-9][a-z0-9\.-]+|(?<=bucket\s')[a-z0-9][a-z0-9\.-]+(?=')|(?<=bucket\s\")[a-z0-9][a-z0-9\.-]+(?=\")|(?<=for\s')[a-z0-9][a-z0-9\.-]+(?=')",
    "STRIPE_KEY": r"sk_live_[0-9a-zA-Z]+",
    "CREDIT_CARD_REGEX": r"\b(?:\d{4}[ -]?){3}\d{4}\b",
    "US_ZIP": r"\b\d{5}(?:-\d{4})?\b",
    "STREET_ADDRESS": r"(?i)\b\d{1,6}\s+(?:[A-Za-z0-9\.]+\s){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Plaza|Square|Loop|Parkway|Pkwy|Circle|Cir|Trail|Trl|Highway|Hwy)(?:\s+(?:Suite|Ste|Apt|Unit)\s+\d+)?\b",
    "GENERIC_TOKEN": r"(?<=token=)[a-zA-Z0-9\_\-]+",
    "USERNAME": r"(?<=user\s')[\w\.-]+(?=')|(?<=user\s\")[\w\.-]+(?=\")|(?<=user:\s)[\w\.-]+|(?<=user=)[\w\.-]+",
}

SUSPICIOUS_NAMES = (
    "password", "secret", "key", "token", "auth", "credential",
    "pwd", "api_key", "access_key", "client_secret", "private",
    "cert", "ssh",
)

PRIORITIES = {
    "AWS_KEY": 110, "SECRET_VAR_ASSIGNMENT": 100, "IPV4": 80, "IPV6": 80,
    "EMAIL_ADDRESS": 50, "PERSON": 50, "HIGH_ENTROPY_SECRET": 10,
}
CUSTOM_PRIORITY_OFFSET = 50
DEFAULT_PRIORITY = 0

WEIGHTS = {
    "AWS_KEY": 50, "STRIPE_KEY": 50, "SECRET_VAR_ASSIGNMENT": 40,
    "CREDIT_CARD_REGEX": 40, "HIGH_ENTROPY_SECRET": 30, "US_SSN": 30,
    "AUTH_BEARER": 25, "EMAIL_ADDRESS": 10, "PERSON": 5, "IPV4": 5, "LOCATION": 5,
}
DEFAULT_WEIGHT = 5

CODE_ENTITIES = ("PERSON", "EMAIL_ADDRESS")
DOC_ENTITIES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "IP_ADDRESS", "LOCATION")

# ---------------------------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------------------------

# Entities that have a written form. The leading look-aheads turn most positions down by one character.
ENTITY_PATTERNS = {
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE_NUMBER": (
        r"(?=[+(\d])(?:\+\d{1,3}[ .\-]?|\b1[ .\-])?(?:\(\d{3}\) ?|\b\d{3}[ .\-])\d{3}[ .\-]\d{4}\b"
    ),
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": (
        r"(?=[0-9a-fA-F]{1,4}[.:])\b(?:"
        r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        r"|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
        r"|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}"
        r")\b"
    ),
}

# A local part of any length is tried from the first word boundary of its run of characters only: where
# that fails, every later one does. So the cost stays linear without a bound on what is found. A start is
# turned down if a boundary of the same run lies shortly before it; the end of the last match may be one.
_LOCAL, _MARKS = r"[A-Za-z0-9._%+\-]", r"[.%+\-]"
LINEAR_FORMS = {
    "EMAIL_ADDRESS": (
        rf"(?:\G|(?<!{_LOCAL})|(?<={_MARKS})(?=[A-Za-z0-9_])(?<![{WORD}]{_MARKS}{{1,16}})"
        rf"|(?<=[A-Za-z0-9_])(?={_MARKS})(?<!(?:^|[^{WORD}])[A-Za-z0-9_]{{1,32}}))"
    ),
}

# What every match of a built-in pattern of many branches begins with: most positions are turned down by one look
# ahead in place of each branch in turn. In an address, at most four digits stand before each of its first two colons.
LEADS = {"IPV6": r"(?=[0-9a-fA-F]{0,4}+:[0-9a-fA-F]{0,4}+:)"}

# Literals of which every match of the built-in pattern holds, or directly follows, at least one.
GUARDS = {
    "IPV6": (":",),
    "AUTH_BEARER": ("Bearer ",),
    "S3_BUCKET": ("s3://", "bucket", "for"),
    "STRIPE_KEY": ("sk_live_",),
    "GENERIC_TOKEN": ("token=",),
    "USERNAME": ("user",),
    "EMAIL_ADDRESS": ("@",),
    "US_SSN": ("-",),
}

# Built-in patterns of which every match holds a digit: one test for a digit spares most texts all of them.
WITH_DIGIT = frozenset({"IPV4", "CREDIT_CARD_REGEX", "US_ZIP", "STREET_ADDRESS", "PHONE_NUMBER", "US_SSN"})

# Sets carried inside the plan may have up to this many entries; larger ones are joined.
INLINE_LIMIT = 10_000
# Every rule in the plan is a detector of its own, with expressions of its own.
RULES_INLINE = 200


@dataclass(frozen=True)
class Rule:
    """One detector as it runs in one engine; ``ordinal`` is its place in emission order."""

    label: str
    detector: str  # pattern | entity | names | entropy | context
    ordinal: int
    priority: int
    weight: int
    java: str = ""
    guard: tuple[str, ...] = ()
    with_digit: bool = False
    place: int = 0  # among the rules that are in the plan


@dataclass(frozen=True)
class CustomRule:
    name: str
    regex: str
    score: int | None = None

    def __post_init__(self) -> None:
        if not self.name or any(c in "<>" for c in self.name):
            raise RuleError("a rule needs a name, without '<' and '>'")
        if not self.regex:
            raise RuleError(f"rule {self.name!r} has no regex")
        try:
            java_pattern(self.regex)
        except RuleError as exc:
            raise RuleError(f"rule {self.name!r}: {exc}") from exc


def _bounded(rows: DataFrame, what: str) -> list[Row]:
    """The rows of a table of rules, each of which becomes a part of the plan."""
    got = _few(rows)
    if got is None:
        raise ValueError(f"{what} has more than {INLINE_LIMIT} rows; every one of them would be a detector of its own")
    return got


def _few(rows: DataFrame, limit: int = INLINE_LIMIT) -> list[Row] | None:
    """The rows of a table that can travel in the plan; None, after reading one row more, for a larger one."""
    got = rows.limit(limit + 1).collect()
    return got if len(got) <= limit else None


@dataclass(frozen=True)
class ScanConfig:
    """What a scan looks for. Build one from a mapping, a file or tables, or use the defaults."""

    custom_rules: tuple[CustomRule, ...] = ()
    ignore: frozenset[str] = frozenset()
    extra_suspicious: tuple[str, ...] = ()
    names: tuple[tuple[str, str], ...] = ()  # (value, PERSON or LOCATION)
    entropy_threshold: float = ENTROPY_THRESHOLD
    entities: bool = field(default=True)
    # Lists too long for the plan, as tables that a scan joins: ``value``, and ``value, label``.
    ignore_table: DataFrame | None = field(default=None, compare=False)
    names_table: DataFrame | None = field(default=None, compare=False)
    joined_labels: tuple[str, ...] = ()  # what names_table has, so that rules are counted as with short lists
    model: object | None = field(default=None, compare=False)  # an operators.models.EntityModel, which a scan runs on its texts
    rules_table: DataFrame | None = field(default=None, compare=False)  # ``name, regex, score`` of rules too many for the plan
    rules_index: DataFrame | None = field(default=None, compare=False)  # the same, as operators.manyrules reads them
    joined_rules: int = 0  # how many those are: detectors that come after them are counted on from there
    native_sites: bool = False  # find assignments by operators.sites, which runs no Python and parses less strictly

    @classmethod
    def from_mapping(cls, config: Mapping) -> ScanConfig:
        """The configuration layout users write: ``ignore``, ``suspicious_vars``, ``custom_rules``."""
        return cls(
            custom_rules=tuple(
                CustomRule(r.get("name", ""), r.get("regex", ""), r.get("score"))
                for r in config.get("custom_rules") or ()
            ),
            ignore=frozenset(config.get("ignore") or ()),
            extra_suspicious=tuple(config.get("suspicious_vars") or ()),
        )

    @classmethod
    def from_files(cls, paths: Iterable[str]) -> ScanConfig:
        """The first of ``paths`` that exists and parses (JSON, or YAML where PyYAML is at hand)."""
        for path in paths:
            if not os.path.exists(path):
                continue
            try:
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                return cls.from_mapping(_parse_config(text) or {})
            except Exception as exc:  # an unreadable file must not stop the next from being tried
                warnings.warn(f"configuration {path} not used: {exc}", stacklevel=2)
        return cls()

    @classmethod
    def from_tables(
        cls,
        rules: DataFrame | None = None,
        ignore: DataFrame | None = None,
        suspicious: DataFrame | None = None,
        names: DataFrame | None = None,
    ) -> ScanConfig:
        """From tables ``rules(name, regex, score)``, ``ignore(value)``, ``suspicious(name)`` and
        ``names(value, label)``.

        Suspicious names travel in the plan. Rules, allow-lists and lists of names may have any length:
        short ones travel in the plan too, others are joined by the scan, with the same result. Of many rules,
        those with the name of a built-in one replace it in the plan.
        """
        few_rules = _few(rules, RULES_INLINE) if rules is not None else []
        many = rules if few_rules is None else None
        if many is not None:
            built_in = [*CODE_PATTERNS, *DOC_PATTERNS]
            few_rules = many.where(many["name"].isin(built_in)).collect()  # as many as there are built-in names, and their repeats
            many = many.where(~many["name"].isin(built_in) | many["name"].isNull())
        ignored = ignore.select("value") if ignore is not None else None
        listed = names.select("value", "label") if names is not None else None
        few_ignored = _few(ignored) if ignored is not None else []
        few_names = _few(listed) if listed is not None else []
        return cls(
            custom_rules=tuple(
                CustomRule(r["name"], r["regex"], r.asDict().get("score")) for r in few_rules
            ),
            rules_table=many,
            ignore=frozenset(r["value"] for r in few_ignored or () if r["value"] is not None),
            extra_suspicious=tuple(r["name"] for r in _bounded(suspicious.select("name"), "suspicious")) if suspicious is not None else (),
            names=tuple((r["value"], r["label"]) for r in few_names or () if r["value"] is not None),
            ignore_table=ignored if few_ignored is None else None,
            names_table=listed if few_names is None else None,
        )

    def with_names(self, names: Sequence[tuple[str, str]]) -> ScanConfig:
        return replace(self, names=tuple(names))

    def tables(self, spark: SparkSession) -> ScanConfig:
        """This configuration with lists that are too long for the plan as tables."""
        out = self
        if len(self.ignore) > INLINE_LIMIT:
            rows = spark.createDataFrame([(v,) for v in sorted(self.ignore)], "value string")
            rows = rows if self.ignore_table is None else rows.union(self.ignore_table)
            out = replace(out, ignore=frozenset(), ignore_table=rows)
        if len(self.names) > INLINE_LIMIT:
            rows = spark.createDataFrame(list(self.names), "value string, label string")
            rows = rows if self.names_table is None else rows.union(self.names_table)
            out = replace(out, names=(), names_table=rows)
        return out

    @cached_property
    def suspicious(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(SUSPICIOUS_NAMES + self.extra_suspicious))

    def priority(self, label: str) -> int:
        """The later of two custom rules with a score and one name decides."""
        for rule in reversed(self.custom_rules):
            if rule.name == label and rule.score is not None:
                return rule.score + CUSTOM_PRIORITY_OFFSET
        return PRIORITIES.get(label, DEFAULT_PRIORITY)

    def weight(self, label: str) -> int:
        for rule in reversed(self.custom_rules):
            if rule.name == label and rule.score is not None:
                return rule.score
        return WEIGHTS.get(label, DEFAULT_WEIGHT)

    def _patterns(self, built_in: Mapping[str, str]) -> list[tuple[str, str, str, tuple[str, ...]]]:
        """Built-in patterns, with custom ones replacing those of their name in place, or added."""
        patterns = dict(built_in)
        for rule in self.custom_rules:
            patterns[rule.name] = rule.regex
        return [
            (label, "pattern", regex, GUARDS.get(label, ()) if built_in.get(label) == regex else ())
            for label, regex in patterns.items()
        ]

    def _entities(self, labels: Sequence[str]) -> list[tuple[str, str, str, tuple[str, ...]]]:
        if not self.entities:
            return []
        listed = {label for _, label in self.names} | set(self.joined_labels)
        return [
            (label, "entity" if label in ENTITY_PATTERNS else "names", ENTITY_PATTERNS.get(label, ""), GUARDS.get(label, ()))
            for label in labels
            if label in ENTITY_PATTERNS or label in listed
        ]

    def _before_joined(self, kind: str) -> list[tuple[str, str, str, tuple[str, ...]]]:
        """Detectors that emit before the rules of a table."""
        return self._entities(CODE_ENTITIES) + self._patterns(CODE_PATTERNS) if kind == "CODE" else self._patterns(DOC_PATTERNS)

    def first_joined(self, kind: str) -> int:
        return len(self._before_joined(kind))

    def rules(self, kind: str) -> list[Rule]:
        """The detectors of an engine (``CODE`` or ``DOC``) in the order they emit findings."""
        parts = self._before_joined(kind)
        joined_at = len(parts)
        if kind == "CODE":
            parts = parts + [("HIGH_ENTROPY_SECRET", "entropy", "", ()), ("SECRET_VAR_ASSIGNMENT", "context", "", ())]
        else:
            parts = parts + self._entities(DOC_ENTITIES)
        return [
            Rule(
                label, detector, place + (self.joined_rules if place >= joined_at else 0),
                # only the code engine ranks findings that start together; documents go by rule order
                self.priority(label) if kind == "CODE" else 0,
                self.weight(label),
                _java(label, detector, regex) if regex else "",
                guard,
                label in WITH_DIGIT and regex in (DOC_PATTERNS.get(label), CODE_PATTERNS.get(label), ENTITY_PATTERNS.get(label)),
                place,
            )
            for place, (label, detector, regex, guard) in enumerate(parts)
        ]

    def names_for(self, label: str) -> list[str]:
        return sorted({" ".join(value.lower().split()) for value, of in self.names if of == label and value.strip()})


def _java(label: str, detector: str, regex: str) -> str:
    if label in LEADS and regex == CODE_PATTERNS.get(label):
        flags, body = java_pattern(regex).split(")", 1)
        return f"{flags}){LEADS[label]}(?:{body})"
    if detector != "entity" or label not in LINEAR_FORMS:
        return java_pattern(regex)
    flags, body = java_pattern(regex).split(")", 1)
    return f"{flags}){LINEAR_FORMS[label]}{body.replace('+@', '++@', 1)}"


def _parse_config(text: str):
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as exc:
            raise RuleError("not JSON, and PyYAML is not installed") from exc
        return yaml.safe_load(text)
