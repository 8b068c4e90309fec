"""Structured text (JSON, CSV, XML) and structured columns: scrub the strings, keep the structure.

A structured document becomes an array of leaves, the strings to scan, in the order in which they
are numbered; detection, resolving and numbering are the same native expressions as for plain
text. JSON is taken apart and written again by native expressions too; for CSV and XML that is left to
Python's own readers and writers, and only for such rows.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import lru_cache, partial, reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkblot.functions.arrays import empty, let, offsets
from inkblot.functions.routing import format_of, kind_of
from inkblot.operators.context import suspicious_literals
from inkblot.operators.detect import FINDING, findings_of
from inkblot.operators.findings import content_key, with_allowed, without_allowed
from inkblot.operators.jsontext import is_json, json_leaves, tokens, written_json
from inkblot.operators.manyrules import add_rules, with_rule_index
from inkblot.operators.models import add_model
from inkblot.operators.names import name_findings, name_labels
from inkblot.operators.resolve import resolve, scrub_kept
from inkblot.operators.sheets import on_one_sheet, with_sheet
from inkblot.operators.sites import native_literals
from inkblot.rules import ScanConfig
from inkblot.session import stored

# The helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRUCTURED = ("json", "csv", "xml")
LEAVES = T.StructType([T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("fallback", T.BooleanType())])


class Opened:
    """A structured text that was read, its strings with a way to set each, and how to write it again.

    ``strings`` are in the order in which placeholders are numbered. What was read before an error
    counts, so they are gathered as the text is read.
    """

    def __init__(self, fmt: str, text: str):
        self.strings: list[tuple[str, Callable[[str], None]]] = []
        self.written: Callable[[], str] = getattr(self, f"_open_{fmt}")(text)

    def _slot(self, value: str, put: Callable, *key) -> None:
        self.strings.append((value, partial(put, *key)))

    def _open_json(self, text: str) -> Callable[[], str]:
        holder = [json.loads(text)]
        todo = [(holder, 0)]  # places still to look at, the next one last
        while todo:
            owner, key = todo.pop()
            value = owner[key]
            if isinstance(value, str):
                self._slot(value, owner.__setitem__, key)
            elif isinstance(value, (dict, list)):
                keys = list(value) if isinstance(value, dict) else range(len(value))
                todo.extend((value, k) for k in reversed(keys))
        return lambda: json.dumps(holder[0], indent=2)

    def _open_csv(self, text: str) -> Callable[[], str]:
        lines = []
        for cells in csv.reader(io.StringIO(text)):
            lines.append(cells)
            for i, cell in enumerate(cells):
                self._slot(cell, cells.__setitem__, i)

        def write() -> str:
            out = io.StringIO()
            csv.writer(out).writerows(lines)
            return out.getvalue()

        return write

    def _open_xml(self, text: str) -> Callable[[], str]:
        root = ET.fromstring(text)
        for node in root.iter():  # each element before what it holds
            for part in ("text", "tail"):
                if value := getattr(node, part):
                    self._slot(value, setattr, node, part)
            for name, value in node.items():
                self._slot(value, node.set, name)
        return lambda: ET.tostring(root, encoding="unicode")

    def with_strings(self, new: Iterable[str]) -> str:
        for (_, put), value in zip(self.strings, new, strict=True):
            put(value)
        return self.written()


def _storable(value: str) -> str:
    # escapes may spell lone surrogates, which no stored text can hold
    return value.encode("utf-8", "replace").decode()


def take_apart(fmt: str, text: str) -> dict:
    opened = Opened.__new__(Opened)
    try:
        opened.__init__(fmt, text)
        opened.written()
        return {"leaves": [_storable(v) for v, _ in opened.strings], "fallback": False}
    except Exception:  # not what it claims to be: the whole text is scanned as it stands
        return {"leaves": [*(_storable(v) for v, _ in opened.strings), text], "fallback": True}


def put_together(fmt: str, text: str, leaves: Iterable[str]) -> str:
    opened = Opened(fmt, text)
    return opened.with_strings(old if new == _storable(old) else new for (old, _), new in zip(opened.strings, leaves, strict=True))


@F.pandas_udf(LEAVES)
def _take_apart(fmt: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [take_apart(f, t) if t is not None else {"leaves": [], "fallback": False} for f, t in zip(fmt, text)]
    return pd.DataFrame(rows, columns=["leaves", "fallback"])


@F.pandas_udf(T.StringType())
def _put_together(fmt: pd.Series, text: pd.Series, leaves: pd.Series) -> pd.Series:
    return pd.Series(
        [put_together(f, t, new) if t is not None else None for f, t, new in zip(fmt, text, leaves)], dtype=object
    )


def with_leaves(docs: DataFrame, text_col: str = "text", formats: Sequence[str] = STRUCTURED) -> DataFrame:
    """``docs`` (with ``fmt`` or ``path``) with ``leaves`` and ``fallback``, and ``_tokens`` of JSON texts.

    ``formats`` are those that rows may have. JSON is taken apart by native expressions; only where CSV or XML
    may come does the plan have a step in Python, and only such rows go through it.
    """
    if "fmt" not in docs.columns:
        docs = docs.withColumn("fmt", format_of(F.col("path")))
    text, fmt = F.col(text_col), F.col("fmt")
    plain = F.when(text.isNotNull(), F.array(text)).otherwise(empty("string"))
    leaves, fallback = plain, F.lit(False)
    apart = docs
    python = [f for f in ("csv", "xml") if f in formats]
    if python:
        # Called non-deterministic, so that the optimizer keeps this projection below, and does not fold
        # it into, the one that puts the texts together again.
        apart = apart.withColumn("_apart", _take_apart.asNondeterministic()(fmt, F.when(fmt.isin(*python), text)))
        leaves = F.when(fmt.isin(*python), F.col("_apart.leaves")).otherwise(leaves)
        fallback = F.when(fmt.isin(*python), F.coalesce(F.col("_apart.fallback"), F.lit(False))).otherwise(fallback)
    if "json" in formats:
        apart = apart.withColumn("_tokens", F.when(fmt == "json", tokens(text)))
        apart = apart.withColumn("_json", F.when(F.col("_tokens").isNotNull(), is_json(text, F.col("_tokens"))))
        leaves = F.when(F.col("_json"), json_leaves(F.col("_tokens"))).otherwise(leaves)
        fallback = F.coalesce(~F.col("_json"), fallback)
    else:
        apart = apart.withColumn("_tokens", F.lit(None).cast("array<string>"))
    return apart.withColumn("leaves", leaves).withColumn("fallback", fallback).drop("_apart", "_json")


def _found_in(leaf: Column, config: ScanConfig, code: bool) -> Column:
    doc = findings_of(leaf, "DOC", config)
    return F.when(F.col("kind") == "CODE", findings_of(leaf, "CODE", config, F.col("_literals"))).otherwise(doc) if code else doc


@lru_cache(maxsize=32)
def _found(config: ScanConfig, code: bool = False) -> Column:
    return F.transform("_leaves", lambda leaf: _found_in(leaf, config, code))


@lru_cache(maxsize=32)
def _found_in_code(config: ScanConfig) -> Column:
    return F.transform("_leaves", lambda leaf: findings_of(leaf, "CODE", config, F.col("_literals")))


def _planned(config: ScanConfig | None, df: DataFrame) -> ScanConfig:
    """The configuration with lists that are too long for the plan as tables."""
    config = with_rule_index((config or ScanConfig()).tables(df.sparkSession))
    return config if config.names_table is None else replace(config, joined_labels=name_labels(config.names_table))


def _joins(config: ScanConfig) -> bool:
    """Whether a scan has parts that are not expressions of the row."""
    return any(x is not None for x in (config.names_table, config.ignore_table, config.rules_index, config.model))


def _with_found(rows: DataFrame, config: ScanConfig, code: bool = False) -> DataFrame:
    """Rows with ``_leaves`` and the findings in each of them, ``_found``; long lists are joined.

    They come back by a hash of the leaves and the engine, which is all that findings depend on. Rows are
    stored in scratch for that, originals included.
    """
    in_row = replace(config, ignore_table=None, names_table=None, rules_index=None, model=None)
    if not _joins(config):
        return rows.withColumn("_found", _found(in_row, code))
    kind = F.col("kind") if code else F.lit("DOC")
    rows = rows.withColumn("_key", F.concat(F.when(kind == "CODE", "C").otherwise("D"), content_key(F.col("_leaves"))))
    # taken apart and detected once: the joins read the stored rows
    found = rows = stored(rows.withColumn("_found", _found(in_row, code)), "leaves")
    if config.names_table is not None or config.rules_index is not None or config.model is not None:
        leaves = rows.select("_key", F.posexplode_outer("_leaves").alias("_leaf", "text")).where("text is not null")
        hits = []
        for k in ("CODE", "DOC") if code else ("DOC",):
            of_kind = leaves.where(F.col("_key").startswith(k[0]))
            if config.names_table is not None:
                hits.append(name_findings(of_kind, config.names_table, k, config, ["_key", "_leaf"]))
            scanned = of_kind.withColumn("kind", F.lit(k)).withColumn("findings", empty(FINDING)).withColumnRenamed("_key", "_row_key")
            if config.rules_index is not None:
                hits.append(_found_rows(add_rules(scanned, config.rules_index, k, config)))
            if config.model is not None:
                hits.append(_found_rows(add_model(scanned, config.model, config)))
        # bounded by the words of the one leaf; rows of the same leaves bring the same findings
        per_leaf = reduce(DataFrame.union, hits).groupBy("_key", "_leaf").agg(F.collect_set("f").alias("fs"))
        names = F.struct(F.col("_leaf").alias("leaf"), F.lit(1).alias("side"), "fs")
        found = found.join(per_leaf.groupBy("_key").agg(F.collect_list(names).alias("_names")), "_key", "left")
        found = found.withColumn("_found", _merged(F.col("_found"), F.col("_names"))).drop("_names")
    if config.ignore_table is not None:
        found = with_allowed(found, config.ignore_table, F.flatten("_found"))
        found = found.withColumn("_found", F.transform("_found", without_allowed)).drop("_allowed")
    return found.drop("_key")


def _found_rows(scanned: DataFrame) -> DataFrame:
    return scanned.select(F.col("_row_key").alias("_key"), "_leaf", F.explode_outer("findings").alias("f")).where("f is not null")


def _merged(found: Column, names: Column) -> Column:
    """The findings of each leaf with those of names, which only some leaves have."""
    item = f"array<struct<leaf:int,side:int,fs:array<{FINDING}>>>"
    own = F.transform(found, lambda fs, leaf: F.struct(leaf.alias("leaf"), F.lit(0).alias("side"), fs.alias("fs"))).cast(item)

    def of_leaf(entries: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            # what a leaf has of names stands right behind its own findings
            after = F.get(entries, i + 1)
            more = F.when(after["side"] == 1, after["fs"]).otherwise(empty(FINDING))
            return F.when(e["side"] == 0, F.sort_array(F.concat(e["fs"], more)))

        return F.filter(F.transform(entries, one), lambda fs: fs.isNotNull())

    merged = let(F.sort_array(F.concat(own, names.cast(item))), of_leaf)
    return F.when(names.isNull(), found).otherwise(merged)


def _with_result(rows: DataFrame, config: ScanConfig, code: bool = False) -> DataFrame:
    """Rows with ``_leaves`` and what becomes of them: ``_new`` leaves, what was ``_placed``, ``_findings`` and the leaf of each, ``_which``.

    Columns that nobody reads afterwards are not worked out.
    """
    one_sheet = not _joins(config) and on_one_sheet(config)
    if one_sheet and not code:
        return with_sheet(rows, config)
    # step by step: one expression of all this is too deep for the analyzer
    own = F.col("kind") == "CODE"
    if one_sheet:
        found = rows.withColumn("_found", F.when(own, _found_in_code(config)))
    else:
        found = _with_found(rows, config, code)
    done = found.withColumn("_kept", F.transform("_found", resolve)).withColumn("_done", scrub_kept(F.col("_leaves"), F.col("_kept")))
    leafwise = {"_new": F.col("_done.leaves"), "_placed": F.col("_done.placed")}
    if one_sheet:
        # of many small rows, findings as structs are had sooner leaf by leaf; the sheet is for what is rewritten
        done = with_sheet(done, config, ~own).withColumn("_found", F.coalesce(F.col("_found"), _found(config)))
        leafwise = {name: F.when(own, of_code).otherwise(F.col(name)) for name, of_code in leafwise.items()}
    leafwise["_findings"] = F.flatten("_found")
    leafwise["_which"] = F.flatten(F.transform("_found", lambda fs, leaf: F.transform(fs, lambda _: leaf)))
    return done.withColumns(leafwise).drop("_found", "_kept", "_done")


def scan_leaves(
    docs: DataFrame, config: ScanConfig | None = None, text_col: str = "text", code: bool = False, formats: Sequence[str] = STRUCTURED,
) -> DataFrame:
    """The findings in each leaf of each document, with numbers and placeholders of the kept ones.

    Adds ``kind``, ``engine``, ``leaves`` (rewritten), ``placed``, and ``findings`` with the leaf of each in
    ``finding_leaves``. With ``code``, rows whose ``kind`` (or path) says so go to the engine for sources.
    """
    return _scanned(docs, config, text_col, code, formats).drop("_leaves", "_tokens")


def _scanned(docs: DataFrame, config: ScanConfig | None, text_col: str, code: bool, formats: Sequence[str]) -> DataFrame:
    config = _planned(config, docs)
    # a second name for the leaves of the input keeps them in reach of the rewritten ones
    taken = with_leaves(docs, text_col, formats).withColumnRenamed("leaves", "_leaves")
    if code:
        known = "kind" in docs.columns
        taken = taken.withColumn("kind", F.col("kind") if known else kind_of(F.col("path")) if "path" in docs.columns else F.lit("DOC"))
        is_code = F.col("kind") == "CODE"
        literals = native_literals(F.col(text_col), is_code, config.suspicious) if config.native_sites else suspicious_literals(F.col(text_col), is_code, config.suspicious, apart=True)
        taken = taken.withColumn("_literals", literals)
    else:
        taken = taken.withColumn("kind", F.lit("DOC"))

    done = _with_result(taken, config, code)
    done = done.withColumns({"leaves": F.col("_new"), "placed": F.col("_placed"), "findings": F.col("_findings"), "finding_leaves": F.col("_which"), "engine": F.col("kind")})
    return done.drop("_new", "_placed", "_findings", "_which", "_literals")


def scrub_structured(
    docs: DataFrame, config: ScanConfig | None = None, text_col: str = "text", code: bool = False, formats: Sequence[str] = STRUCTURED,
) -> DataFrame:
    """Documents of any format scrubbed in that format; what fails to parse, as plain text.

    Where only some formats come, naming them in ``formats`` leaves the others out of the plan; rows of a
    format not named are scrubbed as plain text.
    """
    done = _scanned(docs, config, text_col, code, formats)
    fmt = F.col("fmt")
    last = F.element_at(F.concat("leaves", F.array(F.lit(None).cast("string"))), F.greatest(F.size("leaves"), F.lit(1)))
    text = last
    python = [f for f in ("csv", "xml") if f in formats]
    if python:
        whole = fmt.isin(*python) & ~F.col("fallback")
        text = F.when(whole, _put_together(fmt, F.when(whole, F.col(text_col)), F.when(whole, F.col("leaves")))).otherwise(text)
    if "json" in formats:
        rebuilt = written_json(F.col("_tokens"), F.col("_leaves"), F.col("leaves"))
        text = F.when(F.col("_tokens").isNotNull() & ~F.col("fallback"), rebuilt).otherwise(text)
    return done.withColumn("_text", text).withColumn(text_col, F.col("_text")).drop("_text", "_leaves", "_tokens")


def scrub_any(docs: DataFrame, config: ScanConfig | None = None, text_col: str = "text") -> DataFrame:
    """A mixed table: sources by the engine for sources, JSON, CSV and XML string by string, the rest as text.

    ``docs`` has ``path``, or ``kind`` and ``fmt``. The result serves the sinks, findings and risk alike.
    """
    return scrub_structured(docs, config, text_col, code=True)


# --- structured columns -----------------------------------------------------------------------


def _fixed(dtype: T.DataType) -> int | None:
    """How many leaves every value of a type has, null or not; None if that depends on the value."""
    if isinstance(dtype, T.StringType):
        return 1
    if isinstance(dtype, T.StructType):
        sizes = [_fixed(f.dataType) for f in dtype.fields]
        return None if None in sizes else sum(sizes)
    return None if isinstance(dtype, (T.ArrayType, T.MapType)) else 0


def leaves_of(value: Column, dtype: T.DataType) -> Column:
    """The strings in a column of any nested type, in field order; keys of maps are left out.

    A string is a leaf even if it is null, so that the places of most leaves are known beforehand.
    """
    none = empty("string")
    if isinstance(dtype, T.StringType):
        return F.array(value)
    if isinstance(dtype, T.StructType) and dtype.fields:
        return joined_leaves([(value[f.name], f.dataType) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda v: leaves_of(v, dtype.elementType))), none)
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda v: leaves_of(v, dtype.valueType))), none)
    return none


def joined_leaves(parts: list[tuple[Column, T.DataType]]) -> Column:
    """The leaves of several values in order; neighbouring strings share one array."""
    out: list[Column] = []
    strings: list[Column] = []
    for value, dtype in parts:
        if isinstance(dtype, T.StringType):
            strings.append(value)
        elif _fixed(dtype) != 0:
            out += ([F.array(*strings)] if strings else []) + [leaves_of(value, dtype)]
            strings = []
    out += [F.array(*strings)] if strings else []
    return F.concat(*out) if len(out) > 1 else out[0] if out else empty("string")


def _in_turn(parts: list[tuple[Column, T.DataType]], at: Column, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` with the index at which the leaves of each part begin.

    After fixed numbers of leaves the index is a constant more; the sizes of other parts are added up
    once, in one array.
    """
    loose = [F.size(leaves_of(v, t)) for v, t in parts if _fixed(t) is None]

    def places(first: Column | None) -> list[Column]:
        out, known, passed = [], 0, 0
        for _, dtype in parts:
            begin = at + F.lit(known)
            out.append(begin + F.get(first, F.lit(passed)) if first is not None and passed else begin)
            width = _fixed(dtype)
            known, passed = (known + width, passed) if width is not None else (known, passed + 1)
        return out

    if not loose:
        return body(places(None))
    # one size more than there are parts to pass, so that the running sum reaches the parts after the last
    return let(offsets(F.array(*loose, F.lit(0))), lambda first: body(places(first)))


def with_leaves_replaced(value: Column, dtype: T.DataType, leaves: Column, at: Column) -> Column:
    """The same value with its strings taken from ``leaves``, beginning at index ``at``."""
    if isinstance(dtype, T.StringType):
        return F.get(leaves, at)
    if _fixed(dtype) == 0:
        return value
    if isinstance(dtype, T.StructType):
        parts = [(value[f.name], f.dataType) for f in dtype.fields]
        new = _in_turn(parts, at, lambda begins: F.struct(*(
            with_leaves_replaced(v, t, leaves, b).alias(f.name) for (v, t), b, f in zip(parts, begins, dtype.fields)
        )))
    elif isinstance(dtype, T.ArrayType):
        new = _elements_replaced(value, dtype.elementType, leaves, at)
    else:
        new = F.map_from_arrays(F.map_keys(value), _elements_replaced(F.map_values(value), dtype.valueType, leaves, at))
    return F.when(value.isNotNull(), new)


def _replaced(value: Column, dtype: T.DataType, leaves: Column, at: Column) -> Column:
    """The same, worked out once where elements ask for their leaves one by one."""
    if _fixed(dtype) is not None:
        return with_leaves_replaced(value, dtype, leaves, at)
    return let(leaves, lambda all_leaves: let(at, lambda first: with_leaves_replaced(value, dtype, all_leaves, first)))


def _elements_replaced(values: Column, dtype: T.DataType, leaves: Column, at: Column) -> Column:
    width = _fixed(dtype)
    if width is not None:
        return F.transform(values, lambda v, i: with_leaves_replaced(v, dtype, leaves, at + i * width))
    sizes = F.transform(values, lambda v: F.size(leaves_of(v, dtype)))
    return let(
        offsets(sizes),
        lambda first: F.transform(values, lambda v, i: with_leaves_replaced(v, dtype, leaves, at + F.get(first, i))),
    )


def scrub_columns(df: DataFrame, columns: list[str], config: ScanConfig | None = None) -> DataFrame:
    """Each row is a document; the strings at any depth of ``columns`` are scrubbed in place."""
    config = _planned(config, df)
    parts = [(F.col(c), df.schema[c].dataType) for c in columns]
    found = df.withColumn("_leaves", joined_leaves(parts))
    done = _with_result(found, config)
    done = done.withColumn("placed", F.col("_placed")).withColumn("findings", F.col("_findings"))
    leaves = F.col("_new")
    # where each column begins, as one array that is worked out once
    begins = _in_turn(parts, F.lit(0), lambda places: F.array(*places))
    if all(_fixed(t) is not None for _, t in parts):
        at, place = 0, {}
        for c, (_, dtype) in zip(columns, parts):
            place[c] = F.lit(at)
            at += _fixed(dtype)
    else:
        done = done.withColumn("_begins", begins)
        place = {c: F.get(F.col("_begins"), F.lit(i)) for i, c in enumerate(columns)}
    replaced = {c: _replaced(v, t, leaves, place[c]) for c, (v, t) in zip(columns, parts)}
    return done.withColumns(replaced).drop("_leaves", "_new", "_placed", "_findings", "_which", "_begins")


# --- a whole table as one document ------------------------------------------------------------

# Rows are numbered in blocks of about this many: enough for few blocks, little enough for a task.
BLOCK_ROWS = 65_536


def scrub_table(
    df: DataFrame, columns: list[str], order_by: str, block_by: Column, scope_by: str | None = None,
    config: ScanConfig | None = None,
) -> DataFrame:
    """Rows as lines of one document (for each ``scope_by``): placeholders are numbered throughout.

    ``order_by`` gives the order of rows and ``block_by`` a coarser value that never decreases with
    it. Counts run within blocks, which spread over the cluster, and then over one small row for
    each block; no task ever holds a whole table or a whole file. Findings are stored in scratch
    meanwhile, originals included.
    """
    config = _planned(config, df)
    labels = list(dict.fromkeys(r.label for r in config.rules("DOC")))
    scope = F.col(scope_by) if scope_by else F.lit(0)
    leaves = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    rows = df.withColumn("_scope", scope).withColumn("_block", block_by).withColumn("_leaves", leaves)
    rows = _with_found(rows, config).withColumnRenamed("_found", "_findings")
    rows = rows.withColumn("_kept", F.transform("_findings", resolve))
    kept_labels = F.transform(F.flatten("_kept"), lambda f: f["label"])
    # counted once per row, for the labels it has
    counts = F.map_from_entries(
        F.transform(
            F.array_distinct(kept_labels),
            lambda label: F.struct(label, F.size(F.filter(kept_labels, lambda x: x == label)).cast("bigint")),
        )
    )
    # detected once: what follows reads the stored rows, for the counts of blocks and for the rows
    rows = stored(rows.withColumn("_counts", counts), "scrub-table")

    per_block = [F.sum(F.element_at("_counts", F.lit(label))).alias(f"_n{i}") for i, label in enumerate(labels)]
    blocks = rows.select("_scope", "_block", "_counts").groupBy("_scope", "_block").agg(*per_block)
    earlier_blocks = "rows between unbounded preceding and 1 preceding"
    base = blocks.select(
        "_scope", "_block",
        F.array(*[
            F.expr(f"coalesce(sum(_n{i}) over (partition by _scope order by _block {earlier_blocks}), 0L)")
            for i in range(len(labels))
        ]).alias("_base"),
    )
    earlier_rows = Window.partitionBy("_scope", "_block").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    running = F.array(*[
        F.coalesce(F.sum(F.element_at("_counts", F.lit(label))).over(earlier_rows), F.lit(0).cast("bigint"))
        for label in labels
    ])
    placed = rows.withColumn("_running", running).join(base, ["_scope", "_block"])
    placed = placed.withColumn("_start", F.zip_with("_running", "_base", lambda a, b: a + b))

    def base_of(label: Column) -> Column:
        return F.get(F.col("_start"), (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("int"))

    result = placed.withColumn("_result", scrub_kept(F.col("_leaves"), F.col("_kept"), base_of))
    result = result.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.get(F.col("_result.leaves"), F.lit(i))) for i, c in enumerate(columns)}
        | {"placed": F.col("_result.placed"), "findings": F.flatten("_findings")}
    )
    return result.drop("_scope", "_block", "_leaves", "_findings", "_kept", "_counts", "_running", "_base", "_start", "_result")
