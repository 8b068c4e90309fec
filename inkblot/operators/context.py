"""Assignment context: string literals assigned to names that sound like secrets.

Reading Python source needs Python's own grammar, so the sites are taken with the ``ast`` module in
an Arrow UDF; it gives back names and literals only. Matching the names, finding every occurrence
of the literals and everything after that is done with native expressions.
"""

from __future__ import annotations

import ast
import sys
import textwrap
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty, let
from inkblot.functions.spans import HIT, literal_hit, single_hit

# The helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SITES = "array<struct<form:string,name:string,literal:string>>"
LITERALS = "array<struct<literal:string,copies:int>>"
ASSIGNED = f"struct<sub:int,copies:int,hit:{HIT}>"

# A literal that is not found verbatim is looked up by this much of its two ends.
EDGE = 20


def _string(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _node_sites(node: ast.AST) -> Iterator[tuple[str, str, str]]:
    if isinstance(node, ast.Assign):
        for target in node.targets:
            if isinstance(target, ast.Name):
                yield "name", target.id, _string(node.value)
            elif isinstance(target, ast.Subscript):
                yield "subscript", _string(target.slice), _string(node.value)
    elif isinstance(node, ast.Dict):
        for key, value in zip(node.keys, node.values):
            yield "dict", _string(key), _string(value)


def python_sites(source: str) -> list[tuple[str, str, str]]:
    """(form, name, literal) of each string assignment, outer before inner; none if unparsable."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            pending = [ast.parse(textwrap.dedent(source))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    sites = []
    while pending:
        node = pending.pop()
        sites += [s for s in _node_sites(node) if s[1] is not None and s[2] and _is_text(s[1] + s[2])]
        pending.extend(reversed(list(ast.iter_child_nodes(node))))
    return sites


def _is_text(value: str) -> bool:
    # a lone surrogate, written as an escape, cannot stand in any stored text
    return not any("\ud800" <= c <= "\udfff" for c in value)


def _may_hold_sites(text: Column) -> Column:
    quoted = F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))
    return quoted & (F.contains(text, F.lit("=")) | F.contains(text, F.lit("{")))


def site_array(text: Column) -> Column:
    """All string assignments of each source."""

    @F.pandas_udf(SITES)
    def sites(sources: pd.Series) -> pd.Series:
        fields = ("form", "name", "literal")
        return sources.map(lambda s: [] if s is None else [dict(zip(fields, site)) for site in python_sites(s)])

    return sites(F.when(_may_hold_sites(text), text))


def suspicious_literals(text: Column, is_code: Column, words: Sequence[str], apart: bool = False) -> Column:
    """The distinct literals given to suspicious names, in order, and how many sites give each.

    Texts that are not source code, and sources that can hold no site, are not sent to Python. With
    ``apart``, the optimizer keeps this step below others that use Python.
    """
    words = tuple(words)

    @F.pandas_udf(LITERALS)
    def literals(sources: pd.Series) -> pd.Series:
        def of_one(source: str | None) -> list[dict]:
            counted = Counter(
                literal for _, name, literal in (python_sites(source) if source is not None else ())
                if any(word in name.lower() for word in words)
            )
            return [{"literal": literal, "copies": copies} for literal, copies in counted.items()]

        return sources.map(of_one)

    read = literals.asNondeterministic() if apart else literals
    return read(F.when(is_code & _may_hold_sites(text), text))


def is_suspicious(name: Column, words: Sequence[str]) -> Column:
    lowered = F.lower(name)
    test = F.lit(False)
    for word in words:
        test = test | F.contains(lowered, F.lit(word))
    return test


def assign_sites(docs: DataFrame, words: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each string literal assigned to a suspicious name."""
    found = docs.select(id_col, site_array(F.col(text_col)).alias("site"))
    return (
        found.select(id_col, F.posexplode_outer("site").alias("site_ord", "site"))
        .select(id_col, "site_ord", "site.*")
        .where(F.col("form").isNotNull() & is_suspicious(F.col("name"), words))
    )


def _by_edges(text: Column, literal: Column) -> Column:
    """The span from the first occurrence of the literal's head to the next of its tail.

    Used for literals whose value differs from their spelling in the source.
    """
    head, tail = F.substring(literal, F.lit(1), F.lit(EDGE)), F.right(literal, F.lit(EDGE))

    def hit(begin: Column, tail_at: Column) -> Column:
        snippet = F.substring(text, begin, tail_at + EDGE - begin)
        return F.when(tail_at > 0, single_hit(snippet, F.substring(text, F.lit(1), begin - 1)))

    return let(
        F.call_function("locate", head, text, F.lit(1)),
        lambda begin: F.when(
            begin > 0, let(F.call_function("locate", tail, text, begin), lambda tail_at: hit(begin, tail_at))
        ),
    )


def assigned_hits(text: Column, literals: Column) -> Column:
    """Every occurrence of every literal of :func:`suspicious_literals`, a hit for each literal.

    Two sites with one value find the same spans twice. Such copies are counted in ``copies``
    instead of being repeated, since their number grows with the square of the source.
    """

    def of_literal(x: Column, sub: Column) -> Column:
        literal = x["literal"]
        edges = F.when(F.contains(literal, F.lit("\n")), _by_edges(text, literal))
        found = F.coalesce(literal_hit(text, literal), edges)
        return F.struct(sub.alias("sub"), x["copies"].alias("copies"), found.alias("hit"))

    return F.coalesce(F.transform(literals, of_literal), empty(ASSIGNED))
