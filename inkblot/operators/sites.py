"""Assignment sites of Python sources by native expressions: a lexer made of marked cuts, then three forms.

String literals become marks, comments and bodies of strings go, and line feeds inside brackets become
blanks, so that what is left is one logical line for each statement. On it a site is one of three forms: a
name, or a subscript by a string, on the left of ``=`` with a string on the right of it, and a string key
with a string value in braces. Escapes of literals are then decoded.

Unlike ``operators.context``, which has Python's own parser read a source, this form runs no Python, spreads
over long sources and does not ask whether the whole source parses. They differ where a source does not parse
(sites are found here all the same), in annotated slices and patterns that hold ``"a": "b"`` after a comma
without being a dictionary, in ``\\N{...}`` escapes (left as spelled) and in the order of nested sites (here
by place).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty, let, offsets
from inkblot.operators.context import LITERALS, SITES, is_suspicious

# Marks that stand for what was cut out. Where a source has such characters itself, they become blanks.
OPEN, CLOSE, OTHER, BLANK = "\x01", "\x02", "\x03", "\x0c"
_TRIPLE = r"'''(?:[^'\\]++|\\.|'(?!''))*+'''" + "|" + r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
_SINGLE = r"'(?:[^'\\\n]++|\\.)*+'" + "|" + r'"(?:[^"\\\n]++|\\.)*+"'
# a prefix of letters is part of a literal unless it ends a longer name
LEXEMES = rf"(?s)#[^\n]*+|(?<![\p{{L}}\p{{N}}_])[A-Za-z]{{1,2}}(?:{_TRIPLE}|{_SINGLE})|{_TRIPLE}|{_SINGLE}"
BRACKETS = r"[\[\](){}\n]"

NAME = r"[\p{L}_][\p{L}\p{N}_]*+"
LITERAL = rf"{OPEN}\d++{CLOSE}"
# neighbouring literals are one string; a string may stand in round brackets
_WHOLE = rf"(?:\([ \t\x0c]*+)*+({LITERAL}(?:[ \t\x0c]*+{LITERAL})*+)(?:[ \t\x0c]*+\))*+"
_SUITE = r"(?:(?:if|elif|else|for|while|try|except|finally|with|def|class|async)\b[^\n]*?:[ \t\x0c]*+)?"
# a statement: targets, each before a single '=', and a string up to the end of the statement
STATEMENT = rf"(?m)(?:^|(?<=;))[ \t\x0c]*+{_SUITE}((?:[^=\n;:!<>+\-*/%&|^@]++=(?!=)[ \t\x0c]*+)++){_WHOLE}[ \t\x0c]*+(?=$|;)"
ENTRY = rf"(?<=[{{,])[ \t\x0c]*+{_WHOLE}[ \t\x0c]*+:[ \t\x0c]*+{_WHOLE}[ \t\x0c]*+(?=[,}}])"

_SIMPLE = {"\\": "\\", "'": "'", '"': '"', "a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "\n": ""}
ESCAPE = r"(?s)\\(?:[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\\'\"abfnrtv\n])"


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern and what lies between them, one more."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _woven(gaps: Column, between: Column) -> Column:
    """Gaps with something put between each two."""
    return F.array_join(F.zip_with(gaps, F.concat(between, F.array(F.lit(""))), lambda g, b: F.concat(g, b)), "")


def _point(hexed: Column) -> Column:
    """The character of a code point, given in hexadecimal digits; null for what no text can hold."""
    n = F.conv(hexed, 16, 10).cast("long")
    high, low = F.floor((n - 0x10000) / 1024) + 0xD800, (n - 0x10000) % 1024 + 0xDC00
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(high.cast("long")), F.hex(low.cast("long"))))
    stored = (n <= 0x10FFFF) & ((n < 0xD800) | (n > 0xDFFF))
    return F.when(stored, F.decode(F.unhex(units), "UTF-16BE"))


def unescaped(body: Column) -> Column:
    """The value of a literal's body; null if it holds what no stored text can hold."""

    def one(e: Column) -> Column:
        digits = F.substring(e, 2, 9)
        value = F.when(digits.rlike("^[0-7]"), _point(F.conv(digits, 8, 16)))
        value = value.when(digits.rlike("^[xuU]"), _point(F.substring(digits, F.lit(2), F.lit(8))))
        return value.otherwise(F.element_at(F.create_map(*(F.lit(x) for pair in _SIMPLE.items() for x in pair)), digits))

    escapes, gaps = _cut(body, ESCAPE)
    decoded = let(F.transform(escapes, one), lambda es: F.when(F.forall(es, lambda e: e.isNotNull()), _woven(gaps, es)))
    return F.when(F.contains(body, F.lit("\\")), decoded).otherwise(body)


def _value(literal: Column) -> Column:
    """What a string literal with its quotes, and a prefix of r or u, stands for."""
    prefix = F.regexp_extract(literal, "^[A-Za-z]*", 0)
    quoted = F.substring(literal, F.length(prefix) + 1, F.length(literal))
    triple = quoted.rlike("^('''|\"\"\")")
    body = F.when(triple, F.substring(quoted, F.lit(4), F.length(quoted) - 6)).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.when(F.lower(prefix).contains("r"), body).otherwise(unescaped(body))


def _masked(text: Column) -> Column:
    """``struct<source, strings>``: logical lines with a numbered mark for each string."""
    clean = F.translate(F.regexp_replace(text, r"\r\n?", "\n"), OPEN + CLOSE + OTHER, "   ")

    def masked(tokens: Column, gaps: Column) -> Column:
        marks = F.transform(
            tokens,
            lambda t, i: F.when(t.startswith("#"), F.lit(""))
            .when(t.rlike("^[rRuU]?['\"]"), F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(F.lit(OTHER)),
        )
        joined = F.regexp_replace(_woven(gaps, marks), r"\\\n", " ")
        return F.struct(let(joined, _one_line_each).alias("source"), tokens.alias("strings"))

    return let(clean, lambda t: let(F.regexp_extract_all(t, F.lit(LEXEMES), F.lit(0)), lambda ts: masked(ts, F.split(t, LEXEMES, -1))))


def _one_line_each(source: Column) -> Column:
    """Line feeds inside brackets become blanks."""

    def joined(marks: Column, gaps: Column) -> Column:
        steps = F.transform(marks, lambda m: F.when(m.isin("(", "[", "{"), 1).when(m == "\n", 0).otherwise(-1))
        return let(offsets(steps), lambda depth: _woven(gaps, F.transform(marks, lambda m, i: F.when((m == "\n") & (F.get(depth, i) > 0), F.lit(BLANK)).otherwise(m))))

    marks, gaps = _cut(source, BRACKETS)
    return let(marks, lambda ms: joined(ms, gaps))


def _string_of(marks: Column, strings: Column) -> Column:
    """The value of one literal or of several side by side."""
    numbers = F.regexp_extract_all(marks, F.lit(rf"{OPEN}(\d+)"), F.lit(1))
    parts = F.transform(numbers, lambda n: _value(F.get(strings, n.cast("int"))))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, ""))


def _site(form: str, name: Column, literal: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), name.alias("name"), literal.alias("literal"))


def _of_statements(source: Column, strings: Column) -> Column:
    def of_one(statement: Column) -> Column:
        targets = F.filter(F.split(F.regexp_extract(statement, STATEMENT, 1), "="), lambda t: F.trim(F.translate(t, "\t\f", "  ")) != "")

        def of_target(t: Column, literal: Column) -> Column:
            bare = F.regexp_replace(F.translate(t, "\t\f", "  "), r"^[ (]+|[ )]+$", "")
            key = F.regexp_extract(bare, rf"[\p{{L}}\p{{N}}_\])]\s*\[[ (]*((?:{LITERAL}\s*)+)[ )]*\]$", 1)
            return F.when(bare.rlike(f"^{NAME}$"), _site("name", bare, literal)).when(key != "", _site("subscript", _string_of(key, strings), literal))

        return let(_string_of(F.regexp_extract(statement, STATEMENT, 2), strings), lambda literal: F.transform(targets, lambda t: of_target(t, literal)))

    return F.flatten(F.transform(F.regexp_extract_all(source, F.lit(STATEMENT), F.lit(0)), of_one))


def _of_entries(source: Column, strings: Column) -> Column:
    def of_one(entry: Column) -> Column:
        return _site("dict", _string_of(F.regexp_extract(entry, rf"^[^{OPEN}]*+({LITERAL}(?:[ \t\x0c]*+{LITERAL})*+)", 1), strings), _string_of(F.regexp_extract(entry, ":(.*)$", 1), strings))

    return F.transform(F.regexp_extract_all(source, F.lit(ENTRY), F.lit(0)), of_one)


def native_sites(text: Column) -> Column:
    """All string assignments of a source: names and subscripts by statement, then entries of dictionaries."""
    may = (F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))) & (F.contains(text, F.lit("=")) | F.contains(text, F.lit("{")))

    def both(m: Column) -> Column:
        return F.concat(_of_statements(m["source"], m["strings"]), _of_entries(m["source"], m["strings"]))

    found = F.filter(let(_masked(text), both), lambda s: s.isNotNull() & s["name"].isNotNull() & (F.length(s["literal"]) > 0))
    return F.when(F.coalesce(may, F.lit(False)), found.cast(SITES)).otherwise(empty(SITES.removeprefix("array<").removesuffix(">")))


def native_assign_sites(docs: DataFrame, words: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each string literal assigned to a suspicious name."""
    found = docs.select(id_col, native_sites(F.col(text_col)).alias("site"))
    rows = found.select(id_col, F.posexplode_outer("site").alias("site_ord", "site")).select(id_col, "site_ord", "site.*")
    return rows.where(F.col("form").isNotNull() & is_suspicious(F.col("name"), words))


def native_literals(text: Column, is_code: Column, words: Sequence[str]) -> Column:
    """The distinct literals given to suspicious names, and how many sites give each, as the context detector reads them."""

    def counted(all_: Column) -> Column:
        return F.transform(F.array_distinct(all_), lambda x: F.struct(x.alias("literal"), F.size(F.filter(all_, lambda y: y == x)).alias("copies")))

    named = F.filter(native_sites(F.when(is_code, text)), lambda s: is_suspicious(s["name"], words))
    return let(F.transform(named, lambda s: s["literal"]), counted).cast(LITERALS)
