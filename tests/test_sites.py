"""Native assignment sites beside Python's own parser."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkblot.operators.context import python_sites
from inkblot.operators.sites import native_assign_sites, native_sites, unescaped
from inkblot.rules import SUSPICIOUS_NAMES

SAME = [
    "", "x = 1", "password = 'a'", 'password="a"  # comment \'x\'', "a = b = 'lit'", "a = d['k'] = b = \"v\"", "x == 'a'", "x += 'a'", "x: str = 'a'", "x, y = 'a', 'b'",
    "self.password = 'x'", "cfg['password'] = 'pw'", "cfg[0]['a']['b'] = 'c'", "cfg[x] = 'c'", "f(password='a')", "f(\n    password='a',\n    key='b',\n)", "f(\n  a\n)['k'] = 'v'",
    "d = {'a': 'b', \"c\": 'd', 'n': 1, 3: 'x', **e, 'z': {'y': 'w'}}", "d = {\n 'a': 'b',  # note\n\n 'c':\n   'd',\n}", "s = {'a', 'b'}", "d['a':'b']", "x = 'a' if y else 'b'", "x = 'a' + 'b'", "x = 'a' 'b' \"c\"",
    "x = ('a'\n     'b')", "x = (('a'))", "d = {'a': ('b'), ('c'): 'd', 'e' 'f': 'g' 'h'}", "x = b'bytes'", "x = f'{y}'", "x = r'a\\b'", "x = u'a'", "x = R'\\n'", "x = rb'a'", "x = '''a\nb'''", 'x = """a"b""c\n"""', "x = ''",
    "if a: x = 'b'", "if a == 'c': x = 'b'; y = 'd'", "for i in j: x = 'b'", "class A: x = 'b'", "while x: password = 'b'", "try: a = 'b'\nexcept E: c = 'd'", "else_ = 'a'", "a = 'b'; c = 'd' ; e = 'f'", "lambda: 'x'",
    "def f(a='b', *, c='d') -> 'e':\n    g = 'h'\n    return {'i': 'j'}", "  x = 'a'\n  y = 'b'", "x = 'it\\'s'", 'x = "a\\n\\t\\\\\\x41\\u00e9\\U0001F600\\101\\0"', "x = 'a\\\nb'", "x = \\\n  'a'", "x = 'a#b'  # c = 'd'", "# x = 'a'", "'''doc\nx = 'a'\n'''\ny = 'b'",
    "é = 'ü😀'", "x = '\\q'", "print('x = \"y\"')", "x = y = z", "x = [\n'a'\n]", "a = {'b': [\n  {'c': 'd'}]}\n", "x = 'a'\r\ny = 'b'\r\n", "x\t=\t'a'", "x = 'a'.strip()", "x = 'a', ", "x[1] = y['k'] = 'a'", "x['k'].z = 'a'", "(x) = 'a'", "a = (b := 'c')", "x = 'a' # é",
    "def f(\n  a,\n  b='c',\n):\n  key = 'd'\n", "@d('x')\nclass A:\n    token: str = 'a'\n    secret = 'b'\n", "x = '\\x00y'", "d = {'a': 'b' 'c'}", "x = not 'a'", "x = -'a'", "assert x, 'y'\nz = 'w'", "with open('a') as f: b = 'c'", "x = {'a': 'b'}['a']", "from a import b\nb = 'c'",
]
# What this form reads otherwise, and what it finds where Python's parser finds {}.
OTHERWISE = {
    "x = 'a'\n)": [("name", "x", "a")],  # does not parse
    "x = d[0, 'a':'b', 1]": [("dict", "a", "b")],  # a slice after a comma
    "x = '\\N{BULLET}'": [("name", "x", "\\N{BULLET}")],  # named characters are left as spelled
}


def test_sites_as_the_parser_finds_them(texts):
    got = texts(SAME).select("text", native_sites(F.col("text")).alias("s")).collect()
    for r in got:
        assert Counter(map(tuple, r.s)) == Counter(python_sites(r.text)), r.text


def test_where_the_two_differ(texts):
    got = texts(list(OTHERWISE)).select("text", native_sites(F.col("text")).alias("s")).collect()
    for r in got:
        assert list(map(tuple, r.s)) == OTHERWISE[r.text] != python_sites(r.text), r.text


def test_null_and_long_sources(texts):
    long = "password = 'x'\n" * 3000 + "d = {" + ", ".join(f"'key{i}': 'v{i}'" for i in range(3000)) + "}\n" + "x = '" + "y" * 200_000 + "'\n" + "f(" * 500 + ")" * 500
    got = texts([None, long]).select("doc_id", F.size(native_sites(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in got}[1] == 6001


def test_only_suspicious_names_and_no_python(texts):
    df = native_assign_sites(texts(["API_KEY = 'a'\nother = 'b'\nd = {'my_Token': 'c', 'x': 'd'}"]), SUSPICIOUS_NAMES)
    assert [(r.form, r.name, r.literal) for r in df.collect()] == [("name", "API_KEY", "a"), ("dict", "my_Token", "c")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("body", ["a", "\\n", "\\7x", "\\377", "\\400", "\\x4g", "\\u12", "a\\", "\\\\n", "\\ud83d"])
def test_escapes(texts, body):
    (r,) = texts([body]).select(unescaped(F.col("text")).alias("v")).collect()
    try:
        want = eval(f"'{body}'")  # noqa: S307
    except SyntaxError:
        return  # no literal of Python
    assert r.v == (None if any("\ud800" <= c <= "\udfff" for c in want) else want)
