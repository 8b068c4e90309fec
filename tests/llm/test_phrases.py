"""Collocations beside a count of all phrases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from inkblot.llm import phrases


def plain_collocations(rows, least=30, top=2000, cover=80):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        found = []
        for p, a in f.items():
            if len(p) == 1:
                continue
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for q, b in f.items())
            if inside:
                continue
            cuts = [(int(Fraction(2_000_000 * a, f[p[:k]] + f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "New", "york", "é", "café", "x", " ", "San", "fran", "cisco", "a-b"]
    rows = []
    for i in range(300):
        text = []
        for _ in range(rng.randint(0, 25)):
            text.append(rng.choice(["new york", "San Fran cisco", "the of the of", *words]))
            text.append(rng.choice([" ", "  ", "\t", ". ", "\n", " ", " ", "\x0b", "\x1c "]))
        rows.append(("".join(text), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), ("...", "fr"), ("the of " * 4000, "en"), ("word" * 3000, "en"), *[("same text here", "de")] * 40]


def as_docs(make_docs, rows, *more):
    return make_docs([(i, t, lang) for i, (t, lang) in enumerate(rows)], *more)


def test_collocations(make_docs):
    rows = corpus()
    df = as_docs(make_docs, rows, "phrase", "words", "f", "rank", "kept")
    got = phrases.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_a_full_bit_map_and_short_lists_change_nothing(make_docs):
    rows = corpus()
    got = phrases.collocations(as_docs(make_docs, rows), least=12, top=9, bits=64)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 12, 9)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_slices_count_each_phrase_once(size, length):
    blob = "\n".join([*(t or "" for t, _ in corpus()), " " * 500, "x" + "\t" * 300 + "y", " "]).encode().translate(phrases.TO_PIECES)
    found, want = Counter(), Counter()
    known = [None] * length  # every phrase counts as frequent
    for words in phrases.word_slices(blob, size):
        names, counts = phrases.slice_counts(words, length, known, b"en")
        found.update(dict(zip(names.to_pylist(), counts.tolist())))
    for piece in blob.split(b"\n"):
        words = re.findall(rb"[^ \t]+", piece)
        want.update(b" ".join(words[i : i + length]) for i in range(len(words) - length + 1))
    assert found == want


def test_counts_beyond_64_bit_products(spark):
    rows = [("en", ["a"], 8 * 10**15), ("en", ["b"], 7 * 10**15), ("en", ["a", "b"], 6 * 10**15)]
    df = phrases.candidates(spark.createDataFrame(rows, "lang string, words array<string>, f long"))
    (got,) = df.select("f", phrases.weakest_cut().alias("c"), "longer").collect()
    assert (got.c.score, got.c.l, got.c.r, got.longer) == (2_000_000 * 6 // 15, 8 * 10**15, 7 * 10**15, 0)


def test_empty_table(make_docs):
    assert phrases.collocations(make_docs([])).collect() == []
