"""Importance resampling beside a plain walk over each text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkblot.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % 10_000 for r in runs]


def plain_scores(rows, target):
    s = Counter(b for _, text in rows for b in plain_runs(text)[1])
    t = Counter(b for text in target for b in plain_runs(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000))))

    out = []
    for doc_id, text in rows:
        n_words, runs = plain_runs(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs))
        out.append([doc_id, n_words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[5] = rank
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abZ9é \n.\0-", max_size=40), min_size=1, max_size=8), st.integers(1, 30))
def test_runs_of_a_batch(texts, size):
    found = Counter()
    blob = [t.encode() for t in texts]
    whole = resample.slices.__defaults__
    resample.slices.__defaults__ = (size,)
    try:
        for n, docs, buckets in resample.bucket_runs(blob):
            found.update(zip([n] * len(docs), docs.tolist(), buckets.tolist()))
    finally:
        resample.slices.__defaults__ = whole
    want = Counter()
    for d, text in enumerate(texts):
        words, runs = plain_runs(text)
        sizes = [1] * words + [2] * max(0, words - 1) + [3] * max(0, words - 2)
        want.update((n, d, b) for n, b in zip(sizes, runs))
    assert found == want


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 300_000))
def test_crc_of_joined_texts(left, size):
    right = b"\xc3x" * (size // 2)
    crc = lambda b: np.array([zlib.crc32(b)], np.uint32)
    got = resample.joined_crc(resample.spaced_crc(crc(left)), crc(right), np.array([len(right)]))
    assert got[0] == zlib.crc32(left + b" " + right)


def rows_of_all_kinds():
    words = "alpha beta Gamma delta EPSILON zeta".split()
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(12 + i % 20))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .. \n"), (203, "A" * 5000), (204, "naïve café 19 " * 4000), (None, "alpha beta " * 30)]
    return rows + [rows[30], rows[30], (31, "other words " * 15)]


def test_scores_and_ranks(make_docs, spark):
    rows = rows_of_all_kinds()
    target = ["alpha beta gamma", None, "alpha beta alpha beta zeta delta"]
    df = make_docs(rows, "rank", "score", "_in", "_part", "bucket")
    got = resample.scores(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain_scores(rows, target)), key=key)


def test_drawn_rows_keep_their_columns(make_docs, spark):
    rows = rows_of_all_kinds()
    df = make_docs(rows, "rank", "_drawn")
    target = spark.createDataFrame([("alpha beta",)], "text string")
    want = {r[0] for r in plain_scores(rows, ["alpha beta"]) if r[5]}
    got = resample.drawn(df, target)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("side", ["docs", "target", "both"])
def test_empty_tables(make_docs, spark, side):
    rows = [] if side != "target" else rows_of_all_kinds()
    target = [] if side != "docs" else ["alpha"]
    got = resample.scores(make_docs(rows), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert len(got) == len(rows)
    if rows:
        assert Counter(map(tuple, got)) == Counter(map(tuple, plain_scores(rows, target)))
