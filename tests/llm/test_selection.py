"""Mixing, sharding, URL filters and neighbours."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkblot.llm import ann, mixing, sharding, urls
from inkblot.llm.common import tasks_for


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Share out, stop at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= cap * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return target


def mix_rows():
    rows = [(i, "w " * (1 + i % 37), "en", ["big", "big", "big", "b", "Z", "é", None][i % 7]) for i in range(1400)]
    return rows + [(5000, None, "en", "empty"), (5001, "", "en", "empty"), (None, "one two", "en", "b"), (7, "w " * 8, "en", "big")]


def test_targets_and_copies(make_docs):
    rows = mix_rows()
    got = mixing.mix_report(make_docs(rows, "rate", "copies", "target", "_mix")).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    by_id = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        source = by_id[r.doc_id][3]
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken == r.size * r.copies <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.1)
    again = mixing.mix_report(make_docs(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_keep_their_columns(make_docs):
    df = make_docs(mix_rows()[:200], "rate", "_mix", "_again")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in mixing.mix_report(df).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert mixing.mixed(df.where("false")).collect() == [] and mixing.mix_report(df.where("false")).collect() == []


def shard_rows():
    return [(i, "é" * (i % 50) + "x" * (i * 7919 % 900)) for i in range(2000)] + [(1, "x"), (1, "x"), (None, "a"), (None, None), (3000, "")]


def test_shards_have_equal_bytes_and_gapless_places(make_docs, tmp_path, spark):
    rows = shard_rows()
    path = str(tmp_path / "maps")
    got = sharding.shard(make_docs(rows, "size", "shard", "virtual_slot"), map_path=path).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    places, loads = {}, [0] * 16
    for r in got:
        if r.doc_id is not None and r.doc_id != 1:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        places.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and r.map_version == 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 16
    assert max(loads) - min(loads) < 0.02 * max(loads)
    assert sharding.load_map(spark, path).count() == sharding.SLOTS


def test_records_are_written_to_no_more_files_than_tasks_read(make_docs, spark):
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = make_docs([(i, f"text {i % 90}") for i in range(300)])
        out = sharding.shard(docs)
        assert out.rdd.getNumPartitions() <= tasks_for(docs) < 60
        rows = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 300
    for s in range(sharding.SHARDS):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_map_is_edited_not_made_anew(make_docs, tmp_path, spark):
    path = str(tmp_path / "maps")
    sums = sharding.slot_sums(sharding.records_of(make_docs(shard_rows()), 512), 512).cache()
    first = sharding.new_map(sums, 16)
    sharding.store_map(first, path)
    same = sharding.rebalanced(sharding.load_map(spark, path), sums, 16)
    moved = lambda a, b: a.drop("version").exceptAll(b.drop("version")).count()
    assert moved(first, same) == 0
    grown = sharding.rebalanced(sharding.load_map(spark, path), sums, 17)
    sharding.store_map(grown, path)
    now = sharding.load_map(spark, path)
    assert now.select("version").distinct().first()[0] == 2 and sharding.load_map(spark, path, 1).count() == 512
    assert 0 < moved(first, now) < 512 / 8
    loads = [r.b for r in now.join(sums, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(loads) == 17 and max(loads) < 1.1 * min(loads)
    fewer = sharding.rebalanced(now, sums, 4)
    assert fewer.select(F.max("shard")).first()[0] == 3 and fewer.count() == 512


def test_empty_shards(make_docs):
    assert sharding.shard(make_docs(shard_rows()).where("false")).collect() == []


def page_rows():
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.example.com/en/{i}") for i in range(400)]
    return rows + [
        (1000, None), (1001, "no scheme"), (1002, "http://A.Example.NET/en/x?y#z"), (1003, "http://example.net/de/"), (1004, "http://net"),
        (1005, "http://xnet/"), (1006, "http://example.com/de/1"), (1007, "http://b.org/fr/"), (1008, "http://b.org/FR/"), (1009, "http:///p"),
        (1010, "x://h?q=/a#b"), (1002, "http://A.Example.NET/en/x?y#z"), (None, "http://spam.example.com/es/1"), (1011, "http://a.net/#/en/"),
    ]


def test_urls_are_judged(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id bigint, url string, html string, tokens int")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 2)] + [(None, True), (5, None)], "page_id bigint, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert urls.judge(pages, labels).count() == len(rows)
    want = {
        1000: ("", "", None, "allow"), 1001: ("", "", None, "allow"), 1002: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        1003: ("example.net", "/de/", "net/", "block"), 1004: ("net", "", None, "allow"), 1005: ("xnet", "/", None, "allow"),
        1006: ("example.com", "/de/1", "example.com/de/", "block"), 1007: ("b.org", "/fr/", "org/fr/", "allow"), 1008: ("b.org", "/FR/", None, "allow"),
        1009: ("", "/p", None, "allow"), 1010: ("h", "", None, "allow"), 1011: ("a.net", "/", "net/", "block"), None: ("spam.example.com", "/es/1", None, "block"),
    }
    for i, (host, path, rule, verdict) in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), i
    for i in range(400):
        assert got[i].verdict == ("block" if i % 4 == 0 else "allow")
    assert {r.verdict for r in urls.judge(pages, labels.where("false")).where("rule is null").collect()} == {"allow"}
    assert urls.judge(pages.where("false"), labels).collect() == []


def test_mined_rules_are_those_of_a_plain_count(spark):
    rows = [(["h:a", "h:b", "p:x"], True)] * 30 + [(["h:a", "p:y"], False)] * 60 + [(["h:b", "p:y"], True)] * 5 + [(["h:b"], False)] * 25 + [([], True)] * 3
    mined, _ = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.1, min_confidence=0.6, min_lift=1.2)
    got = {tuple(r["items"]): r for r in mined.collect()}
    sets = {k for k in [("p:x",), ("h:a", "h:b"), ("h:a", "p:x"), ("h:b", "p:x"), ("h:a", "h:b", "p:x")]}
    assert set(got) == sets and all(r.confidence == 1.0 for r in got.values())
    assert got["h:a", "h:b"].key == "h:b" and got["h:a", "h:b", "p:x"].key == "p:x"


def test_deep_urls_and_single_pages(spark):
    """URLs of forty segments make one item; what a single page has makes no rule."""
    deep = "http://deep.example/" + "/".join(f"s{i}" for i in range(40))
    rows = [(i, deep) for i in range(8)] + [(100 + i, f"http://a.example/{i}/x") for i in range(60)] + [(200, "http://once.example/" + "/".join(f"t{i}" for i in range(40)))]
    rows += [(300, "http://other.example/s3/q"), (301, "http://other.example/t3/q"), (302, "http://deep.example/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i < 100 or i == 200) for i, _ in rows if i < 300], "page_id bigint, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert {got[i] for i in range(8)} == {"block"} and {got[100 + i] for i in range(60)} == {"allow"}
    # any token of an item stands for it; the page that is there once teaches nothing
    assert (got[300], got[302], got[301], got[200]) == ("block", "block", "allow", "allow")


def test_huge_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x[7] = 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, ann.every_20th()).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 500, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(500), -s))[:20]
        assert len(found) == 20 and len({v for _, v, _ in found} & set(best.tolist())) >= 18


def vectors(n=3000, dim=24, seed=3):
    return np.random.default_rng(seed).normal(size=(n, dim)) * np.random.default_rng(seed + 1).uniform(0.5, 2, (n, 1))


def test_recall_and_scores(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, v int")
    got = {}
    for r in ann.search(df, ann.every_20th(), block=700, queries=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 3000, 20))
    found = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        s = x @ x[q]
        s[q] = -np.inf
        found += len({v for v, _ in ranks.values()} & set(np.argsort(-s)[:20].tolist()))
        scores = [ranks[i][1] for i in range(1, 21)]
        assert scores == sorted(scores, reverse=True) and all(ranks[i][1] == pytest.approx(s[ranks[i][0]]) for i in ranks)
    assert found / (20 * len(got)) >= 0.95


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [1.0]),
        (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (0, [1.0, 0.0]), (None, [5.0, 5.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, ann.every_20th()).collect()]
    one = [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 0, 1.0), (0, 4, 3, -1.0)]
    assert sorted(got) == sorted(one * 2)
    assert ann.search(df.where("false"), ann.every_20th()).collect() == []


def test_stopping_ratio():
    assert ann.chi_square(ann.stopping_ratio(0.9, 8), 8) == pytest.approx(0.9)
    assert ann.stopping_ratio(0.95, 8) == pytest.approx(15.507, abs=1e-3)
