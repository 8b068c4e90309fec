"""Jaccard join and suffix deduplication against plain counterparts."""

import random

import numpy as np
import pytest

from inkblot.llm import common, setjoin, suffixes
from inkblot.llm.common import CLEANUP, components, written
from tests.llm import plain


def wordy(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def near_copies(seed):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(12):
        base = wordy(rng, rng.choice([3, 5, 6, 40, 120])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((number, " ".join(copy) if rng.random() < 0.7 else "  ".join(copy).upper()))
            number += 1
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (None, "one two"), (1005, "é è ê ë ē ĕ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_the_components_of_a_plain_search(make_docs, seed):
    rows = near_copies(seed)
    got = setjoin.join(make_docs(rows, "n", "token", "a", "component", "_keep")).collect()
    want = plain.component_ids({i: t for i, t in rows if i is not None})
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(plain.shingle_set(t)) for i, t in rows if i is not None}


def test_join_of_chains_and_large_groups(make_docs):
    """A chain whose ends are far apart, and a group in which every text differs."""
    rng = random.Random(5)
    words = wordy(rng, 150, 10_000).split()
    chain = []
    for i in range(25):
        chain.append((i, " ".join(words)))
        words[6 * i : 6 * i + 2] = [f"n{i}a", f"n{i}b"]
    base = wordy(rng, 100, 10_000).split()
    group = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(100)] = f"only{i}"
        group.append((100 + i, " ".join(copy)))
    rows = chain + group
    got = {r.doc_id: r.component_id for r in setjoin.join(make_docs(rows)).collect()}
    assert got == plain.component_ids(dict(rows))
    assert len(set(got.values())) < 10


def test_join_with_repeated_ids_and_empty_tables(make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v w"), (1, "q r s t u v w")]
    got = sorted((r.doc_id, r.component_id) for r in setjoin.join(make_docs(rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]  # document 1 has both texts
    assert setjoin.join(make_docs(rows).where("false")).collect() == []
    kept = setjoin.one_of_each(make_docs([*rows, (None, "q"), (9, None)], "_keep")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 9]


def test_bound_on_the_overlap_keeps_every_link(spark):
    """Sets as prefixes of an index: whatever links passes, and a single shared element of long sets does not."""
    rng = random.Random(3)
    base = rng.sample(range(100_000), 400)
    sets = {1: base, 2: base[:360] + list(range(200_000, 200_040)), 3: base[40:], 4: base[:1] + list(range(300_000, 300_399)), 5: base[:320]}
    rows = [(token, i, len(s), pos) for i, s in sets.items() for pos, token in enumerate(sorted(s, reverse=True)[: setjoin.prefix_size(len(s))])]
    index = spark.createDataFrame(rows, "token long, id long, n long, pos long")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    got = {(r.a, r.b) for r in setjoin._promising(index, pairs).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert len(linked) >= 3 and linked <= got and not {p for p in got if 4 in p}


def test_of_rows_with_one_id_the_smallest_text_stays(make_docs):
    rows = [(1, "b " * 9), (1, "a " * 9), (1, "a " * 9), (2, "x y z"), (3, "x y z")]
    for _ in range(2):
        assert sorted((r.doc_id, r.text) for r in setjoin.one_of_each(make_docs(rows, "_rows", "_place")).collect()) == [(1, "a " * 9), (2, "x y z")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 200: 200, 201: 200}
    assert components(df.where("a < 0")).collect() == []


@pytest.fixture()
def many_partitions(spark):
    """Shuffles into many partitions that are not put together."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tasks_of(spark, group, work):
    """What ``work`` returns, and how many tasks its jobs had."""
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
    return out, sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))


def test_few_edges_take_few_tasks(spark, many_partitions, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 400, 2)] + [(i, i * 7 % 400) for i in range(0, 400, 5)] + [(900, 901), (3, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    few, tasks = tasks_of(spark, "few-edges", lambda: components(df, tasks=3).collect())
    assert tasks < 200  # 60 in each shuffle of each round otherwise
    monkeypatch.setattr(common, "FEW", 0)
    many, _ = tasks_of(spark, "many-edges", lambda: components(df).collect())
    assert sorted(few) == sorted(many) and len(few) == len({r.node for r in few})


def test_small_tables_are_written_by_few_tasks(spark, many_partitions, make_docs):
    counted = spark.range(1000).groupBy("id").count()
    assert len(written(counted, "few", 4).inputFiles()) <= 4
    docs = make_docs(near_copies(1))
    _, tasks = tasks_of(spark, "join", lambda: setjoin.join(docs).collect())
    assert 0 < tasks < 2600


def byte_texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([99, 100, 101, 140, 300]))) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else wordy(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(0, 6))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(50, "z" * 350), (51, "ab" * 130), (52, None), (53, ""), (54, rows[3][1]), (55, rows[3][1]), (56, "\0" * 220)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_are_those_of_a_plain_search(make_docs, seed):
    rows = byte_texts(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(make_docs(rows, "row", "block", "bucket")).collect()}
    want = plain.without_repeats([(t or "").encode() for _, t in rows])
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_removed_bytes_over_many_blocks(make_docs):
    rows = byte_texts(9)
    got = {r.doc_id: [list(x) for x in zip(r.begins, r.ends)] for r in suffixes.repeats(make_docs(rows), block=700).collect()}
    whole = {r.doc_id: [list(x) for x in zip(r.begins, r.ends)] for r in suffixes.repeats(make_docs(rows)).collect()}
    assert got == whole and any(got.values())
    # as if every repeated anchor, or some of them, were common in thousands of blocks
    for hot in (0, 3):
        dealt = {r.doc_id: [list(x) for x in zip(r.begins, r.ends)] for r in suffixes.repeats(make_docs(rows), block=700, hot=hot).collect()}
        assert dealt == whole


def test_repeated_and_missing_ids(make_docs):
    text = wordy(random.Random(4), 60)
    rows = [(1, text), (1, text), (None, text), (2, text[:50])]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.report(make_docs(rows)).collect())
    assert got == [(0, 0), (1, len(text)), (1, len(text)), (2, 0)]
    assert suffixes.report(make_docs(rows).where("false")).collect() == []


def test_cutting_keeps_columns_and_whole_characters(make_docs):
    rng = random.Random(2)
    shared = "".join(rng.choice("éèàùçab ") for _ in range(150))
    rows = [(1, "ê" + shared + "é"), (2, "ë" + shared + "è"), (3, "c"), (4, None), (5, "ê" + shared + "é")]
    df = make_docs(rows, "extra", "kept")
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == rows[0][1] and got[3] == "c"
    assert got[2] == "ëè"


def test_merge_of_front_coded_runs():
    rng = random.Random(3)
    runs, everything = [], []
    for _ in range(7):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(0, 30)))
        everything += run
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 12) for a, b in zip(run, run[1:])]
        runs.append((shared[: len(run)], [s[n:] for s, n in zip(run, shared)]))
    strings, counts = suffixes._strings(runs), np.cumsum([0, *(len(r[0]) for r in runs)])
    merged = [(strings[counts[r] + i], n) for r, i, n in suffixes.merge(runs)]
    assert [s for s, _ in merged] == sorted(everything)
    for (a, _), (b, n) in zip(merged, merged[1:]):
        assert a[:n] == b[:n] and (n == 12 or a[n] != b[n])


def test_long_texts_are_cut_into_parts(monkeypatch, make_docs):
    monkeypatch.setattr(suffixes, "PIECE", 256)
    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(3000))
    parts = {(int(n), int(p)) for n, p, _ in zip(*map(np.concatenate, zip(*suffixes.anchors([text.encode()]))))}
    monkeypatch.setattr(suffixes, "PIECE", 1 << 20)
    assert parts == {(int(n), int(p)) for n, p, _ in zip(*map(np.concatenate, zip(*suffixes.anchors([text.encode()]))))}


def test_no_group_of_texts_is_joined_with_itself(make_docs, spark):
    plan = setjoin.join(make_docs(near_copies(3)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("unit", ["0", "ab"])
def test_long_runs_of_a_byte_are_worked_through_in_slices(unit):
    import tracemalloc

    texts = [b"begin " + unit.encode() * (300_000 // len(unit)) + b" end"]
    number, place, h = (np.concatenate(c) for c in zip(*suffixes.anchors(texts)))
    place = np.unique(place)
    number = np.zeros(len(place), np.int64)
    assert len(place) > 100_000
    tracemalloc.start()
    some, around, left, right, spans = suffixes.distinct_surroundings(texts, np.array([5]), number, place)
    _, _, begins = suffixes._strings_of(texts, number, place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    assert len(some) < 1_000 and spans.shape[1] == 1 and spans[0, 0] == 5
    assert len(begins) == len(np.unique(begins))


def test_slices_change_nothing(monkeypatch, make_docs):
    rows = byte_texts(4) + [(70, "0" * 900), (71, "x" + "0" * 700 + "ab" * 300)]
    want = {i: w for (i, _), w in zip(rows, plain.without_repeats([(t or "").encode() for _, t in rows]))}
    monkeypatch.setattr(suffixes, "SLICE", 7)
    for hot in (suffixes.HOT, 0):
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = {r.doc_id: [list(x) for x in zip(r.begins, r.ends)] for r in suffixes.repeats(make_docs(rows), block=700, hot=hot).collect()}
        assert {i: sum(e - b for b, e in x) for i, x in got.items()} == {i: w[1] for i, w in want.items()}


def test_a_table_that_is_written_leaves_no_shuffle_files(spark):
    def files():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in kept.mkString("\n").split("\n") if "/shuffle_" in name}

    before, rows = files(), spark.range(5000).selectExpr("id % 7 as k").groupBy("k").count()
    kept = spark.conf.get(CLEANUP)
    table = written(rows, "cleanup")
    assert not files() - before and spark.conf.get(CLEANUP) == kept
    assert table.count() == written(rows, "cleanup").count() == 7 and rows.count() == 7
