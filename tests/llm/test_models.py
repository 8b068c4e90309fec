"""Scoring, quality rules, language and pieces against plain counterparts and round trips."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkblot.llm import langid, pieces, ppm, quality
from inkblot.llm.common import crc_mod
from tests.llm import plain


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


TEXTS = [
    (1, "The cat sat on the mat."), (2, "the cat"), (3, None), (4, ""), (5, "Élan vital\n\tthe  cat\x0bsat"), (6, "zebra \x1c quagga"),
    (7, "the cat"), (7, "the cat"), (None, "a cat"), (8, "x" * 3000), (9, "\0\x7f"), (10, "DOG dog"), (11, "漢字 the"), (12, "cat " * 50),
]


@pytest.mark.parametrize("order,block", [(2, 1 << 20), (5, 1 << 20), (5, 64)])
def test_scores_are_those_of_a_plain_model(make_docs, order, block):
    got = ppm.score(make_docs(TEXTS, "gram", "train", "block"), crc_mod(F.col("doc_id"), 5) != 1, order=order, block=block).collect()
    train = [(t or "").encode() for i, t in TEXTS if fold(i, 5) != 1]
    model = plain.Trie(train, order)
    tokens = Counter(w for t in train for w in t.lower().split())
    total, kinds = sum(tokens.values()) + len(train), len(tokens) + 1
    by_id = {i: (t or "").encode() for i, t in TEXTS}
    assert len(got) == len(TEXTS) and any(r.held_out for r in got)
    for r in got:
        words = by_id[r.doc_id].lower().split()
        counts = [tokens[w] for w in words] + [len(train)]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold(r.doc_id, 5) == 1, len(words) + 1, total)
        assert r.n_known == sum(c > 0 for c in counts)
        assert r.base_score == pytest.approx(sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in counts), abs=1e-9)
        assert r.score == pytest.approx(model.text(by_id[r.doc_id]), abs=1e-9)


def test_each_context_shares_out_one():
    train = [b"abracadabra", b"abba", b"cab"]
    keys, counts = ppm.distinct(train, 2)
    low = ppm.low_levels(*ppm.summed(keys & 0xFFFF, counts))
    for context in (b"ab", b"zz", b"ca", b"za"):
        every = np.array([(context[0] << 16) | (context[1] << 8) | s for s in range(256)])
        both = np.union1d(keys, every)
        n = np.zeros(len(both), np.int64)
        n[np.searchsorted(both, keys)] = counts
        logs = ppm.log_probabilities(both, n, 2, low)
        assert (10 ** logs[np.searchsorted(both, every)]).sum() == pytest.approx(1)


def test_scores_without_rows_or_training(make_docs):
    df = make_docs(TEXTS)
    assert ppm.score(df.where("false"), F.lit(True)).collect() == []
    got = ppm.score(df, F.lit(False)).collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    assert next(r.score for r in got if r.doc_id == 4) == pytest.approx(-math.log10(256))


def plain_counts(text):
    data = text or ""
    words = plain.words(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in data.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in data), len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(["house", "tree", "of", "walking", "Sunday", "the"]) + str(rng.randrange(60)) for _ in range(80)]
        bad = i % 3 == 0
        if bad:
            words = [w + rng.choice(["###", "$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_counts_and_learned_rules(make_docs, spark):
    rows, labels = quality_rows()
    odd = [(900, None), (901, ""), (902, "a b c a b c a\n\na b\na b\n \n"), (903, "é #|<>\x0b\x1c x"), (None, "word " * 60), (904, "w " * 5000), (5, rows[5][1])]
    known = spark.createDataFrame([*labels, (None, 0), (7000, None)], "doc_id bigint, quality int")
    df = make_docs(rows + odd, "kept", "rule", "bad")
    got = quality.judge(df, known).collect()
    assert len(got) == len(rows) + len(odd)
    texts = dict(rows + odd)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 3 != 0)
    assert all(r.kept == (not r.base_failed) for r in quality.judge(df, known.where("false")).collect())
    assert quality.judge(df.where("false"), known).collect() == []


def plain_learner(x, bad, turn, precision=0.95, min_cover=5, max_rules=12, most=4):
    """Sequential covering over lists of rows, every threshold tried."""
    n, names = len(bad), sorted(x)
    fits = lambda rule, i: all((x[s][i] >= t) == up for s, up, t in rule)

    def worth(rule, rows):
        p = sum(bad[i] for i in rows if fits(rule, i))
        q = sum(not bad[i] for i in rows if fits(rule, i))
        return ((p - q) / (p + q) if p + q else -1.0), p

    def grow(rows):
        rule = []
        while len(rule) < most and rows and not all(bad[i] for i in rows):
            p0 = sum(bad[i] for i in rows)
            best, chosen = (1e-9, 0.0), None
            for s in names:
                values = sorted({x[s][i] for i in rows})
                for up in (True, False):
                    options = []
                    for low, high in zip(values, values[1:]):
                        t = (low + high) / 2
                        p = sum(bad[i] for i in rows if (x[s][i] >= t) == up)
                        q = sum(not bad[i] for i in rows if (x[s][i] >= t) == up)
                        gain = round(p * (math.log2(p / (p + q)) - math.log2(p0 / len(rows))), 9) if p else -math.inf
                        options.append((gain, (high - low) / (values[-1] - values[0]), -t))
                    if options and max(options)[:2] > best:
                        gain, gap, t = max(options)
                        best, chosen = (gain, gap), (s, up, -t)
            if chosen is None:
                break
            rule.append(chosen)
            rows = [i for i in rows if fits([chosen], i)]
        tight = {}
        for s, up, t in rule:
            known = tight.get((s, up))
            tight[s, up] = t if known is None else (max if up else min)(t, known)
        return [(s, up, t) for (s, up), t in tight.items()]

    rules, left, names = [], list(range(n)), list(names)
    while len(rules) < max_rules and names:
        growing, pruning = [i for i in left if turn[i] != 2], [i for i in left if turn[i] == 2]
        if sum(bad[i] for i in growing) < min_cover:
            break
        rule = grow(growing)
        if not rule:
            break
        first = rule[0][0]
        while len(rule) > 1:
            shorter = max(([*rule[:i], *rule[i + 1 :]] for i in range(len(rule))), key=lambda r: worth(r, pruning))
            if worth(shorter, pruning)[0] < worth(rule, pruning)[0]:
                break
            rule = shorter
        value, found = worth(rule, pruning)
        if value < 2 * precision - 1 or found < min_cover // 3:
            names.remove(first)
            continue
        rules.append(tuple(rule))
        left = [i for i in left if not fits(rule, i)]
    return rules


def test_learner_beside_a_plain_one_in_any_order():
    rng = np.random.default_rng(4)
    for case in range(6):
        n = 150
        x = {k: np.round(rng.random(n), 2) for k in ("a", "b", "c")}
        bad = (x["a"] > 0.6) & (x["b"] < 0.5) | (x["c"] > 0.9)
        bad ^= rng.random(n) < (0.02 if case % 2 else 0)
        turn = rng.integers(0, 3, n)
        want = plain_learner({k: v.tolist() for k, v in x.items()}, bad.tolist(), turn.tolist())
        assert [tuple(map(tuple, r)) for r in quality.learn(x, bad, turn)] == want
        for _ in range(50 if case == 0 else 5):
            order = rng.permutation(n)
            got = quality.learn({k: v[order] for k, v in x.items()}, bad[order], turn[order])
            assert [tuple(map(tuple, r)) for r in got] == want
        if case % 2 == 0:
            assert want
    for rule in quality.learn(x, bad, turn):  # nothing that another condition says already
        assert len({(c.statistic, c.at_least) for c in rule}) == len(rule)


def test_rules_are_one_expression(spark):
    rules = [(quality.Condition("symbols_by_word", True, 0.5), quality.Condition("capitals", False, 0.9)), (quality.Condition("digits", True, 0.3),)]
    row = {c: 10 for c in quality.COUNTS} | {"n_symbols": 6, "n_capitals": 1, "n_digits": 1}
    df = spark.createDataFrame([row, row | {"n_symbols": 0, "n_digits": 5}, row | {"n_symbols": 0}])
    assert [r.x for r in df.select(quality.dropped_by(rules).alias("x")).collect()] == [1, 2, None]


LANGS = {"en": "the and of to in that with house water people", "de": "der und die nicht mit das ist ein haus wasser", "fr": "le et les des que dans est maison eau qui"}


def lang_rows(n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(40)).title(), lang))
    return rows


def test_language_of_held_out_texts(make_docs):
    rows = lang_rows()
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 .. !", None), (903, "Haus und Wasser " * 3000, None), (None, "the people and the house", "en"), (904, "…漢", None)]
    got = {r.doc_id: r for r in langid.identify(make_docs(rows + odd, "score", "lang_pred", "_lang")).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(i, lang) for i, _, lang in rows if fold(i, 3) == 1]
    assert all(got[i].held_out for i, _ in held) and not any(got[i].held_out for i, _, _ in rows if fold(i, 3) != 1)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[903].lang_pred == "de" and got[None].lang_pred == "en" and got[904].lang_pred in LANGS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_whole_texts_are_learned_and_scored_as_by_a_plain_softmax():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7)
    texts = ["x", "Haus, Wasser!", "  the people ", "\u00e9t\u00e9 \u6f22 " * 50, "many words " * 9000 + "and Another END", "y" * 70000 + " \u00df"]
    got = model.scores([langid.plain(t) for t in texts])
    for t, row in zip(texts, got):
        data = b" " + langid.plain(t) + b" "
        runs = Counter(data[i : i + n] for n in langid.SIZES for i in range(len(data) - n + 1))
        z, shares = np.zeros(3), Counter()
        for run, often in runs.items():
            bucket = int(langid.grams(np.frombuffer(run, np.uint8), len(run))[0])
            z += model.table[bucket].astype(float) * often / runs.total()
            shares[bucket] += often / runs.total()
        p = np.exp((z + model.bias) / model.temperature)
        assert np.allclose(row, p / p.sum(), atol=1e-9)
        buckets, share = langid.bag_of(t)
        assert buckets.tolist() == sorted(shares) and np.allclose(share, [shares[b] for b in sorted(shares)], atol=1e-6)
    assert langid.bag_of("12 .. !") is None and langid.bag_of("") is None


def test_what_ends_a_long_text_is_learned():
    """Texts of two languages that differ beyond their first 100,000 bytes only."""
    same = "one and the same text " * 5000
    bags = [langid.bag_of(same + ending * 400) for ending in ("quick zebra ", "vom wurf ") * 40]
    model = langid.train(bags, ["a", "b"] * 40)
    assert [model.langs[i] for i in model.scores([langid.plain(same + e * 400) for e in ("quick zebra ", "vom wurf ")]).argmax(axis=1)] == ["a", "b"]


def test_language_without_labels_or_rows(make_docs):
    df = make_docs([(1, "some text", None), (2, "more", None)])
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("und", 0.0)}
    assert langid.identify(make_docs(lang_rows(30)).where("false")).collect() == []


def best_path(word, v):
    """Highest total score over all segmentations, without sharing anything."""
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for at in range(end):
            piece = word[at:end]
            if piece in v.packed:
                best[end] = max(best[end], best[at] + v.scores[piece])
        if word[end - 1] not in v.packed:
            best[end] = max(best[end], best[end - 1] + v.byte_score * len(pieces._spelling(word[end - 1])))
    return best[-1]


def path_score(data, v):
    names = {p: s for s, p in v.packed.items()}
    parts = [data[i : i + 4] for i in range(0, len(data), 4)]
    return sum(v.scores[names[p]] if p in names else v.byte_score for p in parts)


def test_shared_prefixes_give_the_best_path():
    v = pieces.load()
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("theanrs漢é,.ing") for _ in range(rng.randrange(0, 14))) for _ in range(300)} | {"▁▁▁a", "▁", "a" * 50, "▁\udc81x"}
    coded = dict(pieces.encode_words(words, v))
    assert set(coded) == words
    for word in words:
        assert path_score(coded[word], v) == pytest.approx(best_path(word, v), abs=1e-6)


def test_pieces_round_trip(make_docs):
    texts = ["  two  blanks ", "a\nb\r\n\tc", "▁ literal ▁▁ marks", "漢字 emoji 😀 \u200d", "", " ", "\n", "nul \0 and \x7f", "word " * 4000, "x" * 20_000, "naïve café", "a\u2581"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (None, "no id"), (3, texts[3])]
    out = pieces.encode(make_docs(rows, "n", "word"))
    got = pieces.decode(out).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    want = dict(rows)
    assert all(r.decoded == (want[r.doc_id] or "") for r in got)
    assert {len(r.ids) for r in got if r.doc_id in (4, 100)} == {0}
    assert pieces.encode(make_docs(rows).where("false")).collect() == []


def test_an_encoder_knows_whether_its_words_come_back():
    v = pieces.load()
    texts = ["▁ \0 漢é\n a  b", "", "\U0001f600" * 3]
    encoder = pieces.Encoder(v)
    coded = encoder(texts)
    assert encoder.exact and [pieces.decode_ids(np.frombuffer(c, np.int32).tolist(), v) for c in coded] == texts
    broken = pieces.load()
    broken.spelled = [s.replace(b"b", b"") for s in broken.spelled]
    encoder = pieces.Encoder(broken)
    encoder(["a c"])
    assert encoder.exact
    encoder(texts)
    assert not encoder.exact
    encoder(["a c"])
    assert not encoder.exact


def test_one_long_word_needs_memory_in_proportion():
    """Texts without blanks are one marked word: back pointers, and not a string of ids for each character."""
    import tracemalloc

    v = pieces.load()
    texts = ["".join(chr(0x4E00 + i * i % 20_000) for i in range(20_000)), "ab" * 20_000, " " * 20_000, "\U0001f600" * 10_000]
    tracemalloc.start()
    coded = pieces.Encoder(v)(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    for text, ids in zip(texts, coded):
        assert pieces.decode_ids(np.frombuffer(ids, np.int32).tolist(), v) == text


def test_words_that_come_again_are_not_forgotten(monkeypatch):
    """Where the words that were met no longer fit, those that the last texts had stay; rare ones go."""
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 400)
    spelled = []
    real = pieces.encode_words
    monkeypatch.setattr(pieces, "encode_words", lambda words, v: (spelled.extend(words), real(words, v))[1])
    v = pieces.load()
    encoder = pieces.Encoder(v)
    frequent = " ".join(f"often{i}" for i in range(50))
    for turn in range(30):
        texts = [frequent, " ".join(f"rare{turn}x{i}" for i in range(100))]
        assert [pieces.decode_ids(np.frombuffer(c, np.int32).tolist(), v) for c in encoder(texts)] == texts
        assert len(encoder.known) + len(encoder.older) <= 3 * 400
    assert spelled.count("▁often7") == 1 and encoder.exact


def test_grams_that_come_again_need_no_more_memory():
    import tracemalloc

    text = np.random.default_rng(1).integers(0, 200, 1 << 20, np.uint8).tobytes()
    keys, counts = ppm.distinct([text], 5)
    tracemalloc.start()
    many, often = ppm.distinct((text for _ in range(16)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (many == keys).all() and (often == 16 * counts).all()
    assert peak < 250_000_000  # 16 bytes for each gram of each text, three times over, would be twice that
