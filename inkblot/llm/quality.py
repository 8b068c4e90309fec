"""Quality rules: decision lists learned by sequential covering.

Statistics of each whole text are gathered once. From those of labelled documents, rules are grown one
after the other: conditions ``statistic >= t`` or ``< t`` are added to a conjunction while they gain
information, any of them are pruned on rows that did not grow it, and it joins the list if it is
precise enough there; the rows it covers are set aside. Rows that the base rule drops are not learned from. A rule that is not sets its first statistic
aside. Length itself is no statistic: short texts fail the base rule. The list is emitted as one Spark expression:
``when`` the first rule that fits, drop, ``otherwise`` keep.

Learning takes at most ``max_rows`` labelled documents, those with the least hash of their id; the
rules then judge every row. Null texts count as empty. Without labels the list is empty and drops
nothing. Repeated rows are judged alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.llm.common import small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_long_words")
MAX_ROWS = 20_000


def _only(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def statistics_of(data: bytes) -> tuple[int, ...]:
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    in_words = len(data.decode("utf-8", "replace")) - _only(data, SPACES)
    return (
        len(words), in_words, _only(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), _only(data, CAPITALS), _only(data, DIGITS), sum(len(w) > 24 for w in words),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text."""
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {key}, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = [pa.int64()] * len(COUNTS)
        for b in batches:
            rows = [statistics_of(x) for x in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, longs))], ["doc_id", *COUNTS])

    return docs.select("doc_id", text_bytes(docs).alias("text")).mapInArrow(count, out)


# What conditions may ask of; each is a Spark expression over the counts, and stays in the plan as such.
def ratios() -> dict[str, Column]:
    c = F.col
    words, chars, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return {
        "word_length": c("word_chars") / words, "symbols_by_word": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / lines, "repeat_words": c("n_repeat_words") / words, "capitals": c("n_capitals") / chars,
        "digits": c("n_digits") / chars, "long_words": c("n_long_words") / words, "words_by_line": c("n_words") / lines,
    }


class Condition(NamedTuple):
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] >= self.threshold if self.at_least else x[self.statistic] < self.threshold

    def column(self) -> Column:
        value = ratios()[self.statistic]
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(x)
    return hit


def _gain(pos: np.ndarray, neg: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained for the positives that stay covered."""
    before = np.log2(p0 / (p0 + n0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -np.inf)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The condition that gains most; among equals, the one with the widest gap around its threshold.

    Thresholds lie midway between neighbouring values, so a row just beyond those seen falls on their side.
    """
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, chosen = (1e-9, 0.0), None
    for name in sorted(x):
        values, where = np.unique(x[name], return_inverse=True)
        if len(values) < 2:
            continue
        below_p = np.cumsum(np.bincount(where[bad], minlength=len(values)))[:-1]
        below_n = np.cumsum(np.bincount(where[~bad], minlength=len(values)))[:-1]
        gaps = np.diff(values) / (values[-1] - values[0])
        for at_least, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            gains = np.round(_gain(p, n, p0, n0), 9)
            i = int(np.lexsort((-gaps, -gains))[0])
            if (gains[i], gaps[i]) > best:
                best, chosen = (gains[i], gaps[i]), Condition(name, at_least, float((values[i] + values[i + 1]) / 2))
    return chosen


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: list[Condition] = []
    alive = np.ones(len(bad), bool)
    while len(rule) < most and alive.any() and not bad[alive].all():
        chosen = _best_condition({k: v[alive] for k, v in x.items()}, bad[alive])
        if chosen is None:
            break
        rule.append(chosen)
        alive &= chosen.holds(x)
    return _tightest(rule)


def _tightest(rule: Iterable[Condition]) -> Rule:
    """Of conditions that bound a statistic on one side, the one that says most."""
    held: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        known = held.get((c.statistic, c.at_least))
        if known is None or (c.threshold > known.threshold) == c.at_least:
            held[c.statistic, c.at_least] = c
    return tuple(held.values())


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    hit = _covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions taken away one at a time, wherever they stand, as long as the rest is worth no less."""
    while len(rule) > 1:
        fewer = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
        shorter = max(fewer, key=lambda r: _worth(r, x, bad))
        if _worth(shorter, x, bad)[0] < _worth(rule, x, bad)[0]:
            break
        rule = shorter
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray, precision: float = 0.95, min_cover: int = 5, max_rules: int = 12,
          conditions: int = 4) -> list[Rule]:
    """An ordered list of rules for ``bad``; rows whose ``turn`` is 2 prune, the others grow.

    Only sets of rows count, so that their order changes nothing.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    x = dict(x)
    while len(rules) < max_rules and x:
        grow, prune = left & (turn != 2), left & (turn == 2)
        if bad[grow].sum() < min_cover:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], conditions)
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}
        first = rule[0].statistic
        rule = _pruned(rule, held, bad[prune])
        worth, found = _worth(rule, held, bad[prune])
        if worth < 2 * precision - 1 or found < min_cover // 3:
            del x[first]  # a start that does not hold elsewhere; try without it
            continue
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents (``labels``: doc_id, quality; 0 is bad)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # max_rows ids
    # what the base rule drops anyway teaches nothing
    rows = with_statistics(chosen).where(~base_failed()).join(F.broadcast(sample), "doc_id")
    hashed = F.xxhash64("doc_id")
    data = rows.select("bad", F.pmod(hashed, F.lit(3)).alias("turn"), *(v.alias(k) for k, v in ratios().items())).orderBy(hashed, "doc_id").limit(max_rows).toPandas()
    return learn({k: data[k].to_numpy(float) for k in ratios()}, data["bad"].to_numpy(bool), data["turn"].to_numpy(), **how)


def dropped_by(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        out = F.when(fits, F.lit(number)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Every document with its counts, ``base_failed``, the ``rule`` that dropped it, and ``kept``."""
    rules = fit(docs.select("doc_id", "text"), labels, **how)
    out = with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", dropped_by(rules))
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
