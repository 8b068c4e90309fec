"""The leaves of a row on one sheet: scanned, resolved, numbered and rewritten as one text, and told apart again.

What a scan by leaves costs goes by the number of leaves first (every rule asks every text, and what it finds is
arrays of structs, which every step copies). Here the leaves are joined by a mark that no built-in pattern matches,
and beside which word boundaries and looks around hold as they do at the ends of a text; so the same is found, also
where a leaf holds the mark itself. Findings are numbers throughout: the high half of a key is the distance of the
first byte from the largest number, so that later starts come first, and the low half the place of the match among
all matches, which go by rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty, index_pass, let, offsets
from inkblot.functions.dialect import DIGIT
from inkblot.functions.spans import MARKED, octet_places, regex_marked
from inkblot.operators.resolve import PLACED, placeholder
from inkblot.rules import Rule, ScanConfig

MARK = "\x01"
MARKS = f"struct<rule:int,m:{MARKED}>"
LAST = 2**31 - 1
# A label, a leaf and a finding as one number: a row has less than 2^31 bytes, and eight or more for each leaf and finding.
LEAF_BITS, KEPT_BITS = 28, 27


def on_one_sheet(config: ScanConfig) -> bool:
    """Whether a configuration has the patterns of documents only that are known not to match the mark."""
    return not config.custom_rules and all(r.detector in ("pattern", "entity") for r in config.rules("DOC"))


def _high(number: Column) -> Column:
    return F.shiftright(number, 32).cast("int")


def _low(number: Column) -> Column:
    return number.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def _pair(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 32) + low


def _start(key: Column) -> Column:
    return F.lit(LAST) - _high(key)


def _held(names: Sequence[str], body: Callable[..., Column]) -> Column:
    """``body`` with columns that lambdas use: named within a lambda, the optimizer may put there what a column stands for, to be worked out each time."""

    def hold(got: list[Column]) -> Column:
        return body(*got) if len(got) == len(names) else let(F.col(names[len(got)]), lambda x: hold([*got, x]))

    return hold([])


def _marks(text: Column, rules: Sequence[Rule]) -> Column:
    """The text as each rule that matches marks it, in the order of rules."""

    def of(rule: Rule) -> Column:
        marked = regex_marked(text, rule.java, rule.guard)
        return let(marked, lambda m: F.when(m.isNotNull(), F.struct(F.lit(rule.place).alias("rule"), m.alias("m"))))

    single, digits = ([of(r) for r in rules if r.with_digit == wanted] for wanted in (False, True))
    parts = [F.array(*single)] if single else []
    if digits:
        parts.append(F.when(text.rlike(f"[{DIGIT}]"), F.array(*digits)).otherwise(empty(MARKS)))
    return F.when(text.isNotNull(), F.sort_array(F.filter(F.concat(*parts), lambda e: e.isNotNull()))).otherwise(empty(MARKS))


def _kept(keys: Column, ends: Column) -> Column:
    """Of findings in resolving order, those that overlap none kept before them.

    One that ends before the start of the one right before it is free of all. If each of the others comes behind a
    free one, or behind one that starts with the one before it, it overlaps one that is kept; only where that is not
    so are they gone through in turn.
    """

    def free(key: Column, before: Column) -> Column:
        return before.isNull() | (F.get(ends, _low(key)) <= _start(before))

    def in_turn() -> Column:
        def step(limit: Column, i: Column) -> tuple[Column, Column, Column]:
            key = F.get(keys, i)
            fits = F.get(ends, _low(key)) <= limit
            return F.when(fits, _start(key)).otherwise(limit), i, fits

        return F.transform(index_pass(F.size(keys), F.lit(LAST), step), lambda i: F.get(keys, i))

    def resolved(frees: Column) -> Column:
        def doubtful(is_free: Column, i: Column) -> Column:
            return ~is_free & ~F.get(frees, i - 1) & (_high(F.get(keys, i - 1)) != _high(F.get(keys, i - 2)))

        alone = ~F.array_contains(frees, False)
        doubts = F.filter(frees, doubtful)
        return F.when(alone, keys).when(F.size(doubts) > 0, in_turn()).otherwise(F.filter(keys, lambda _, i: F.get(frees, i)))

    frees = F.transform(keys, lambda key, i: free(key, F.get(keys, i - 1)))
    return F.when(F.size(keys) > 1, let(frees, resolved)).otherwise(keys)


def with_sheet(rows: DataFrame, config: ScanConfig, where: Column | None = None) -> DataFrame:
    """Rows with ``_leaves`` and what becomes of them: ``_new``, ``_placed``, ``_findings`` and ``_which``.

    Rows that are not ``where`` have a sheet without text.
    """
    rules = config.rules("DOC")
    labels = list(dict.fromkeys(r.label for r in rules))
    before = rows.columns

    def of_rule(values: Sequence, rule: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), rule)

    whole = F.array_join("_leaves", MARK, "")
    done = rows.withColumn("_sheet", whole if where is None else F.when(where, whole))
    done = done.withColumn("_marks", _marks(F.col("_sheet"), rules))
    # rules that mark the same are placed once: of equal findings the first rule's is kept
    done = done.withColumn("_same", let(F.col("_marks.m.marked"), lambda ms: F.transform(ms, lambda m, j: F.coalesce(F.array_position(ms, m).cast("int") - 1, j))))

    def with_rule(e: Column, p: Column) -> Column:
        return let(p, lambda x: F.struct(e["rule"].alias("rule"), x["matches"].alias("matches"), x["starts"].alias("starts")))

    places = _held(["_same"], lambda same: F.transform("_marks", lambda e, j: F.when(F.get(same, j) == j, with_rule(e, octet_places(e["m"])))))
    done = done.withColumn("_places", places)

    def flat(places: str, to: str) -> dict[str, Column]:
        of_places = F.flatten(F.transform(places, lambda x: F.array_repeat(x["rule"], F.size(x["matches"]))))
        return {f"{to}_matches": F.flatten(F.col(f"{places}.matches")), f"{to}_at": F.flatten(F.col(f"{places}.starts")), f"{to}_rules": of_places}

    def keys(to: str) -> Column:
        found = F.sort_array(F.transform(f"{to}_at", lambda s, g: _pair(F.lit(LAST) - s, g)))
        if not config.ignore:
            return found
        ignored = sorted(config.ignore)
        return _held([f"{to}_matches"], lambda matches: F.filter(found, lambda key: ~F.get(matches, _low(key)).isin(ignored)))

    # where each leaf starts on the sheet
    done = done.withColumn("_from", offsets(F.transform("_leaves", lambda leaf: F.coalesce(F.octet_length(leaf), F.lit(0)) + 1)))

    def leaves_of(forward: Column) -> Column:
        """The leaf of each finding, of keys in the order of starts: what is sorted in before a finding is leaves and findings."""
        first = F.transform("_from", lambda s: F.shiftleft(s.cast("bigint"), 32))
        both = F.sort_array(F.concat(first, F.transform(forward, lambda key, i: _pair(_start(key), i + 1))))
        return F.filter(F.transform(both, lambda x, p: let(_low(x), lambda i: F.when(i > 0, p - i))), lambda leaf: leaf.isNotNull())

    def cut(octets: Column, begin: Column, end: Column) -> Column:
        return F.substring(octets, begin + 1, end - begin).cast("string")

    # --- what is replaced: findings of the first of the rules that mark the same
    distinct = F.filter("_places", lambda x: x.isNotNull())
    done = done.withColumn("_own", distinct).withColumns(flat("_own", "_own")).withColumn("_own_keys", keys("_own"))
    ends = _held(["_own_at"], lambda at: F.transform("_own_matches", lambda m, g: F.get(at, g) + F.octet_length(m)))
    # from here on in the order of starts
    done = done.withColumn("_kept", F.reverse(let(ends, lambda e: let(F.col("_own_keys"), lambda keys: _kept(keys, e)))))
    done = done.withColumn("_kept_in", F.when(F.size("_kept") > 0, leaves_of(F.col("_kept"))).otherwise(empty("int")))
    codes = [labels.index(r.label) << (LEAF_BITS + KEPT_BITS) for r in rules]

    def numbered(by_label: Column) -> Column:
        """Pairs of a kept finding's index and its number: leaf by leaf and, in a leaf, from its end."""

        def code(x: Column) -> Column:
            return F.shiftright(x, LEAF_BITS + KEPT_BITS).cast("int")

        def counted(first: Column) -> Column:
            def one(x: Column, r: Column) -> Column:
                return _pair(F.lit(2**KEPT_BITS - 1) - x.bitwiseAND(F.lit(2**KEPT_BITS - 1)).cast("int"), r - F.get(first, code(x)))

            return F.sort_array(F.transform(by_label, one))

        # the place before the first of each label
        firsts = let(F.transform(by_label, code), lambda cs: F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda c: F.array_position(cs, c).cast("int") - 2))
        return let(firsts, counted)

    by_label = _held(["_own_rules", "_kept_in"], lambda of, leaf: F.sort_array(F.transform("_kept", lambda key, i: (
        of_rule(codes, F.get(of, _low(key))) + F.shiftleft(F.get(leaf, i).cast("bigint"), KEPT_BITS) + (F.lit(2**KEPT_BITS - 1) - i)))))
    done = done.withColumn("_numbered", F.when(F.size("_kept") > 0, let(by_label, numbered)).otherwise(empty("bigint")))

    def rewritten(kept: Column, matches: Column, of: Column, numbers: Column, octets: Column) -> Column:
        def end(key: Column) -> Column:
            return _start(key) + F.octet_length(F.get(matches, _low(key)))

        def piece(key: Column, i: Column) -> Column:
            begin = F.when(i > 0, end(F.get(kept, i - 1))).otherwise(F.lit(0))
            opened = of_rule([f"<{r.label}_" for r in rules], F.get(of, _low(key)))
            return F.concat(cut(octets, begin, _start(key)), opened, _low(F.get(numbers, i)).cast("string"), F.lit(">"))

        tail = cut(octets, end(F.element_at(kept, -1)), F.octet_length(octets))
        return F.array_join(F.concat(F.transform(kept, piece), F.array(tail)), "")

    pieces = _held(["_kept", "_own_matches", "_own_rules", "_numbered"], lambda *got: let(F.col("_sheet").cast("binary"), lambda octets: rewritten(*got, octets)))
    done = done.withColumn("_written", F.split(F.when(F.size("_kept") > 0, pieces).otherwise(F.col("_sheet")), MARK, -1))
    # a leaf has as many marks as before, each of which cut it in two
    marks = F.transform("_leaves", lambda leaf: F.coalesce(F.length(leaf) - F.length(F.replace(leaf, F.lit(MARK), F.lit(""))), F.lit(0)) + 1)
    together = _held(["_written"], lambda parts: let(marks, lambda ns: let(offsets(ns), lambda first: F.transform(
        "_leaves", lambda leaf, i: F.when(leaf.isNotNull(), F.array_join(F.slice(parts, F.get(first, i) + 1, F.get(ns, i)), MARK))))))
    one_by_one = _held(["_written"], lambda parts: F.transform("_leaves", lambda leaf, i: F.when(leaf.isNotNull(), F.get(parts, i))))
    done = done.withColumn("_new", F.when(F.size("_written") == F.size("_leaves"), one_by_one).when(F.size("_leaves") > 0, together).otherwise(empty("string")))

    # --- the same in code points, counted within leaves
    ascii_only = F.octet_length("_sheet") == F.length("_sheet")

    def char_starts(keys: str) -> Column:
        """Where findings, in the order of starts, start on the sheet; none if that is where their bytes do."""
        return _held([keys], char_starts_of)

    def char_starts_of(forward: Column) -> Column:
        def between(octets: Column) -> Column:
            sizes = F.transform(forward, lambda key, i: F.length(cut(octets, F.when(i > 0, _start(F.get(forward, i - 1))).otherwise(F.lit(0)), _start(key))))
            return F.slice(offsets(F.concat(sizes, F.array(F.lit(0)))), F.lit(2), F.size(forward))

        return F.when(ascii_only, empty("int")).otherwise(let(F.col("_sheet").cast("binary"), between))

    char_leaves = offsets(F.transform("_leaves", lambda leaf: F.coalesce(F.length(leaf), F.lit(0)) + 1))
    done = done.withColumn("_char_from", F.when(ascii_only, F.col("_from")).otherwise(char_leaves))

    def fields(key: Column, i: Column, leaf: Column, match: Column, first: Column, char_first: Column, chars: Column) -> dict[str, Column]:
        bstart = _start(key) - F.get(first, leaf)
        start = F.when(F.size(chars) == 0, bstart).otherwise(F.get(chars, i) - F.get(char_first, leaf))
        return {"from_end": -start, "start": start, "end": start + F.length(match), "bstart": bstart, "bend": bstart + F.octet_length(match)}

    def struct(values: dict[str, Column], names: str) -> Column:
        return F.struct(*(values[name].alias(name) for name in names.split()))

    done = done.withColumn("_kept_chars", char_starts("_kept"))

    def placed(of: Column, numbers: Column, matches: Column, leaves: Column, *starts: Column) -> Column:
        def one(key: Column, i: Column) -> Column:
            label, n, match, leaf = of_rule([r.label for r in rules], F.get(of, _low(key))), _low(F.get(numbers, i)), F.get(matches, _low(key)), F.get(leaves, i)
            values = fields(key, i, leaf, match, *starts) | {"leaf": leaf, "label": label, "n": n, "placeholder": placeholder(label, n), "original": match}
            return struct(values, "leaf start end bstart bend label n placeholder original")

        return F.transform("_kept", one).cast(f"array<{PLACED}>")

    done = done.withColumn("_placed", _held(["_own_rules", "_numbered", "_own_matches", "_kept_in", "_from", "_char_from", "_kept_chars"], placed))

    # --- all findings, of every rule, leaf by leaf and in each in resolving order
    of_all = _held(["_places", "_same"], lambda places, same: F.transform("_marks", lambda e, j: with_rule(e, F.get(places, F.get(same, j)))))
    done = done.withColumn("_all", of_all).withColumns(flat("_all", "_all")).withColumn("_all_keys", F.reverse(keys("_all")))
    done = done.withColumn("_all_in", F.when(F.size("_all_keys") > 0, leaves_of(F.col("_all_keys"))).otherwise(empty("int"))).withColumn("_all_chars", char_starts("_all_keys"))
    done = done.withColumn("_by_leaf", F.sort_array(F.transform("_all_in", lambda leaf, i: _pair(leaf, F.lit(LAST) - i))))

    def findings(keys: Column, matches: Column, of: Column, *starts: Column) -> Column:
        def one(i: Column, key: Column, leaf: Column) -> Column:
            match, rule = F.get(matches, _low(key)), F.get(of, _low(key))
            values = fields(key, i, leaf, match, *starts) | {
                "rank": of_rule([-r.priority for r in rules], rule), "ordinal": of_rule([r.ordinal for r in rules], rule), "sub": F.lit(0),
                "label": of_rule([r.label for r in rules], rule), "snippet": match, "detector": of_rule([r.detector for r in rules], rule),
                "weight": of_rule([r.weight for r in rules], rule), "copies": F.lit(1),
            }
            return struct(values, "from_end rank ordinal sub start end bstart bend label snippet detector weight copies")

        return F.transform("_by_leaf", lambda x: let(F.lit(LAST) - _low(x), lambda i: let(F.get(keys, i), lambda key: one(i, key, _high(x)))))

    found = _held(["_all_keys", "_all_matches", "_all_rules", "_from", "_char_from", "_all_chars"], findings)
    done = done.withColumns({"_findings": found, "_which": F.transform("_by_leaf", _high)})
    return done.select(*before, "_new", "_placed", "_findings", "_which")
