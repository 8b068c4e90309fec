"""Overlaps, placeholders and rewriting: from findings to a scrubbed text and its vault.

A document is an array of one or more leaves: its text, or the strings of a structured record.
Placeholders are numbered per label over the whole document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkblot.functions.arrays import index_pass, let, offsets
from inkblot.operators.detect import FINDING

PLACED = (
    "struct<leaf:int,start:int,end:int,bstart:int,bend:int,label:string,n:int,placeholder:string,original:string>"
)

# As many findings are numbered without sorting them.
FEW = 16


def resolve(findings: Column) -> Column:
    """Of findings in resolving order, those that overlap none kept before them.

    Starts never increase on the way, so a finding is free of all kept ones exactly if it ends at or
    before the start of the last kept one.
    """

    def run(findings: Column) -> Column:
        def step(limit: Column, i: Column) -> tuple[Column, Column, Column]:
            f = F.get(findings, i)
            free = f["end"] <= limit
            return F.when(free, f["start"]).otherwise(limit), i, free

        free = index_pass(F.size(findings), F.lit(2**31 - 1), step)
        return F.when(F.size(findings) > 1, F.transform(free, lambda i: F.get(findings, i))).otherwise(findings)

    return let(findings, run)


def placeholder(label: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), label, F.lit("_"), n.cast("string"), F.lit(">"))


def number(kept: Column, base: Callable[[Column], Column] | None = None) -> Column:
    """Numbered placeholders for the kept findings of all leaves (an array for each leaf).

    Per label, leaf by leaf and from the end of a leaf to its start; the result is ordered by leaf
    and start. ``base(label)`` is the count to go on from, where the document has earlier rows.
    """
    def found(f: Column, leaf: Column) -> Column:
        return F.struct(
            leaf.alias("leaf"), f["label"].alias("label"), f["start"].alias("start"), f["end"].alias("end"),
            f["bstart"].alias("bstart"), f["bend"].alias("bend"), f["snippet"].alias("original"),
        )

    def placed(x: Column, n: Column) -> Column:
        shown = n + base(x["label"]) if base else n
        return F.struct(
            x["leaf"].alias("leaf"), x["start"].alias("start"), x["end"].alias("end"), x["bstart"].alias("bstart"), x["bend"].alias("bend"),
            x["label"].alias("label"), shown.cast("int").alias("n"), placeholder(x["label"], shown).alias("placeholder"), x["original"].alias("original"),
        )

    def few(located: Column, labels: Column) -> Column:
        count = lambda x, i: F.size(F.filter(F.slice(labels, F.lit(1), i + 1), lambda label: label == x["label"]))
        return F.transform(located, lambda x, i: placed(x, count(x, i)))

    def many(located: Column, by_label: Column) -> Column:
        def step(first: Column, i: Column) -> tuple[Column, Column, None]:
            same = F.get(by_label, i)["label"] == F.get(by_label, i - 1)["label"]
            begin = F.when(same, first).otherwise(i)
            return begin, i - begin + 1, None

        counted = index_pass(F.size(by_label), F.lit(0), step)
        return let(counted, lambda ns: F.transform(by_label, lambda x, i: placed(F.get(located, x["seq"]), F.get(ns, i))))

    def numbered(located: Column) -> Column:
        labels = F.transform(located, lambda x: x["label"])
        by_label = F.sort_array(F.transform(located, lambda x, seq: F.struct(x["label"].alias("label"), seq.alias("seq"))))
        # a few are counted one by one, without sorting them by label
        by_hand = F.size(located) <= FEW
        return F.when(by_hand, let(labels, lambda names: few(located, names))).otherwise(let(by_label, lambda keys: many(located, keys)))

    located = F.flatten(F.transform(kept, lambda fs, leaf: F.transform(fs, lambda f: found(f, leaf))))
    return F.sort_array(let(located, numbered))


def rewrite(text: Column, placed: Column, first: Column | None = None, count: Column | None = None) -> Column:
    """The text with each placed span (in order of start) replaced by its placeholder.

    ``first`` and ``count`` say which of ``placed`` are the text's; by default all.
    """
    first, count = F.lit(0) if first is None else first, F.size(placed) if count is None else count

    def cut(octets: Column, begin: Column, end: Column) -> Column:
        return F.substring(octets, begin + 1, end - begin).cast("string")

    def pieces(octets: Column) -> Column:
        def before(k: Column) -> Column:
            begin = F.when(k > first, F.get(placed, k - 1)["bend"]).otherwise(F.lit(0))
            return F.concat(cut(octets, begin, F.get(placed, k)["bstart"]), F.get(placed, k)["placeholder"])

        tail = cut(octets, F.get(placed, first + count - 1)["bend"], F.octet_length(octets))
        return F.array_join(F.concat(F.transform(F.sequence(first, first + count - 1), before), F.array(tail)), "")

    return F.when(count > 0, let(text.cast("binary"), pieces)).otherwise(text)


def rewrite_leaves(leaves: Column, kept: Column, placed: Column) -> Column:
    """Every leaf rewritten with its share of the placed spans."""
    sizes = F.transform(kept, lambda fs: F.size(fs))

    def rewritten(counts: Column, first: Column) -> Column:
        return F.transform(leaves, lambda leaf, i: rewrite(leaf, placed, F.get(first, i), F.get(counts, i)))

    return let(sizes, lambda counts: let(offsets(counts), lambda first: rewritten(counts, first)))


def scrub_kept(leaves: Column, kept: Column, base: Callable[[Column], Column] | None = None) -> Column:
    """Number what was kept in each leaf and rewrite: ``struct<leaves, placed>``."""
    return let(
        number(kept, base),
        lambda placed: F.struct(
            rewrite_leaves(leaves, kept, placed).alias("leaves"), placed.alias("placed")
        ),
    )
