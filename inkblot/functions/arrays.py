"""Array helpers built from Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pass appends to at most this many numbers at a time, or to the root of how many there are, if that is more.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it, however often, in ``body``.

    A fold over nothing that ends in ``body``; unlike ``transform`` over a one-element array, it
    copies neither the value nor the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def collect_pass(
    items: Column,
    carry: Column,
    element_type: str,
    step: Callable[[Column, Column], tuple[Column, Column, Column | None]],
) -> Column:
    """One left-to-right pass over ``items`` that carries a value and gathers results.

    ``step(carry, item)`` gives the next carry, the result for that item and whether to keep it
    (None: always). Each step copies what is carried and gathered, to the last string, so results are gathered
    in blocks that are flattened at the end, and should be small: see :func:`index_pass`.
    """
    none = empty(element_type)

    def begin(carry: Column) -> Column:
        return F.struct(carry.alias("carry"), none.alias("out"))

    def one(state: Column, item: Column) -> Column:
        after, result, keep = step(state["carry"], item)
        out = F.array_append(state["out"], result)
        if keep is not None:
            out = F.when(keep, out).otherwise(state["out"])
        return F.struct(after.alias("carry"), out.alias("out"))

    def in_blocks(items: Column, size: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            return F.array_append(done, F.aggregate(F.slice(items, k * size + 1, size), begin(F.element_at(done, -1)["carry"]), one))

        last = F.floor((F.size(items) - 1) / size).cast("int")
        blocks = F.aggregate(F.sequence(F.lit(0), last), F.array(begin(carry)), block)
        return F.flatten(F.transform(blocks, lambda b: b["out"]))

    def run(items: Column) -> Column:
        n = F.size(items)
        few = F.aggregate(items, begin(carry), one, lambda state: state["out"])
        many = let(F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int")), lambda size: in_blocks(items, size))
        return F.when(n > BLOCK, many).when(n > 0, few).otherwise(none)

    return let(items, run)


def index_pass(n: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column, Column | None]]) -> Column:
    """A pass over the indices below ``n`` that gathers whole numbers: what stands there is looked up, not carried."""
    return collect_pass(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty("int")), carry, "int", step)


def offsets(sizes: Column, number: str = "int", first: Column | None = None) -> Column:
    """For each size, ``first`` (0 if not given) and the sum of the sizes before it."""
    begin = F.lit(0).cast(number) if first is None else first

    def sums(start: Column, sizes: Column) -> Column:
        return F.aggregate(sizes, F.array(start), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))

    def in_blocks(sizes: Column, block: Column) -> Column:
        # the last sum of a block is the first of the next one
        last = F.floor((F.size(sizes) - 1) / block).cast("int")
        blocks = F.aggregate(
            F.sequence(F.lit(0), last), F.array(F.array(begin)),
            lambda done, k: F.array_append(done, sums(F.element_at(F.element_at(done, -1), -1), F.slice(sizes, k * block + 1, block))),
        )
        return F.flatten(F.transform(blocks, lambda b: F.slice(b, F.lit(1), F.size(b) - 1)))

    def running(sizes: Column) -> Column:
        n = F.size(sizes)
        few = F.slice(sums(begin, sizes), F.lit(1), n)
        many = let(F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int")), lambda block: in_blocks(sizes, block))
        return F.when(n > BLOCK, many).when(n > 1, few).otherwise(F.transform(sizes, lambda _: begin))

    return let(sizes, running)
