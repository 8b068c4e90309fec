"""Where a pattern or a literal occurs in a text: native expressions, no Python per row.

Matching and placing are two steps. A *hit* holds the matches of one pattern and the sizes of the
texts between them; :func:`place` turns hits into spans. So a scan with many rules places all their
hits with one expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty, let, offsets
from inkblot.functions.dialect import SPACE, WORD

# sizes: of the texts between matches, code points and bytes as the two halves of one number; wanted: indices of the
# matches to place; words: how many matches in a row make one span; gaps: the texts between matches, kept only where
# spans of several words need them.
HIT = "struct<matches:array<string>,sizes:array<bigint>,wanted:array<int>,words:int,gaps:array<string>>"
# start and end count code points, half open; bstart and bend count UTF-8 bytes, so that pieces of
# the text can later be cut out of its binary form without walking it from the front each time.
SPAN = "struct<start:int,end:int,bstart:int,bend:int,snippet:string>"


def _indices(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(empty("int"))


def _packed(text: Column) -> Column:
    """The size of a text: code points and bytes as the two halves of one number."""
    return F.shiftleft(F.length(text).cast("bigint"), 32) + F.octet_length(text)


def _hit(matches: Column, gaps: Column, wanted: Column, words: int = 1) -> Column:
    return _sized_hit(matches, F.transform(gaps, _packed), wanted, words, gaps)


def _sized_hit(matches: Column, sizes: Column, wanted: Column, words: int = 1, gaps: Column | None = None) -> Column:
    return F.struct(
        matches.alias("matches"),
        sizes.alias("sizes"),
        wanted.alias("wanted"),
        F.lit(words).alias("words"),
        (gaps if words > 1 else F.lit(None).cast("array<string>")).alias("gaps"),
    )


def _span(start: Column, end: Column, bstart: Column, bend: Column, snippet: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), bstart.alias("bstart"), bend.alias("bend"), snippet.alias("snippet"))


def place(hit: Column) -> Column:
    """The spans of a hit; none for a null one."""
    return place_as(hit, _span, SPAN)


def place_as(hit: Column, body: Callable[..., Column], element_type: str) -> Column:
    """What ``body`` makes of the fields of each span of a hit; none for a null one.

    A match starts after all earlier gaps and matches and its own gap. Only sizes go through the
    running sum, not the texts: code points and bytes as the two halves of one number.
    """
    matches = hit["matches"]
    mask = F.lit(2**32 - 1)

    def chars(size: Column) -> Column:
        return F.shiftright(size, 32).cast("int")

    def octets(size: Column) -> Column:
        return size.bitwiseAND(mask).cast("int")

    def step(match: Column, i: Column) -> Column:  # from the start of a match to that of the next
        return _packed(match) + F.get(hit["sizes"], i + 1)

    def spans(starts: Column) -> Column:
        def snippet(i: Column, j: Column) -> Column:
            pieces = F.transform(
                F.sequence(i, j),
                lambda k: F.when(k == i, F.get(matches, k)).otherwise(F.concat(F.get(hit["gaps"], k), F.get(matches, k))),
            )
            return F.when(i == j, F.get(matches, i)).otherwise(F.array_join(pieces, ""))

        def one(i: Column) -> Column:
            j = i + hit["words"] - 1
            last, begin, end = F.get(matches, j), F.get(starts, i), F.get(starts, j)
            return body(chars(begin), chars(end) + F.length(last), octets(begin), octets(end) + F.octet_length(last), snippet(i, j))

        return F.transform(hit["wanted"], one)

    def only() -> Column:
        match, before = F.get(matches, F.lit(0)), F.get(hit["sizes"], F.lit(0))
        start, bstart = chars(before), octets(before)
        return F.array(body(start, start + F.length(match), bstart, bstart + F.octet_length(match), match))

    placed = F.when(F.size(matches) == 1, only()).otherwise(let(offsets(F.transform(matches, step), "bigint", F.get(hit["sizes"], F.lit(0))), spans))
    return F.when(hit.isNotNull(), placed).otherwise(empty(element_type))


def regex_hit(
    text: Column,
    java_regex: str,
    guard: Sequence[str] = (),
    keep: Callable[[Column], Column] | None = None,
) -> Column:
    """Every non-overlapping match, left to right, that ``keep`` accepts; null if there is none.

    ``guard`` lists literals of which every matching text holds at least one: a byte search that
    saves most texts the regular expression. A text with a match is gone through once more, to put
    a NUL on both sides of each; cut there, it falls into gaps and matches by turns.
    """
    def hit(matches: Column, sizes: Column) -> Column:
        def wanted() -> Column:
            return F.filter(_indices(matches), lambda i: keep(F.get(matches, i))) if keep else _indices(matches)

        return let(wanted(), lambda want: F.when(F.size(want) > 0, _sized_hit(matches, sizes, want)))

    def by_turns(parts: Column) -> Column:
        # every other one, by its index: nothing is asked of the rest
        last = F.shiftright(F.size(parts) - 1, 1)
        sizes = F.transform(F.sequence(F.lit(0), last), lambda k: _packed(F.get(parts, k * 2)))
        return F.struct(_odd(parts, last).alias("matches"), sizes.alias("sizes"))

    marked = let(F.split(F.regexp_replace(text, java_regex, "\0$0\0"), "\0", -1), by_turns)
    # a text that holds NULs itself is matched and split by the pattern
    apart = F.struct(
        F.regexp_extract_all(text, F.lit(java_regex), F.lit(0)).alias("matches"),
        F.transform(F.split(text, java_regex, -1), _packed).alias("sizes"),
    )
    cut = F.when(F.contains(text, F.lit("\0")), apart).otherwise(marked)
    return F.when(_present(text, java_regex, guard), let(cut, lambda c: hit(c["matches"], c["sizes"])))


def _present(text: Column, java_regex: str, guard: Sequence[str]) -> Column:
    present = text.rlike(java_regex)
    return reduce(or_, [F.contains(text, F.lit(literal)) for literal in guard]) & present if guard else present


def _odd(parts: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.get(parts, k * 2 - 1))


# marked: the text with a NUL on both sides of every match; apart: of a text that holds NULs itself, matches and gaps.
MARKED = "struct<marked:string,apart:struct<matches:array<string>,gaps:array<string>>>"


def regex_marked(text: Column, java_regex: str, guard: Sequence[str] = ()) -> Column:
    """What :func:`octet_places` cuts: every match that :func:`regex_hit` finds; null if there is none."""
    own_nuls = F.contains(text, F.lit("\0"))
    apart = F.struct(F.regexp_extract_all(text, F.lit(java_regex), F.lit(0)).alias("matches"), F.split(text, java_regex, -1).alias("gaps"))
    marked = F.when(~own_nuls, F.regexp_replace(text, java_regex, "\0$0\0"))
    return F.when(_present(text, java_regex, guard), F.struct(marked.alias("marked"), F.when(own_nuls, apart).alias("apart")))


def octet_places(marked: Column) -> Column:
    """The matches of a :data:`MARKED` and the byte at which each starts, ``struct<matches, starts>``."""

    def places(matches: Column, starts: Column) -> Column:
        return F.struct(matches.alias("matches"), starts.alias("starts"))

    def by_turns(parts: Column) -> Column:
        n = F.shiftright(F.size(parts) - 1, 1)
        first = F.octet_length(F.get(parts, F.lit(0)))
        # from the start of a match to that of the next
        steps = F.transform(F.sequence(F.lit(1), n), lambda k: F.octet_length(F.get(parts, k * 2 - 1)) + F.octet_length(F.get(parts, k * 2)))
        return F.when(n == 1, places(F.array(F.get(parts, F.lit(1))), F.array(first))).otherwise(places(_odd(parts, n), offsets(steps, "int", first)))

    def apart(x: Column) -> Column:
        steps = F.transform(x["matches"], lambda m, i: F.octet_length(m) + F.octet_length(F.get(x["gaps"], i + 1)))
        return places(x["matches"], offsets(steps, "int", F.octet_length(F.get(x["gaps"], F.lit(0)))))

    return F.when(marked["marked"].isNotNull(), let(F.split(marked["marked"], "\0", -1), by_turns)).otherwise(apart(marked["apart"]))


def pattern_hit(text: Column, java_regex: Column) -> Column:
    """Every non-overlapping match of a pattern that is a column; null if there is none."""

    def hit(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, let(F.split(text, java_regex, -1), lambda gaps: _hit(matches, gaps, _indices(matches))))

    return let(F.regexp_extract_all(text, java_regex, F.lit(0)), hit)


def literal_hit(text: Column, literal: Column) -> Column:
    """Every non-overlapping occurrence of a (non-empty) literal, left to right; null if none."""
    quoted = F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def hit(gaps: Column) -> Column:
        return let(F.array_repeat(literal, F.size(gaps) - 1), lambda ms: _hit(ms, gaps, _indices(ms)))

    return F.when(F.contains(text, literal), let(F.split(text, quoted, -1), hit))


def single_hit(snippet: Column, before: Column) -> Column:
    """One span of which the text, and what comes before it, is known."""
    return _hit(F.array(snippet), F.array(before), F.array(F.lit(0)))


# Names are made of words: letters, digits and inner marks such as the ones in "O'Neil" or "Unit#7".
NAME_WORD = rf"[{WORD}](?:[{WORD}#'’&.-]*[{WORD}])?"


def ngram_hits(text: Column, keep: dict[int, Callable[[Column], Column] | None]) -> Column:
    """For each number of words, runs of that many words whose look-up key is accepted.

    Only white space may stand between the words. The look-up key (:func:`ngram_key`) is the words
    in lower case, one blank apart.
    """

    def wanted(matches: Column, gaps: Column, words: int) -> Column:
        def accepted(i: Column) -> Column:
            test = i + words <= F.size(matches)
            if keep[words]:
                test = test & keep[words](F.lower(F.array_join(F.slice(matches, i + 1, F.lit(words)), " ")))
            for k in range(1, words):
                test = test & F.get(gaps, i + k).rlike(f"^[{SPACE}]+\\z")
            return test

        return F.filter(_indices(matches), accepted)

    def of_size(matches: Column, gaps: Column, words: int) -> Column:
        return let(
            wanted(matches, gaps, words),
            lambda want: F.when(F.size(want) > 0, _hit(matches, gaps, want, words)),
        )

    def hits(matches: Column, gaps: Column) -> Column:
        return F.array(*[of_size(matches, gaps, n) for n in sorted(keep)])

    return let(
        F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0)),
        lambda ms: let(F.split(text, NAME_WORD, -1), lambda gaps: hits(ms, gaps)),
    )


def ngram_key(snippet: Column) -> Column:
    return F.lower(F.regexp_replace(snippet, f"[{SPACE}]+", " "))


def regex_spans(text: Column, java_regex: str, guard: Sequence[str] = ()) -> Column:
    return let(regex_hit(text, java_regex, guard), place)
