"""Collocations: phrases of two to four words that occur more often than their parts let expect.

The layout is that of external n-gram estimation: counts are streams, sorted once in prefix order (by first
word, second word ...) and once in suffix order (by last word, last but one ...). In prefix order every
phrase follows its own first parts and comes right before the phrases that go on from it; so one walk in
step over the phrases of all lengths gives each its left counts, and the largest count of a phrase that
extends it to the right. The same walk in suffix order gives right counts and extensions to the left.
A walk holds one open phrase of each length and nothing else. Single words are merge-joined to pairs, so
that no partition holds all phrases of a frequent word.

Counting goes length by length. A phrase can only be as frequent as its parts, so phrases are counted only
where both parts, one word shorter, are frequent. A bit map of fixed size tells tasks which are; a bit set
by another phrase costs time and changes nothing, because counts are of the phrases themselves. Tasks
number the phrases of a batch and send each once, with its count.

A candidate that lies in a longer phrase nearly as frequent is dropped. It is enough to look at phrases one
word longer: any phrase between the two is at least as frequent as the longer one.

Null and empty texts have no words. Null languages count as ``und``. Repeated rows count each time. Texts of
any length are worked through in slices. Ties are told apart by the phrase's bytes. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import lean_batches, mixed64, small_batches, text_bytes, written

LONGEST, LEAST, COVER, TOP, UNIT = 4, 30, 80, 2000, 2_000_000
BITS, SALTS = 1 << 25, 16
SLICE = 4 << 20

# A-Z to lower case, all marks that end a piece to one
TO_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")
GAPS = re.compile(rb"[\x20\x09\n]")


class Words(NamedTuple):
    """The words of a slice: the distinct ones, the number of each, its piece, and how many are old."""

    distinct: pa.Array
    ids: np.ndarray
    piece: np.ndarray
    old: int


def word_slices(blob: bytes, size: int = SLICE, longest: int = LONGEST) -> Iterator[Words]:
    """The words of a text in pieces, slice by slice; a slice begins with the last words of the one before."""
    begin = at = 0
    step = size
    while at < len(blob):
        cut = GAPS.search(blob, min(at + step, len(blob)))
        end = cut.start() if cut else len(blob)
        part = np.frombuffer(blob, np.uint8, end - begin, begin)
        ends_piece = part == 10
        in_word = (~(ends_piece | (part == 32) | (part == 9))).view(np.int8)
        edges = np.flatnonzero(np.diff(in_word, prepend=0, append=0))
        starts, n = edges[::2], len(edges) // 2
        old = int(np.searchsorted(starts, at - begin))
        step = size if n > old else 2 * step  # a long gap is read again with what comes before it
        if n > old:
            turns = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(part)])
            coded = turns.take(pa.array(np.arange(0, 2 * n - 1, 2))).dictionary_encode()
            yield Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(np.flatnonzero(ends_piece), starts), old)
            begin += int(starts[max(0, n - longest + 1)])
        at = end


def _hash_of(words: list[bytes], lang: bytes) -> np.ndarray:
    start = crc32(lang)
    return np.fromiter((crc32(w, start) for w in words), np.uint64, len(words))


def _longer(hashed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mixed64((hashed * np.uint64(0x9E3779B97F4A7C15)) ^ word)


def _is_set(bits: np.ndarray | None, hashed: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashed), bool)
    places = (hashed & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def slice_counts(words: Words, length: int, known: list[np.ndarray | None], lang: bytes) -> tuple[pa.Array, np.ndarray]:
    """The phrases of ``length`` words that are not all among the old ones, with their counts.

    ``known`` has the bit maps of all shorter lengths; a phrase is counted if both of its parts are in them.
    """
    ids, old, many = words.ids, words.old, len(words.distinct)
    if length == 1:
        counts = np.bincount(ids[old:], minlength=many)
        there = np.flatnonzero(counts)
        return words.distinct.take(pa.array(there)), counts[there]
    by_word = _hash_of(words.distinct.to_pylist(), lang)
    at = np.flatnonzero(_is_set(known[0], by_word)[ids])
    hashed = by_word[ids[at]]
    for n in range(2, length + 1):  # where phrases of n words begin whose parts are known
        pair = np.flatnonzero((np.diff(at) == 1) & (words.piece[at[1:]] == words.piece[at[:-1]]))
        at = at[pair]
        if n < length:
            hashed = _longer(hashed[pair], by_word[ids[at + n - 1]])
            there = _is_set(known[n - 1], hashed)
            at, hashed = at[there], hashed[there]
    at = at[at + length > old]
    # phrases numbered word by word, each number made of the one before and the next word's
    number, firsts = ids[at], [np.arange(many)]
    for n in range(1, length):
        pairs = number * many + ids[at + n]
        if n < length - 1:
            seen, number = np.unique(pairs, return_inverse=True)
        else:
            seen, counts = np.unique(pairs, return_counts=True)
        firsts = [*(f[seen // many] for f in firsts), seen % many]
    return pc.binary_join_element_wise(*(words.distinct.take(pa.array(f)) for f in firsts), pa.scalar(b" ", pa.large_binary())), counts


def _counts(docs: DataFrame, length: int, known: list) -> DataFrame:
    """``lang, phrase, f``: how often every phrase of ``length`` words occurs that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [b.value for b in known]
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                rows = pa.array([i for i, x in enumerate(langs) if x == lang])
                blob = b"\n".join(batch.column(1).take(rows).to_pylist()).translate(TO_PIECES)
                for words in word_slices(blob):
                    phrases, counts = slice_counts(words, length, bits, lang.encode())
                    columns = [pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes(docs).alias("text"))
    return texts.mapInArrow(lean_batches(count), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bit_map(phrases: DataFrame, bits: int) -> np.ndarray:
    """One bit for the hash of each phrase. Its size is fixed; when it fills up, more phrases are counted."""
    mask = np.uint64(bits - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [np.zeros(0, np.uint64)]
        for b in batches:
            langs, split = b.column(0).to_pylist(), b.column(1)
            starts = np.array([crc32(x) for x in langs], np.int64)
            hashed = None
            for i in range(len(split[0]) if b.num_rows else 0):  # all phrases are of one length
                word = np.fromiter((crc32(w[i], s) for w, s in zip(split.to_pylist(), starts.tolist())), np.uint64, b.num_rows)
                hashed = word if hashed is None else _longer(hashed, word)
            places.append(np.unique(hashed & mask) if b.num_rows else places[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(places)).astype(np.int64))], names=["place"])

    hashed = phrases.select(F.col("lang").cast("binary"), F.split("phrase", " ").cast("array<binary>")).mapInArrow(mark, "place long")
    word = F.shiftright("place", 6)
    words = hashed.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("set")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` of all phrases that occur ``least`` times, and ``lang, n``: the words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    all_words = written(_counts(docs, 1, []), "phrases-1")
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, known = [all_words.where(F.col("f") >= least)], []
    for length in range(2, longest + 1):
        known.append(spark.sparkContext.broadcast(_bit_map(levels[-1], bits)))
        levels.append(written(_counts(docs, length, known).where(F.col("f") >= least), f"phrases-{length}"))
    found = [x.select("lang", F.split("phrase", " ").alias("words"), "f") for x in levels]
    return reduce(DataFrame.union, found), totals


def _in_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases in order, each with the counts of its own first parts and the largest of those that go on from it.

    Columns: lang, words, f, one (the count of the first word), kept (a struct that is handed on).
    """
    names = ["lang", "words", "f", "kept", "parts", "longer"]
    open_: list[list] = []  # the phrase at hand, and its first parts from two words on, longest last
    done: list[list] = []

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            done.append(open_.pop())

    def out(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * 6
        types = [pa.string(), pa.list_(pa.string()), pa.int64(), schema.field("kept").type, pa.list_(pa.int64()), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        done.clear()
        return made

    schema = None
    for b in batches:
        schema = b.schema
        for lang, words, f, one, kept in zip(*(b.column(i).to_pylist() for i in range(5))):
            keep = 0
            while keep < len(open_) and open_[keep][0] == lang and open_[keep][1] == words[: keep + 2] and len(words) > keep + 2:
                keep += 1
            close(keep)
            if open_:
                open_[-1][5] = max(open_[-1][5], f)
            parts = [*open_[-1][4], open_[-1][2]] if open_ else [one]
            open_.append([lang, words, f, kept, parts, 0])
        if schema is not None and len(done) >= 1:
            yield out(schema)
    close(0)
    if schema is not None:
        yield out(schema)


def _walked(phrases: DataFrame, first: DataFrame, handed_on: str) -> DataFrame:
    """The walk over phrases of two words and more, whose ``words`` stand in the order to walk in."""
    pairs = phrases.where(F.size("words") == 2).join(
        first.hint("merge"), (phrases["lang"] == first["w_lang"]) & (F.get("words", F.lit(0)) == first["w"]))
    rows = pairs.select("lang", "words", "f", F.col("w_f").alias("one"), "kept")
    rows = rows.union(phrases.where(F.size("words") > 2).select("lang", "words", "f", F.lit(None).cast("long").alias("one"), "kept"))
    word = [F.get("words", F.lit(i)) for i in range(LONGEST)]
    dealt = rows.repartition("lang", word[0], word[1]).sortWithinPartitions("lang", "words")
    return dealt.mapInArrow(_in_step, f"lang string, words array<string>, f long, kept {handed_on}, parts array<long>, longer long")


def candidates(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more with the counts of their first parts (``left``), their last parts
    (``right``), both from one word on, and the largest count of a phrase one word longer (``longer``)."""
    phrases = written(phrases, "phrases-all")
    ones = phrases.where(F.size("words") == 1)
    first = ones.select(F.col("lang").alias("w_lang"), F.get("words", F.lit(0)).alias("w"), F.col("f").alias("w_f"))
    nothing = F.struct(F.lit(None).cast("array<long>").alias("parts"), F.lit(None).cast("long").alias("longer"))
    forward = _walked(phrases.where(F.size("words") > 1).withColumn("kept", nothing), first, "struct<parts:array<long>,longer:long>")
    turned = forward.select("lang", F.reverse("words").alias("words"), "f", F.struct("parts", "longer").alias("kept"))
    backward = _walked(turned, first, "struct<parts:array<long>,longer:long>")
    return backward.select(
        "lang", F.reverse("words").alias("words"), "f", F.col("kept.parts").alias("left"), F.col("parts").alias("right"),
        F.greatest("kept.longer", "longer").alias("longer"))


def weakest_cut(unit: int = UNIT) -> Column:
    """``score, k, l, r`` of the cut whose parts say least for the phrase; the smallest k among equals."""

    def cut(left: Column, k: Column) -> Column:
        right = F.get("right", F.size("right") - k - 1)
        # of decimals, so that products of more than 64 bits stay exact
        score = F.call_function("div", F.col("f").cast("decimal(19,0)") * F.lit(unit).cast("decimal(19,0)"), (left.cast("decimal(19,0)") + right.cast("decimal(19,0)")))
        return F.struct(score.alias("score"), (k + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform("left", cut))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    phrases, totals = frequent_phrases(docs, LONGEST, least, bits)
    kept = candidates(phrases).where(100 * F.col("longer") < cover * F.col("f"))
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), weakest_cut().alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of parts of a language first, so that the last step has few rows of each, however common it is
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
