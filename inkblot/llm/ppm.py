"""Scoring by prediction by partial matching over bytes.

A trie of byte contexts, up to ``order`` bytes long, counts which symbol followed each context in the
training texts. A symbol is coded in its longest context that was seen; if it did not follow there, an
escape is coded, as likely as half the share of distinct followers (method D), and the next shorter
context is tried without the symbols that were just ruled out (exclusion). Below the empty context all
256 symbols are equal. A text begins in a context of 0xFE bytes and ends with the symbol 0xFF; neither
byte occurs in UTF-8, so the score is the log10 probability of the whole text.

How it runs: documents lie in blocks of bounded size. Each block counts its distinct (order+1)-grams and
words once; these counts, not texts, are summed over the corpus, in one shuffle. The trie is grouped by
the last two bytes of the context, below which every level of a branch lies in one group (its size is
bounded by the alphabet, not by the corpus); levels 1 and 0 have at most 65,792 entries and travel with
the code. Each distinct gram gets its log probability there. Values go back to the blocks that asked for
them without grams and words: a block finds them by their place in its own sorted lists.

Null texts count as empty and have the end only. Repeated rows are scored, and learned from, one by one;
a null doc_id counts as empty text for the fold. Without training texts all symbols are equal. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkblot.llm.common import blocks_for, lean_batches, lean_group, lean_keyed, lean_pair, packed, small_batches, text_bytes, unpacked, written

ORDER, BLOCK, CHUNK = 5, 24 << 20, 1 << 20
START, END = 0xFE, 0xFF
TOKENS = -1  # stands in the column of pairs for the number of words
COUNTS = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
VALUES = pa.schema([("is_word", pa.bool_()), ("place", pa.int32()), ("value", pa.float64())])
FLUSH = 1 << 20  # rows of values that a task gathers before it packs them


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed (order+1)-gram that ends at each symbol of each text, and where each text begins."""
    lead = bytes([START]) * order
    data = np.frombuffer(b"".join(lead + t + b"\xff" for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    key = np.zeros(len(data) - order if len(data) else 0, np.int64)
    for i in range(order + 1):
        key = (key << 8) | data[i : i + len(key)]
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else np.zeros(0, np.int64)
    if len(texts) > 1:  # leave out the grams that end in the lead of the next text
        keep = np.ones(len(key), bool)
        gaps = (begins[1:] + np.arange(len(texts) - 1) * order)[:, None] + np.arange(order)
        keep[gaps.ravel()] = False
        key = key[keep]
    return key, begins


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    some, total = [], 0
    for t in texts:
        some.append(t)
        total += len(t)
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of a sorted array begins."""
    return np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)


def distinct(texts: Iterable[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts with their counts. Those of a chunk join the others as soon as they are as many:
    most come again, so that the grams of all chunks side by side would need several times the memory.
    """
    parts, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for some in chunks(texts):
        found = np.sort(grams_of(some, order)[0])
        first = _first_of_each(found)
        parts.append((found[first], np.diff(first, append=len(found))))
        waiting += len(first)
        if waiting >= max(2 * len(parts[0][0]), 3 * CHUNK // 2):
            parts, waiting = [_merged(parts)], 0
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key; sorted first, so that the search goes through ``keys`` in order."""
    order = np.argsort(wanted)
    found = wanted[order]
    first = _first_of_each(found)
    out = np.empty(len(wanted))
    out[order] = np.repeat(values[np.searchsorted(keys, found[first])], np.diff(first, append=len(found)))
    return out


def _texts(blobs: pa.ChunkedArray) -> Iterator[tuple[list, list[bytes], list[bool]]]:
    for table in unpacked(blobs):
        yield table.column("doc_id"), [t.lower() for t in table.column("text").to_pylist()], table.column("train").to_pylist()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of training texts, how often each symbol follows each byte, and how many words there are."""
    counts, words = np.zeros(1 << 16, np.int64), 0
    for b in batches:
        texts = [t.lower() for t in b.column(0).to_pylist()]
        words += sum(len(t.split()) for t in texts)
        for some in chunks(texts):
            counts += np.bincount(grams_of(some, 1)[0], minlength=1 << 16)
    pair = np.append(np.flatnonzero(counts), TOKENS)
    yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(np.append(counts[pair[:-1]], words))], names=["pair", "n"])


def _count_block(order: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        def chosen(wanted: bool) -> Iterator[bytes]:  # read again for each use: a block's texts are never there at once
            return (t for _, texts, flags in _texts(group.column("blob")) for t, f in zip(texts, flags) if bool(f) == wanted)

        words: Counter = Counter()
        for t in chosen(True):
            words.update(t.split())
        for t in chosen(False):
            words.update(dict.fromkeys(t.split(), 0))
        names = sorted(words)
        often = np.fromiter((words[w] for w in names), np.int64, len(names))
        del words
        keys, counts = distinct(chosen(True), order)
        asked = distinct(chosen(False), order)[0]
        keys, counts = summed(np.concatenate((keys, asked)), np.concatenate((counts, np.zeros(len(asked), np.int64))))
        place = np.concatenate((np.arange(len(keys), dtype=np.int32), np.arange(len(names), dtype=np.int32)))
        gram = pa.chunked_array([pa.array(keys), pa.nulls(len(names), pa.int64())]).combine_chunks()
        word = pa.chunked_array([pa.nulls(len(keys), pa.binary()), pa.array(names, pa.binary())]).combine_chunks()
        block = np.full(len(place), key[0].as_py(), np.int32)
        return pa.table([pa.array(block), pa.array(place), gram, word, pa.array(np.concatenate((counts, often)))], schema=COUNTS)

    return run


def _pack_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values for each block as compressed Arrow, of many rows at a time."""
    how = pa.ipc.IpcWriteOptions(compression="zstd")

    def packed_rows(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        table, ends = table.select(VALUES.names).take(pa.array(order)), np.flatnonzero(np.diff(block[order], append=-1)) + 1
        out_blocks, blobs, at = [], [], 0
        for end in ends.tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, VALUES, options=how) as stream:
                stream.write_table(table.slice(at, end - at).cast(VALUES))
            out_blocks.append(int(block[order[at]]))
            blobs.append(sink.getvalue().to_pybytes())
            at = end
        return pa.RecordBatch.from_arrays([pa.array(out_blocks, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])

    rows, size = [], 0
    for b in batches:
        rows.append(b)
        size += len(b)
        if size >= FLUSH:
            yield packed_rows(rows)
            rows, size = [], 0
    if size:
        yield packed_rows(rows)


class Level:
    """One level of the trie: counts of (context, symbol), and what each context has in total."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        contexts = keys >> 8
        first = np.flatnonzero(np.diff(contexts, prepend=-1)) if len(keys) else np.zeros(0, int)
        self.first, self.contexts = first, contexts[first]
        self.totals = np.add.reduceat(counts, first) if len(keys) else counts
        self.kinds = np.diff(first, append=len(keys))

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _look_up(self.keys, self.counts, keys)

    def ruled_out(self, shorter: Level, mask: int) -> np.ndarray:
        """For each context, how often its symbols followed the next shorter context."""
        n = shorter.count(self.keys & mask)
        return np.add.reduceat(n, self.first) if len(n) else n


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def low_levels(keys: np.ndarray, counts: np.ndarray) -> tuple[Level, Level]:
    """Levels 1 and 0 from counts of pairs (last byte, symbol)."""
    return Level(*summed(keys, counts)), Level(*summed(keys & 0xFF, counts))


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int, low: tuple[Level, Level]) -> np.ndarray:
    """log10 probability of the symbol of each distinct gram in its context; grams of count 0 were not trained.

    ``grams`` must hold all trained grams that share the last two context bytes with any of them.
    """
    levels = [low[1], low[0]]
    seen = counts > 0
    for k in range(2, order + 1):
        levels.append(Level(*summed(grams[seen] & ((1 << 8 * (k + 1)) - 1), counts[seen])))
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    gone, kinds_gone = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        level = levels[k]
        key = grams[left] & ((1 << 8 * (k + 1)) - 1)
        n = level.count(key)
        total = _look_up(level.contexts, level.totals, key >> 8) - gone
        kinds_here = _look_up(level.contexts, level.kinds, key >> 8)
        new = kinds_here - kinds_gone  # followers that were not ruled out
        hit = n > 0
        out[left[hit]] += np.log10((2 * n[hit] - 1) / (2 * total[hit]))
        escape = ~hit & (new > 0)
        out[left[escape]] += np.log10(new[escape] / (2 * total[escape]))
        if k:
            out_of = level.ruled_out(levels[k - 1], (1 << 8 * k) - 1)
            gone = _look_up(level.contexts, out_of, key >> 8)[~hit]
        kinds_gone = kinds_here[~hit]
        left = left[~hit]
    out[left] -= np.log10(256 - kinds_gone)
    return out


def _resolve(order: int, low: tuple[Level, Level]):
    def run(group: pa.Table) -> pa.Table:
        grams, counts = group.column("k").to_numpy(), group.column("total").to_numpy()
        return pa.table([pa.array(grams), pa.array(log_probabilities(grams, counts, order, low))], names=["k", "value"])

    return run


def _score_block(order: int, id_type: pa.DataType, ends: int):
    schema = pa.schema([
        ("doc_id", id_type), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("score", pa.float64()), ("new", pa.int64()),
    ])

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        def every() -> Iterator[bytes]:  # read again for each use, as in _count_block
            return (t for _, texts, _ in _texts(docs.column("blob")) for t in texts)

        seen: set[bytes] = set()
        for t in every():
            seen.update(t.split())
        names = sorted(seen)
        del seen
        keys = distinct(every(), order)[0]
        logs, often = np.empty(len(keys)), np.empty(len(names))
        for values in unpacked(back.column("blob")):
            is_word = values.column("is_word").to_numpy(zero_copy_only=False)
            place, value = values.column("place").to_numpy(), values.column("value").to_numpy()
            often[place[is_word]] = value[is_word]
            logs[place[~is_word]] = value[~is_word]
        # what the block saw first anywhere is marked by a half, and counted here
        new = int((often % 1 == 0.5).sum())
        often = np.floor(often)
        words = dict(zip(names, np.log10(often + 0.5).tolist()))
        unknown, end = float(np.log10(0.5)), float(np.log10(ends + 0.5))
        out = []
        for ids, texts, flags in _texts(docs.column("blob")):
            n_tokens, n_known, known, scores = [], [], [], []
            for t in texts:
                found = list(map(words.__getitem__, t.split()))
                n_tokens.append(len(found) + 1)
                n_known.append(len(found) - found.count(unknown) + (ends > 0))
                known.append(sum(found) + end)
            for some in chunks(texts):
                key, begins = grams_of(some, order)
                scores.append(np.add.reduceat(looked_up(keys, logs, key), begins))
            marks = np.zeros(len(texts), np.int64)
            if len(marks):
                marks[0], new = new, 0
            out.append(pa.table([
                ids, pa.array(flags, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(known, pa.float64()),
                pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(marks),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score(docs: DataFrame, train: Column, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``train`` says which rows to learn from; those rows are scored by the same model.
    """
    if not 2 <= order <= 6:
        raise ValueError("the order must lie between 2 and 6")
    rows = docs.select("doc_id", text_bytes(docs).alias("text"), train.alias("train"))
    small_batches(docs.sparkSession)
    learned = rows.where("train").select("text")
    pairs = learned.mapInArrow(lean_batches(_pairs), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # 65,537 rows at most
    words = int(pairs["n"][pairs["pair"] == TOKENS].sum())
    pairs = pairs[pairs["pair"] != TOKENS]
    low = low_levels(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))
    ends = int(pairs["n"][pairs["pair"] % 256 == END].sum())  # every training text ends once
    tokens = words + ends

    n = blocks_for(rows, F.octet_length("text") + 1, block)
    blocks = packed(rows, F.xxhash64("doc_id", "text"), n).repartition(n, "block")
    counted = blocks.groupBy("block").applyInArrow(lean_keyed(_count_block(order)), "block int, place int, gram long, word binary, n long")
    # grams are keys themselves; words have negative ones, and are told apart by what they are
    key = F.coalesce("gram", F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63))))
    keyed = counted.select("block", "place", key.alias("k"), "word", "n").repartition("k")
    same = Window.partitionBy("k", "word")
    asker = F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")
    summed_up = (
        keyed.withColumn("total", F.sum("n").over(same)).withColumn("first", F.min(asker).over(same) == asker)
        .withColumn("is_gram", F.max(F.col("k")).over(same) >= 0)
    )
    branch = F.shiftright("k", 8).bitwiseAND(0xFFFF).alias("branch")
    resolved = summed_up.where("first and is_gram").select("k", "total").groupBy(branch).applyInArrow(lean_group(_resolve(order, low)), "k long, value double")
    # a half on top marks the first of a trained word's rows
    of_word = F.col("total") + F.when(F.col("first") & (F.col("total") > 0), 0.5).otherwise(0.0)
    values = summed_up.join(resolved, "k", "left").select("block", (~F.col("is_gram")).alias("is_word"), "place", F.when(F.col("is_gram"), F.col("value")).otherwise(of_word).alias("value"))
    back = values.mapInArrow(lean_batches(_pack_values), "block int, blob binary")

    id_kind = docs.schema["doc_id"].dataType
    out = f"doc_id {id_kind.simpleString()}, train boolean, n_tokens long, n_known long, known double, score double, new long"
    scored = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lean_pair(_score_block(order, to_arrow_type(id_kind), ends)), out)
    scored = written(scored, "ppm-scores")  # a few numbers for each document
    kinds = (scored.agg(F.sum("new")).first()[0] or 0) + (ends > 0)
    scale = F.log10(F.lit(tokens + 0.5 * (kinds + 1)))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * scale).alias("base_score"), "score",
    )
