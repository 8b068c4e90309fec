"""Suffix-array deduplication of bytes, by a distributed merge sort that knows common prefixes.

A byte is removed if it lies in a string of 100 bytes that also starts earlier (smaller doc_id, or the
same document further left); strings overlap, and are judged on the input.

* Any 100 bytes hold an anchor: the 40 bytes whose hash is the least of the 61 there. Equal strings
  have their anchors at equal places, so it is enough to sort the suffixes that begin at anchors, about
  one in thirty, and of those only the ones whose 40 bytes occur again somewhere.
* Each block of documents sorts its suffixes into a run and front-codes it: for each suffix the length
  of the prefix it shares with the one before, and the rest. Suffixes that are the same in all the bytes
  around them are sent once; the later ones are known to be removed already.
* Runs are exchanged by the hash of the anchor and merged by a loser tree which carries the known common
  prefixes along: a prefix that was compared once, in the block or in the tree, is never compared again.
* The merged order comes with its common prefixes, which show where groups of equal anchors begin and
  end. In a group, the strings of 100 bytes that hold the anchor are matched at each of the 61 offsets;
  the first, by document and place, stays. What was found goes back to the documents' blocks.
* An anchor that thousands of blocks have could gather more suffixes than a task should hold. Its strings of
  100 bytes are dealt out one by one instead, each by its own hash, once for each block that has it.

Null texts count as empty. Rows of one doc_id are documents of their own, in the order of the table;
rows without doc_id come first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from inkblot.llm.common import blocks_for, concat_bytes, lean_keyed, lean_keyed_pair, lean_pair, mixed64, packed, text_bytes, unpacked

LENGTH, ANCHOR = 100, 40
SPAN = LENGTH - ANCHOR + 1  # places of an anchor in a string
LEFT = SPAN - 1  # bytes before an anchor that matter
WIDTH = LEFT + LENGTH
BLOCK, PIECE = 16 << 20, 1 << 20
SLICE = 1 << 14  # anchors whose surroundings are held at a time
HOT = 2_000  # an anchor counts once or twice for each block that has it
BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


class Hasher:
    """Hashes of all strings of a given length in a piece of bytes, by one running sum."""

    def __init__(self, n: int):
        self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=out[1:])
        return out

    def strings(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mixed64((sums[length:] - sums[:n]) * self.down[:n])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about a piece: data, and for each part of a text in it its begin, its text's number, its place there.

    Longer texts are cut into parts that overlap so that each string of 100 bytes lies in one part.
    """
    some: list[tuple[bytes, int, int]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                some.append((part, number, at))
                size += len(part)
                if size >= PIECE:
                    yield _joined(some)
                    some, size = [], 0
    if some:
        yield _joined(some)


def _joined(some: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, ends = concat_bytes([p for p, _, _ in some])
    return data, ends, np.array([n for _, n, _ in some]), np.array([a for _, _, a in some])


def anchors(texts: list[bytes], hasher: Hasher | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, place and hash of the anchors; those of overlapping parts may come twice."""
    hasher = hasher or Hasher(2 * PIECE + 2 * LENGTH)
    for data, ends, numbers, places in _pieces(texts):
        h = hasher.strings(hasher.sums(data), ANCHOR)
        short = (h >> np.uint64(32)).astype(np.uint32)
        least = _sliding(short, SPAN, np.minimum)
        for end in ends[1:-1].tolist():  # strings across two texts have no anchor
            least[max(0, end - LENGTH + 1) : end] = 0
        wide = np.zeros(len(least) + 2 * LEFT, np.uint32)
        wide[LEFT : LEFT + len(least)] = least
        at = np.flatnonzero(_sliding(wide, SPAN, np.maximum) == short)
        part = np.searchsorted(ends, at, side="right") - 1
        yield numbers[part], at - ends[part] + places[part], h[at]


def _block_texts(blobs: pa.ChunkedArray) -> tuple[list, list[int], list[bytes]]:
    ids, rows, texts = [], [], []
    for table in unpacked(blobs):
        ids += table.column("doc_id").to_pylist()
        rows += table.column("row").to_pylist()
        texts += table.column("text").to_pylist()
    return ids, rows, texts


def _anchor_rows(key: tuple, group: pa.Table) -> pa.Table:
    """The distinct anchors of a block; ``tag`` is twice the block, plus one if it occurs there again."""
    _, _, texts = _block_texts(group.column("blob"))
    found = [h for _, _, h in anchors(texts)]
    h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return pa.table([pa.array(h.view(np.int64)), pa.array((2 * key[0].as_py() + (n > 1)).astype(np.int32))], names=["h", "tag"])


RUN = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
ITEMS = pa.schema([
    ("shared", pa.uint8()), ("rest", pa.binary()), ("left", pa.binary()), ("size", pa.uint8()), ("doc", pa.int64()), ("row", pa.int64()),
    ("pos", pa.int64()), ("block", pa.int32()),
])
SPANS = pa.schema([("row", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unblob(blob) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()


def surroundings(texts: list[bytes], number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor the bytes around it (zero where the text has none), and how many there are left and right."""
    data, ends = concat_bytes([bytes(LEFT), *texts, bytes(LENGTH)])
    sizes = np.diff(ends)[number + 1]
    left, right = np.minimum(place, LEFT), np.minimum(sizes - place, LENGTH)
    out = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[ends[number + 1] + place - LEFT]
    column = np.arange(-LEFT, LENGTH, dtype=np.int16)
    inside = (column >= -left[:, None].astype(np.int16)) & (column < right[:, None].astype(np.int16))
    out[~inside] = 0
    return out, left, right


def _first_of_rows(rows: np.ndarray) -> np.ndarray:
    """Which rows of bytes are the first of their kind."""
    once = np.zeros(len(rows), bool)
    once[np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True)[1]] = True
    return once


def distinct_surroundings(texts: list[bytes], row: np.ndarray, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of anchors in order, those whose surroundings come first (as indices), with these, and the spans of the others.

    Anchors are worked through in slices: in long runs of a byte, or of a short period, every place is one.
    """
    kept, spans = [], [np.zeros((3, 0), np.int64)]

    def removed(which: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        low = np.maximum(0, LENGTH - right)
        good = low <= left
        p = place[which]
        spans.append(_united(np.stack((row[number[which]], p - left, p - low + LENGTH))[:, good]))

    for at in range(0, len(number), SLICE):
        some = np.arange(at, min(at + SLICE, len(number)))
        around, left, right = surroundings_of(texts, number[some], place[some])
        whole = np.concatenate((around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)), axis=1)
        once = _first_of_rows(whole)
        removed(some[~once], left[~once], right[~once])
        kept.append((some[once], whole[once]))
    some, whole = (np.concatenate(c) for c in zip(*kept))
    if len(kept) > 1:
        once = _first_of_rows(whole)
        removed(some[~once], whole[~once, WIDTH].astype(np.int64), whole[~once, WIDTH + 1].astype(np.int64))
        some, whole = some[once], whole[once]
    left, right = whole[:, WIDTH].astype(np.int64), whole[:, WIDTH + 1].astype(np.int64)
    return some, whole[:, :WIDTH], left, right, _united(np.concatenate(spans, axis=1))


def _united(spans: np.ndarray) -> np.ndarray:
    """Spans (row, begin, end) of each row as maximal intervals."""
    if not spans.shape[1]:
        return spans
    rows, rank = np.unique(spans[0], return_inverse=True)
    apart = int(spans[2].max()) + 1  # more than any end, so that rows do not touch
    begin, end = (np.array(x, np.int64) for x in union(spans[1] + rank * apart, spans[2] + rank * apart))
    rank = begin // apart
    return np.stack((rows[rank], begin - rank * apart, end - rank * apart))


def _runs(buckets: int):
    def run(key: tuple, docs: pa.Table, again: pa.Table) -> pa.Table:
        if not len(docs) or not len(again):
            return RUN.empty_table()
        block = key[0].as_py()
        ids, rows, texts = _block_texts(docs.column("blob"))
        wanted = again.column("h").to_numpy().view(np.uint64)
        by_hash = np.argsort(wanted)
        wanted, often = wanted[by_hash], again.column("hot").to_numpy(zero_copy_only=False)[by_hash]
        parts = []
        for number, place, h in anchors(texts):
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[at] == h
            parts.append((number[hit], place[hit], h[hit], often[at[hit]]))
        number, place, h, hot = (np.concatenate(p) for p in zip(*parts))
        doc = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        row = np.array(rows, np.int64)
        out_buckets, blobs = [], []
        order = np.lexsort((place, row[number], doc[number]))  # by document and place: the first of equals comes first
        number, place, h, hot = number[order], place[order], h[order], hot[order]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (place[1:] != place[:-1])
        number, place, h, hot = number[new], place[new], h[new], hot[new]
        if hot.any():
            strings = _strings_of(texts, number[hot], place[hot])
            for to, table in _dealt_strings(strings, doc, row, block, buckets):
                out_buckets.append(to)
                blobs.append(_blob(table))
        number, place, h = number[~hot], place[~hot], h[~hot]
        bucket = (h >> np.uint64(20)) % np.uint64(buckets)
        spans: list[np.ndarray] = []
        turn = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[turn])) + 1
        for some in np.split(turn, cuts):
            if not len(some):
                continue
            first, around, left, right, later = distinct_surroundings(texts, row, number[some], place[some])
            if later.shape[1]:
                spans.append(later)
            some = some[first]
            tail = around[:, LEFT:]
            order = np.lexsort(tuple(_words(tail)))
            some, around, tail, left, right = some[order], around[order], tail[order], left[order], right[order]
            shared = np.zeros(len(some), np.int64)
            if len(some) > 1:
                differ = tail[1:] != tail[:-1]
                shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
            rest = [t[s:].tobytes() for t, s in zip(tail, shared.tolist())]
            before = [a[LEFT - n : LEFT].tobytes() for a, n in zip(around, left.tolist())]
            table = pa.table([
                pa.array(shared, pa.uint8()), pa.array(rest, pa.binary()), pa.array(before, pa.binary()), pa.array(right, pa.uint8()),
                pa.array(doc[number[some]]), pa.array(row[number[some]]), pa.array(place[some]), pa.array(np.full(len(some), block, np.int32)),
            ], schema=ITEMS)
            out_buckets.append(int(bucket[some[0]]))
            blobs.append(_blob(table))
        if spans:
            table = pa.table(list(np.concatenate(spans, axis=1)), schema=SPANS).append_column("block", pa.array(np.full(sum(s.shape[1] for s in spans), block, np.int32)))
            out_buckets.append(block % buckets)
            blobs.append(_blob(table))
        return pa.table([pa.array(out_buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=RUN)

    return run


STRINGS = pa.schema([("string", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("begin", pa.int64()), ("block", pa.int32())])


def _strings_of(texts: list[bytes], number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and begin of every string of 100 bytes that holds one of the anchors, each string once."""
    parts = [_strings_of_slice(texts, number[at : at + SLICE], place[at : at + SLICE]) for at in range(0, len(number), SLICE)]
    return _each_once(*(np.concatenate(c) for c in zip(*parts)))


def _each_once(h: np.ndarray, number: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((begin, number))
    h, number, begin = h[order], number[order], begin[order]
    new = np.ones(len(h), bool)
    new[1:] = (number[1:] != number[:-1]) | (begin[1:] != begin[:-1])
    return h[new], number[new], begin[new]


def _strings_of_slice(texts: list[bytes], number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    around, left, right = surroundings_of(texts, number, place)
    hasher = Hasher(WIDTH + 1)
    sums = np.zeros((len(number), WIDTH + 1), np.uint64)
    np.cumsum(_BYTES[around] * hasher.up[:WIDTH], axis=1, out=sums[:, 1:])
    out = []
    for o in range(SPAN):
        fits = np.flatnonzero((o <= left) & (LENGTH - o <= right))
        at = LEFT - o
        out.append((mixed64((sums[fits, at + LENGTH] - sums[fits, at]) * hasher.down[at]), number[fits], place[fits] - o))
    return _each_once(*(np.concatenate(c) for c in zip(*out)))


def _dealt_strings(strings: tuple[np.ndarray, ...], doc: np.ndarray, row: np.ndarray, block: int, buckets: int) -> Iterator[tuple[int, pa.Table]]:
    """The first of each string in a block goes to the bucket of its hash; the others are removed already."""
    h, number, begin = strings
    order = np.lexsort((begin, row[number], doc[number]))
    h, number, begin = h[order], number[order], begin[order]
    once = np.zeros(len(h), bool)
    once[np.unique(h, return_index=True)[1]] = True
    if not once.all():
        b = begin[~once]
        table = pa.table([row[number[~once]], b, b + LENGTH], schema=SPANS)
        yield block % buckets, table.append_column("block", pa.array(np.full(len(b), block, np.int32)))
    h, number, begin = h[once], number[once], begin[once]
    to = (h >> np.uint64(20)) % np.uint64(buckets)
    turn = np.argsort(to, kind="stable")
    for some in np.split(turn, np.flatnonzero(np.diff(to[turn])) + 1):
        if len(some):
            n = number[some]
            columns = [h[some].view(np.int64), doc[n], row[n], begin[some], np.full(len(some), block, np.int32)]
            yield int(to[some[0]]), pa.table([pa.array(c) for c in columns], schema=STRINGS)


def _words(tail: np.ndarray) -> list[np.ndarray]:
    """Sort keys of rows of bytes, the last first: eight bytes at a time as numbers."""
    padded = np.zeros((len(tail), -(-tail.shape[1] // 8) * 8), np.uint8)
    padded[:, : tail.shape[1]] = tail
    return list(padded.view(">u8").astype(np.uint64).T[::-1])


def surroundings_of(texts: list[bytes], number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``surroundings``, over those texts only that have an anchor."""
    used, where = np.unique(number, return_inverse=True)
    return surroundings([texts[i] for i in used.tolist()], where, place)


def _common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    while at + 8 <= n and a[at : at + 8] == b[at : at + 8]:
        at += 8
    while at < n and a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge front-coded runs; yields run, index in the run, and the prefix shared with what came before.

    A loser tree. ``known[r]`` is the prefix that run r's string shares with the string that beat it
    last, which is not greater; of two strings beaten by the same one, the one that shares more with it
    is the smaller, and only equal numbers make a comparison, which starts behind them.
    """
    k = 1
    while k < len(runs):
        k *= 2
    now: list[bytes | None] = [None] * k
    known, place = [0] * k, [0] * k
    for r, (_, rest) in enumerate(runs):
        now[r] = rest[0] if rest else None
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = _common(x, y, known[a])
        if at == len(x) or (at < len(y) and x[at] < y[at]):
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1) if k > 1 else 0
    while now[best] is not None:
        yield best, place[best], known[best]
        shared, rest = runs[best]
        place[best] += 1
        at = place[best]
        if at < len(rest):
            now[best] = now[best][: shared[at]] + rest[at]
            known[best] = shared[at]
        else:
            now[best] = None
        node = (best + k) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    """Merge the runs of a bucket and find the spans that occur earlier; a row of spans for each block."""
    spans, tables, strings = [], [], []
    for blob in group.column("blob"):
        table = _unblob(blob.as_buffer())
        (tables if "shared" in table.column_names else strings if "string" in table.column_names else spans).append(table)
    found = [(t.column("block").to_numpy(), t.column("row").to_numpy(), t.column("begin").to_numpy(), t.column("end").to_numpy()) for t in spans]
    if strings:
        h, doc, row, begin, block = (c.to_numpy() for c in pa.concat_tables(strings).columns)
        order = np.lexsort((begin, row, doc, h))
        again = np.flatnonzero(h[order][1:] == h[order][:-1]) + 1
        which = order[again]
        found.append((block[which].astype(np.int64), row[which], begin[which], begin[which] + LENGTH))
    if tables:
        runs = [(t.column("shared").to_pylist(), t.column("rest").to_pylist()) for t in tables]
        begins = np.cumsum([0, *(len(t) for t in tables)])
        order = np.array([(begins[r] + i, n) for r, i, n in merge(runs)], np.int64).reshape(-1, 2)
        items = pa.concat_tables(tables)
        found.append(spans_of(items, runs, order[:, 0], order[:, 1]))
    block, row, begin, end = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    turn = np.argsort(block, kind="stable")
    out_blocks, blobs = [], []
    for some in np.split(turn, np.flatnonzero(np.diff(block[turn])) + 1) if len(turn) else []:
        out_blocks.append(int(block[some[0]]))
        blobs.append(_blob(pa.table([pa.array(row[some]), pa.array(begin[some]), pa.array(end[some])], schema=SPANS)))
    return pa.table([pa.array(out_blocks, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def spans_of(items: pa.Table, runs: list, order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks, rows, begins and ends of what occurs earlier, of items in merged order with shared prefixes."""
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(shared < ANCHOR)
    size = np.bincount(group)[group]
    doc, row, pos = (items.column(c).to_numpy() for c in ("doc", "row", "pos"))
    use = np.flatnonzero(size > 1)
    use = use[np.lexsort((pos[use], row[use], doc[use]))]
    if not len(use):
        return (np.zeros(0, np.int64),) * 4
    right = items.column("size").to_numpy()[use].astype(np.int64)
    lefts = items.column("left").take(pa.array(use)).to_pylist()
    left = np.array([len(x) for x in lefts], np.int64)
    tails = _strings(runs)
    around = np.frombuffer(b"".join(x.rjust(LEFT, b"\0") + tails[i] for x, i in zip(lefts, use.tolist())), np.uint8).reshape(-1, WIDTH)
    hasher = Hasher(WIDTH + 1)
    sums = np.zeros((len(use), WIDTH + 1), np.uint64)
    np.cumsum(_BYTES[around] * hasher.up[:WIDTH], axis=1, out=sums[:, 1:])
    salt = mixed64(group[use].astype(np.uint64) * np.uint64(BASE))
    low, high = np.full(len(use), SPAN), np.full(len(use), -1)
    for o in range(SPAN):
        fits = np.flatnonzero((o <= left) & (LENGTH - o <= right))
        if len(fits) < 2:
            continue
        at = LEFT - o
        h = mixed64((sums[fits, at + LENGTH] - sums[fits, at]) * hasher.down[at]) ^ salt[fits]
        first = np.zeros(len(fits), bool)
        first[np.unique(h, return_index=True)[1]] = True
        again = fits[~first]
        low[again] = np.minimum(low[again], o)
        high[again] = o
    hit = np.flatnonzero(high >= 0)
    which = use[hit]
    return items.column("block").to_numpy()[which].astype(np.int64), row[which], pos[which] - high[hit], pos[which] - low[hit] + LENGTH


def _strings(runs: list) -> list[bytes]:
    """All strings of front-coded runs, run after run."""
    out = []
    for shared, rest in runs:
        last = b""
        for n, tail in zip(shared, rest):
            last = last[:n] + tail
            out.append(last)
    return out


def union(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal intervals covered by the given ones."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()


def whole_characters(text: bytes, begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The given spans without the characters that they hold in part only."""
    out = []
    for b, e in zip(begins, ends):
        while b < e and text[b] & 0xC0 == 0x80:
            b += 1
        while b < e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        out.append((b, e))
    return out


def _cut(schema: pa.Schema):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        tables = list(unpacked(docs.column("blob")))
        found = pa.concat_tables([_unblob(b.as_buffer()) for b in spans.column("blob")] or [SPANS.empty_table()])
        row, begin, end = (found.column(c).to_numpy() for c in SPANS.names)
        order = np.argsort(row, kind="stable")
        row, begin, end = row[order], begin[order], end[order]
        out = []
        for table in tables:
            rows, texts = table.column("row").to_numpy(), table.column("text").to_pylist()
            firsts, lasts = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
            all_begins, all_ends, kept, chars = [], [], [], []
            for text, a, b in zip(texts, firsts.tolist(), lasts.tolist()):
                begins, ends = union(begin[a:b], end[a:b]) if a < b else ([], [])
                all_begins.append(begins)
                all_ends.append(ends)
                kept.append(b"".join([text[x:y] for x, y in zip([0, *ends], [*begins, len(text)])]) if begins else text)
                at, parts = 0, []
                for b, e in whole_characters(text, begins, ends):
                    parts.append(text[at:b])
                    at = e
                chars.append((b"".join(parts) + text[at:]).decode("utf-8", "replace") if begins else None)
            made = {"n_bytes": [len(t) for t in texts], "begins": all_begins, "ends": all_ends, "kept": kept, "kept_text": chars}
            out.append(pa.table([pa.array(made[f.name], f.type) if f.name in made else table.column(f.name).cast(f.type) for f in schema], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def repeats(docs: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, row, n_bytes, the begins and ends of what is removed, and what is kept, of every document.

    ``kept`` holds the bytes that stay; ``kept_text``, null where nothing is removed, those and the
    characters that would be cut in two. ``extra`` holds the columns to ``carry``; ``row`` tells rows of the
    table apart. The blocks of texts are read three times in one plan, from one exchange.
    """
    extra = F.struct(*(docs[c] for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_bytes(docs).alias("text"), extra.alias("extra"))
    n = blocks_for(rows, F.octet_length("text") + 1, block)
    blocks = packed(rows, F.xxhash64("doc_id", "row"), n).repartition(n, "block")
    found = blocks.groupBy("block").applyInArrow(lean_keyed(_anchor_rows), "h long, tag int")
    times = F.sum((F.col("tag") % 2) + 1).over(Window.partitionBy("h"))
    again = found.withColumn("times", times).where("times > 1").select("h", F.shiftright("tag", 1).alias("block"), (F.col("times") > hot).alias("hot"))
    # more buckets than blocks, so that what a task merges at a time is a part of a block's size
    runs = blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(lean_keyed_pair(_runs(4 * n)), "bucket int, blob binary")
    spans = runs.groupBy("bucket").applyInArrow(lean_keyed(_merged), "block int, blob binary")
    out = StructType(rows.select("doc_id", "row").schema.fields).add("n_bytes", "long").add("begins", ArrayType(LongType())).add("ends", ArrayType(LongType()))
    out = out.add("kept", "binary").add("kept_text", "string").add("extra", rows.schema["extra"].dataType)
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lean_pair(_cut(to_arrow_schema(out))), out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = repeats(docs)
    removed = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeats cut out of their texts; rows that lose all are left out."""
    others = tuple(c for c in docs.columns if c != "text")
    out = repeats(docs.withColumn("text", docs["text"]), carry=others)
    same = F.when(F.col("kept_text").isNull(), F.col("kept").cast("string")).otherwise(F.col("kept_text"))
    left = out.where("n_bytes = 0 or kept_text is null or kept_text <> ''")
    return left.select(*(same.alias("text") if c == "text" else F.col("extra")[c].alias(c) for c in docs.columns))
