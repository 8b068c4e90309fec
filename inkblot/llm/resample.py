"""Importance resampling towards a target distribution of hashed word n-grams.

Each word run of one to three words falls into one of 10,000 buckets, by the crc32 of its bytes. How much
more often the target texts hit a bucket than the corpus does is the bucket's gain; a document's weight is
the sum of the gains of its runs, and a draw of seeded Gumbel noise turns weights into scores, the highest
of which are drawn.

The work is done by batch: the texts of a batch are joined with a separator that no word holds, one regex
pass finds the words of all of them, and a search of their places in the documents' offsets says which runs
would cross from one document to the next; those are left out. The crc32 of a run follows from those of its
words, since appending is linear over bits, so runs are never spelled out.

Counts are over all documents and all target texts: each task adds up one count for each bucket, and at
most 10,000 sums reach the driver. Ranks are global, but no task holds all rows: scores are dealt out by
range, numbered within their part, and moved on by the sizes of the parts before.

Null and empty texts have no words: no runs, weight 0, never drawn. A text of any length is worked through
in slices. Repeated rows count and are scored as often as they occur; equal scores go to the smaller doc_id;
a null doc_id draws its noise from the empty text and comes last among equals. Empty corpora give an
empty result, and an empty target makes every bucket's gain the same but for its count in the corpus. Other
columns are not read by :func:`scores` and stay untouched in :func:`drawn`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import fresh, lean_batches, small_batches, text_bytes, written

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, "42"
SLICE = 4 << 20

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
SEPARATOR = b"\n"
NEAR = 64  # shifts by fewer bytes than this have a table of their own


@lru_cache(maxsize=1)
def _byte_step() -> np.ndarray:
    """What eight shifts of the register make of its last byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each value of each byte."""
    out = tables[0][crc & 255]
    for i in (1, 2, 3):
        out ^= tables[i][(crc >> np.uint32(8 * i)) & 255]
    return out


@lru_cache(maxsize=1)
def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of a crc past 0 to 63 further bytes, and past 64, 128, 256 ... bytes."""
    step = _byte_step()
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = [table]
    for _ in range(NEAR):
        table = (table >> np.uint32(8)) ^ step[table & 255]
        near.append(table)
    far = [near.pop()]
    for _ in range(24):
        far.append(_through(far[-1], far[-1].ravel()).reshape(4, 256))
    return np.stack(near), far


def joined_crc(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of texts put together from two, of which the right ones have these sizes."""
    near, far = _shift_tables()
    rest = sizes & (NEAR - 1)
    out = near[rest, 0, left & 255]
    for i in (1, 2, 3):
        out ^= near[rest, i, (left >> np.uint32(8 * i)) & 255]
    blocks = sizes >> 6
    for k in range(int(blocks.max(initial=0)).bit_length()):
        there = np.flatnonzero((blocks >> k) & 1)
        out[there] = _through(far[k], out[there])
    return out ^ right


def spaced_crc(crc: np.ndarray) -> np.ndarray:
    """The crc32 of the same texts with one blank appended."""
    c = ~crc
    return ~((c >> np.uint32(8)) ^ _byte_step()[(c ^ np.uint32(0x20)) & 255])


def slices(blob: bytes, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(blob):
        cut = BETWEEN.search(blob, min(at + size, len(blob)))
        end = cut.start() if cut else len(blob)
        yield at, end
        at = end


def bucket_runs(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, documents, buckets)`` of the runs of 1, 2 and 3 words of a batch, slice by slice."""
    blob = SEPARATOR.join(texts).translate(ASCII_LOWER)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SEPARATOR)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    tail = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    for low, high in slices(blob):
        spans = np.fromiter(chain.from_iterable(m.span() for m in WORDS.finditer(blob, low, high)), np.int64)
        starts, ends = spans[::2], spans[1::2]
        if not len(starts):
            continue
        crc = np.fromiter((crc32(w) for w in WORDS.findall(blob, low, high)), np.uint32, len(starts))
        # the last words of the slice before, with which runs may begin
        known = len(tail[0])
        starts, lengths, crc = (np.concatenate(pair) for pair in zip(tail, (starts, ends - starts, crc)))
        doc = np.searchsorted(begins, starts, side="right") - 1
        run = crc
        for n in range(1, LONGEST + 1):
            if n > 1:  # one word longer, as far as the words go
                run = joined_crc(spaced_crc(run[:-1]), crc[n - 1 :], lengths[n - 1 :])
            new = max(0, known - n + 1)
            whole = doc[new : len(run)] == doc[new + n - 1 :]
            yield n, doc[new : len(run)][whole], run[new:][whole] % np.uint32(buckets)
        tail = (starts[-(LONGEST - 1) :], lengths[-(LONGEST - 1) :], crc[-(LONGEST - 1) :])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the runs of all ``texts`` (a column ``text``) fall into each bucket."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in bucket_runs(b.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bucket", "often"])

    of_tasks = texts.select(text_bytes(texts).alias("text")).mapInArrow(lean_batches(count), "bucket long, often long")
    summed = of_tasks.groupBy("bucket").agg(F.sum("often").alias("often")).toPandas()  # as many rows as buckets
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["often"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of the smoothed shares, floored."""
    n = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (float(corpus.sum()) + n) / ((s + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every document."""
    small_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    held = gain.astype(float)  # sums of whole numbers below 2 ** 53 are exact

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for size, doc, found in bucket_runs(b.column(1).to_pylist(), len(held)):
                here = np.bincount(doc, minlength=n)
                features += here
                words += here if size == 1 else 0
                total += np.bincount(doc, weights=held[found], minlength=n)
            columns = [b.column(0), pa.array(words), pa.array(features), pa.array(total.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", text_bytes(docs).alias("text")).mapInArrow(lean_batches(weigh), f"doc_id {key}, n_words long, n_features long, weight long")


def noise(key: Column, seed: str) -> Column:
    """A thousandfold Gumbel draw from the hash of seed and key, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the best ``percent`` of the eligible rows, else null."""
    rows = scored.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "resample-order")  # places are given once, whatever is worked out again
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # one row for each part
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    drawn = dealt.agg(F.count_if("_in").alias("_all")).select(F.expr(f"_all * {percent}L div 100L").alias("_drawn"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").join(F.broadcast(drawn))  # a row for each part, and one row
    rank = F.col("_before") + place + 1
    return placed.withColumn("rank", F.when(F.col("_in") & (rank <= F.col("_drawn")), rank)).select(*scored.columns, "rank")


def scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; ``target`` has ``text``."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "resample-scores")  # read twice: dealing out by range takes a sample first
    return ranked(scored, F.col("n_words") >= min_words, percent)


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns."""
    key = fresh(docs, "_drawn")
    ids = scores(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[key]), "left_semi")
