"""Shared helpers: batches, scratch tables, blocks of documents, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkblot.session import scratch_dir

# White space is the six ASCII characters only, for Spark's patterns as for bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound the Arrow batches that Python gets by bytes: texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return freed memory to the system. Workers live on from stage to stage, each with a peak of its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean_group(work):
    """``work`` over a group; what it needed is given back when it is done. The next ones are alike."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        give_back()
        return out

    return run


def lean_keyed(work):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = work(key, group)
        give_back()
        return out

    return run


def lean_pair(work):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return run


def lean_keyed_pair(work):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(key, left, right)
        give_back()
        return out

    return run


def lean_batches(work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever columns its user added."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# Spark then removes the shuffle files of a query when it ends, and not when the driver's memory is next cleaned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tasks_for(docs: DataFrame) -> int:
    """In how many tasks, and files, to write a table made from ``docs`` that is smaller: as many as read it, or cores.

    They grow with the input. Where shuffle partitions are many more, most files would hold next to nothing.
    """
    return max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())


def written(df: DataFrame, purpose: str, tasks: int | None = None) -> DataFrame:
    """Write to the shared scratch folder, by ``tasks`` tasks at most, and read back: cuts lineage, survives lost executors.

    What the write shuffled goes with its end, since the next step reads the table: steps do not add up on disk.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(tasks) if tasks else df).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit("")).cast("binary")


def concat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all bytes, and the offsets of the texts in it (one more than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def mixed64(h: np.ndarray) -> np.ndarray:
    """A finalizer with good avalanche, in place, over uint64."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def blocks_for(df: DataFrame, size: Column, target: int) -> int:
    """How many blocks of about ``target`` bytes hold the rows; one small aggregate over the table."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // target))


FEW = 1 << 16  # so many edges are a few MB: tasks cost more than the work on them


def components(edges: DataFrame, max_rounds: int = 60, tasks: int | None = None) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node on an edge (``a``, ``b``: long).

    Alternating large-star and small-star rounds: each node hangs its larger neighbours, then all its
    smaller ones, on its smallest. Only edges are shuffled; each round is cut off by a checkpoint. It
    stops when a round changes nothing, which takes about the logarithm of the longest path.

    At most ``FEW`` edges are worked on in one partition, without shuffles; rounds never add edges.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "components"))
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "components-edges", tasks)
    print_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = pairs.agg(F.count("*"), print_of).first()
    few = before[0] <= FEW
    one = (lambda df: df.coalesce(1)) if few else (lambda df: df)  # said each time: checkpoints and unions do not tell
    for _ in range(max_rounds):
        if not before[0]:
            break
        pairs = one(pairs)
        both = one(pairs.union(pairs.select("b", "a")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = one(large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b"))))
        pairs = small.where("a <> b").distinct().checkpoint()
        after = pairs.agg(F.count("*"), print_of).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = one(pairs).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())


def packed(docs: DataFrame, key: Column, blocks: int) -> DataFrame:
    """The rows of ``docs`` dealt to ``blocks`` blocks by ``key``: ``block``, ``blob``.

    A blob holds the rows of one batch that go to one block, as compressed Arrow; texts are shuffled at
    about a third of their size, and a block arrives as a few rows.
    """
    small_batches(docs.sparkSession)
    names = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            block = b.column(len(names)).to_numpy()
            order = np.argsort(block, kind="stable")
            rows = pa.record_batch(b.columns[:-1], names=names).take(pa.array(order))
            ends = np.flatnonzero(np.diff(block[order], append=-1)) + 1
            out_blocks, blobs, at = [], [], 0
            for end in ends.tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=how) as stream:
                    stream.write_batch(rows.slice(at, end - at))
                out_blocks.append(int(block[order[at]]))
                blobs.append(sink.getvalue().to_pybytes())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(out_blocks, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])

    dealt = docs.select(*(docs[c] for c in names), F.pmod(key, F.lit(blocks)).cast("int").alias(fresh(docs, "_block")))
    return dealt.mapInArrow(lean_batches(pack), "block int, blob binary")


def unpacked(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as stream:
            yield stream.read_all()
