"""N-gram Jaccard join with skipping by set relations.

A document's set holds its distinct 5-word shingles, as 64-bit hashes; two documents link if their sets'
Jaccard similarity is at least 0.8. The join answers with components of linked documents.

* Equal sets are one class; its smallest doc_id stands for it, and its answers hold for all copies.
* Elements are ordered by how many documents have them, by a sketch of fixed size that all documents
  count into, then by hash. Two linked sets share an element among the first ``n - ceil(0.8 n) + 1`` of
  each, so an inverted index of these prefixes has every candidate. Lists of one entry are dropped.
* First, every entry of a list is checked against the list's head only, the smallest doc_id. What links is
  then known to be connected, and a set takes over the answers of the set it was found to be similar to: of
  entries whose components are the same already, no pair is ever made. In lists that still have many
  entries outside their largest component, those are checked against another head, drawn from it by a
  hash; this goes on as long as it finds links.
* Entries of different components are then joined by block: a list falls into blocks of sets of similar
  size, and a set visits the blocks of its own and the two adjacent sizes only; the largest component of
  a list is never joined with itself. Within a block, pairs whose positions leave too few elements
  behind them are skipped.
* Of every candidate pair, the index then tells how many prefix elements the two share and where the last
  of them stand. That bounds their overlap from above; only pairs that may still link are verified on whole sets.

Both steps are exact: no list, set or pair is capped or sampled. Sets are needed for verification only,
and are made again from the texts of candidates, which a bit map of fixed size picks out.

Null and empty texts have an empty set and are linked with nothing. Rows of one doc_id count as one
document; rows without doc_id are returned with a null component. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import components, fresh, lean_batches, small_batches, tasks_for, text_bytes, written

WORDS, PERCENT = 5, 80
SKETCH, BITS = 1 << 18, 1 << 23
DENSE, ROUNDS = 20, 8


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    line = b" ".join(parts)
    hashed = xxhash.xxh3_64_intdigest
    if len(parts) <= words:
        return np.array([hashed(line)], np.uint64).view(np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.unique(np.array([hashed(line[a:b]) for a, b in zip(starts, stops)], np.uint64)).view(np.int64)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its id, size and the print of its set; of each task its share of the sketch."""
    names = ["doc_id", "n", "p1", "p2", "bucket", "often"]
    sketch = np.zeros(SKETCH, np.int64)
    for b in batches:
        sizes, one, two = [], [], []
        for data in b.column(1).to_pylist():
            s = shingles(data)
            sketch += np.bincount(s & (SKETCH - 1), minlength=SKETCH) if len(s) > SKETCH else 0
            if len(s) <= SKETCH:
                np.add.at(sketch, s & (SKETCH - 1), 1)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            sizes.append(len(s))
            one.append(int.from_bytes(digest[:8], "big", signed=True))
            two.append(int.from_bytes(digest[8:], "big", signed=True))
        none = pa.nulls(len(sizes), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), none, pa.nulls(len(sizes), pa.int64())], names=names)
    used = np.flatnonzero(sketch)
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array(sketch[used])], names=names)


def _prefixes(sketch: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for b in batches:
            sizes, lists = [], []
            one, two = [], []
            for data in b.column(1).to_pylist():
                s = shingles(data)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                order = np.lexsort((s, often[s & (SKETCH - 1)]))[: prefix_size(len(s))]
                sizes.append(len(s))
                lists.append(s[order])
                one.append(int.from_bytes(digest[:8], "big", signed=True))
                two.append(int.from_bytes(digest[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "n", "p1", "p2", "prefix"],
            )

    return run


def _compatible(n, m, i, j):
    """Size and position filters for sets of n and m elements that share the ones at places i and j."""
    least = F.ceil(F.lit(float(PERCENT)) * (n + m) / F.lit(100.0 + PERCENT))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (1 + F.least(n - i - 1, m - j - 1) >= least)


def _promising(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose shared prefix elements leave room for a link.

    An element that two sets share but not within both prefixes stands behind the last one that they share
    there, and behind the prefix of one of them. Linked pairs always pass.
    """
    left = index.select(F.col("id").alias("a"), "token", "n", F.col("pos").alias("i"))
    right = index.select(F.col("id").alias("b"), "token", F.col("n").alias("m"), F.col("pos").alias("j"))
    asked = right.join(pairs.select("b").distinct(), "b", "left_semi")  # few pairs need few lists
    seen = pairs.join(left, "a").join(asked, ["b", "token"]).groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"))
    behind = F.greatest(*(F.floor((PERCENT * F.col(size) + 99) / 100) - 1 for size in ("n", "m")))
    more = F.least(behind, F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return seen.where((100 + PERCENT) * (F.col("shared") + more) >= PERCENT * (F.col("n") + F.col("m"))).select("a", "b")


def _verified(docs: DataFrame, index: DataFrame, candidates: DataFrame, tasks: int) -> DataFrame:
    """Of candidate pairs (a, b), those that link, checked on whole sets."""
    pairs = written(_promising(index, candidates), "join-promising", tasks)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    words = ids.groupBy(F.shiftright(bit, 5).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(id), {BITS}) & 31 as int)))").alias("v")).toPandas()
    bitmap = np.zeros(BITS // 32, np.int64)  # its size is fixed; when it fills up, more sets are made than needed
    bitmap[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in batches:
            at = b.column(2).to_numpy()
            rows = np.flatnonzero((asked[at >> 5] >> (at & 31)) & 1)
            some = b.column(1).take(pa.array(rows)).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([shingles(t) for t in some], pa.list_(pa.int64()))], names=["id", "s"])

    rows = docs.select("doc_id", text_bytes(docs).alias("text"), F.pmod(F.xxhash64(F.col("doc_id")), F.lit(BITS)).alias("bit")).where("doc_id is not null")
    made = written(rows.mapInArrow(lean_batches(sets), "id long, s array<long>").join(ids, "id", "left_semi"), "join-sets", tasks)
    left, right = made.toDF("a", "x"), made.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark, tasks = docs.sparkSession, tasks_for(docs)
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.select("doc_id", text_bytes(rows).alias("text"))
    first = written(texts.mapInArrow(lean_batches(_first_pass), "doc_id long, n long, p1 long, p2 long, bucket int, often long"), "join-prints")
    counts = first.where("bucket is not null").groupBy("bucket").agg(F.sum("often").alias("often")).toPandas()  # SKETCH rows at most
    sketch = np.zeros(SKETCH, np.int64)
    sketch[counts["bucket"].to_numpy(np.int64)] = counts["often"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(sketch)

    prefixes = texts.where("doc_id is not null").mapInArrow(lean_batches(_prefixes(shared)), "doc_id long, n long, p1 long, p2 long, prefix array<long>")
    classes = prefixes.where("n > 0").groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    entries = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    of_list = Window.partitionBy("token")
    lists = entries.withColumn("many", F.count("*").over(of_list)).withColumn("head", F.min(F.struct("id", "n", "pos")).over(of_list))
    index = written(lists.where("many > 1").select("token", "id", "n", "pos", "head"), "join-index", tasks)

    with_head = index.where((F.col("id") != F.col("head.id")) & _compatible(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos")))
    tried = written(with_head.select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct(), "join-heads", tasks)
    links = written(_verified(docs, index, tried, tasks), "join-links", tasks)
    known = written(components(links, tasks=tasks), "join-known", tasks)

    entries = written(_mixed(index, known), "join-mixed", tasks)
    crowded, seen = _crowded(entries), False
    for seed in range(ROUNDS):
        crowded = written(crowded, "join-crowded", tasks)
        if crowded.isEmpty():
            break
        pairs = written(_without(_to_heads(crowded, seed), tried), "join-heads", tasks)
        new = written(_verified(docs, index, pairs, tasks), "join-links", tasks)
        tried = tried.union(pairs)
        if new.isEmpty():
            break
        links, seen = links.union(new), True
        known = written(components(links, tasks=tasks), "join-known", tasks)
        crowded = _crowded(_mixed(crowded, known))
    if seen:  # lists only lose components, so those that had one need no second look
        entries = written(_mixed(entries, known), "join-mixed", tasks)
    more = written(_without(_other_pairs(entries), tried), "join-pairs", tasks)
    late = written(_verified(docs, index, more, tasks), "join-late", tasks)
    several = _several_classes(first)
    found = components(links.union(late).union(several), tasks=tasks)

    kept = first.where("bucket is null").select("doc_id", "n", "p1", "p2")
    reps = kept.where("n > 0 and doc_id is not null").groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep"))
    placed = kept.join(reps, ["p1", "p2", "n"], "left").join(found, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _several_classes(first: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    rows = first.where("bucket is null and n > 0 and doc_id is not null")
    reps = rows.groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep"))
    twice = rows.groupBy("doc_id").agg(F.min(F.struct("p1", "p2", "n")).alias("x"), F.max(F.struct("p1", "p2", "n")).alias("y")).where("x <> y").select("doc_id")
    of = rows.join(twice, "doc_id").join(reps, ["p1", "p2", "n"]).groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    return of.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")).where("a <> b")


def _without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.select("a", "b").union(tried.select("b", "a"))
    return pairs.join(both, ["a", "b"], "left_anti")


def _mixed(index: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, the largest marked ``main``, with their size's band."""
    labelled = index.select("token", "id", "n", "pos").join(known, F.col("id") == F.col("node"), "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    of_list, of_part = Window.partitionBy("token"), Window.partitionBy("token", "c")
    mixed = labelled.withColumn("low", F.min("c").over(of_list)).withColumn("high", F.max("c").over(of_list)).where("low <> high")
    sized = mixed.withColumn("here", F.count("*").over(of_part)).withColumn("top", F.max(F.struct("here", "c")).over(of_list)["c"])
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT))).cast("int")
    return sized.select("token", "id", "n", "pos", "c", (F.col("c") == F.col("top")).alias("main"), band.alias("band"))


def _crowded(entries: DataFrame) -> DataFrame:
    """The lists with so many entries outside their largest component that their pairs would be very many."""
    rest = F.count_if(~F.col("main")).over(Window.partitionBy("token"))
    return entries.withColumn("rest", rest).where(F.col("rest") > DENSE).drop("rest")


def _to_heads(entries: DataFrame, seed: int) -> DataFrame:
    """Each entry outside the largest component of its list, with one entry of that component."""
    drawn = F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "n", "pos"))
    heads = entries.where("main").groupBy("token").agg(drawn.alias("head"))
    pairs = entries.where("not main").join(heads, "token").where(_compatible(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos")))
    return pairs.select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct()


def _other_pairs(entries: DataFrame) -> DataFrame:
    """Candidate pairs of different components, by blocks of the index."""
    asks = entries.where("not main").select("token", *(F.col(k).alias(f"x_{k}") for k in ("id", "n", "pos", "c")), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    differ = (F.col("x_c") != F.col("c")) & (F.col("main") | (F.col("x_id") < F.col("id")))
    pairs = asks.join(entries, ["token", "band"]).where(differ & _compatible(F.col("x_n"), F.col("n"), F.col("x_pos"), F.col("pos")))
    return pairs.select(F.col("x_id").alias("a"), F.col("id").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component; rows without doc_id stay.

    Of rows that share a doc_id, the one with the smallest text stays, nulls first.
    """
    found = join(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows"))
    keep = written(found, "join-keep")
    columns, known = [docs[c] for c in docs.columns], docs["doc_id"].cast("long") == keep["_keep"]
    single = docs.join(keep.where("_rows = 1"), known, "left_semi").select(*columns)
    several = docs.join(keep.where("_rows > 1"), known, "left_semi").select(*columns)
    place = fresh(docs, "_place")
    ranked = several.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns)))))
    return single.union(ranked.where(F.col(place) == 1).drop(place)).union(docs.where("doc_id is null"))
