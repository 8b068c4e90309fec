"""Near duplicates among embeddings by product quantisation.

Vectors of one label are compared by cosine. A coarse quantiser (k-means over a bounded sample) deals them
to inverted lists; the rest, what a vector differs by from its list's centre, is coded by sub-spaces, a byte
each, and the error of the code is kept with it. A vector asks its own list and every list whose border is
near: two linked vectors are at most ``reach`` apart, and a list is left out only if the border to it is
farther away than ``margin``. With ``margin = reach`` no link can be missed. The default is half of that:
in many dimensions, hardly any of the difference between two vectors lies along the line to a border.

In a list, asymmetric distances come from one table for each asking vector and sub-space; a coded vector is
passed over only if its inner product plus the error of its code stays below the threshold, so that nothing
is lost there. What remains is compared exactly: the cosine in double precision, of the original vectors.

Equal vectors of a label are one class, compared once and counted as often as they occur. Lists are cut
into blocks, and groups of a task hold two of them; pairs are added up where they are found: a count for
each vector and the edges of a forest go on, never the pairs. So a crowded list costs time, but no memory.

Vectors that are null or zero, hold null or non-finite components, have no label or no id link with
nothing; without id the component is null and the row is kept. Vectors of another length than most are
compared too, with those of their length, in one list and exactly. Repeated rows are vectors of their own; rows that share an id
share it in the result only. Components of any finite size are scaled first, so that no square overflows.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.llm.common import components, lean_batches, lean_keyed_pair, small_batches, written

THRESHOLD, PARTS, CODES = 0.98, 8, 256
SAMPLE, LIST, MOST_LISTS, BLOCK, ROWS = 16_384, 1_024, 1_024, 2_048, 128
SLACK = 1e-9  # sums of products in another order


def lloyd(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of k-means, from distinct points drawn by a fixed seed; an empty one is put on a far point."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.sort(rng.choice(len(distinct), k, replace=False))]
    for _ in range(rounds if k < len(distinct) else 0):
        near, gap = nearest(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        there = counts > 0
        centres[there] = sums[there] / counts[there, None]
        lost = np.flatnonzero(~there)
        centres[lost] = points[np.argsort(-gap, kind="stable")[: len(lost)]]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.einsum("ij,ij->i", points, points)[:, None] - 2 * points @ centres.T + np.einsum("ij,ij->i", centres, centres))


def nearest(points: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    near, gap = np.zeros(len(points), np.int64), np.zeros(len(points))
    for at in range(0, len(points), step):
        d = squared(points[at : at + step], centres)
        near[at : at + step] = d.argmin(axis=1)
        gap[at : at + step] = d.min(axis=1)
    return near, gap


class Quantiser:
    """Centres of the lists, and the codebook of each sub-space."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES):
        self.centres = lloyd(sample, lists)
        near, _ = nearest(sample, self.centres)
        rest = sample - self.centres[near]
        self.bounds = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [lloyd(rest[:, a:b], codes) for a, b in self.spaces()]

    def spaces(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()))

    def place(self, points: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the other lists whose border is within the margin."""
        d = squared(points, self.centres)
        home = d.argmin(axis=1)
        between = np.sqrt(squared(self.centres, self.centres))[home]
        beyond = d - d[np.arange(len(points)), home][:, None] <= 2 * margin * between
        beyond[np.arange(len(points)), home] = False
        return home, [np.flatnonzero(row) for row in beyond]

    def code(self, points: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each sub-space, and how far the coded vector is from the original."""
        rest = points - self.centres[home]
        codes, lost = np.zeros((len(points), len(self.books)), np.uint8), np.zeros(len(points))
        for i, ((a, b), book) in enumerate(zip(self.spaces(), self.books)):
            near, gap = nearest(rest[:, a:b], book)
            codes[:, i] = near
            lost += ((rest[:, a:b] - book[near]) ** 2).sum(axis=1)
        return codes, np.sqrt(lost)

    def products(self, asking: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of asking vectors with coded ones of a list, from a table for each sub-space."""
        out = np.repeat((asking @ self.centres[home])[:, None], len(codes), axis=1)
        for i, ((a, b), book) in enumerate(zip(self.spaces(), self.books)):
            out += (asking[:, a:b] @ book.T)[:, codes[:, i]]
        return out


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors.astype(float)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the key of their vector (null: takes no part), and one row for each distinct key."""
    v = F.col("embedding")
    takes_part = usable(v) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = vectors.schema["embedding"].dataType.simpleString()
    plus = F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).cast(kind)  # no zero below zero
    key = F.sha2(F.concat_ws("/", F.col("label").cast("string"), plus.cast("string")).cast("binary"), 256)
    rows = vectors.select("vec_id", F.when(takes_part, key).alias("key"), F.when(takes_part, F.struct(F.col("label").cast("string").alias("label"), plus.alias("v"))).alias("x"))
    of_key = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("x").alias("x"))
    numbered = of_key.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "many", "x.label", "x.v", F.size("x.v").alias("n"))
    return rows.select("vec_id", "key"), written(numbered, "pq-classes")


def fit(classes: DataFrame, size: int, per_label: int, sample: int = SAMPLE, lists: int = LIST) -> Quantiser:
    """A quantiser for vectors of the usual length, from at most ``sample`` of them, those with the least hash."""
    some = classes.where(F.col("n") == size).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toPandas()
    units = _units(np.array(some["v"].tolist()))
    return Quantiser(units, int(min(MOST_LISTS, max(1, per_label // lists), max(1, len(units) // 16))))


def _joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each part, when the pairs (a, b) are joined too."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    while (root != root[root]).any():
        root = root[root]
    return root


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None, block: int = BLOCK, lists: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, classes = classes_of(vectors)
    sizes = classes.groupBy("n", "label").agg(F.count("*").alias("c")).groupBy("n").agg(F.sum("c").alias("c"), F.max("c").alias("most"))
    usual = sizes.orderBy(F.desc("c"), "n").first()
    if usual is None:
        return _result(rows, classes.select("cid", "key", "rep", "many", F.lit(0).cast("long").alias("links"), "rep"))
    size = usual["n"]
    quantiser = fit(classes, size, usual["most"], lists=lists)  # of bounded size, so it travels with the tasks
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    margin = reach / 2 if margin is None else margin

    kind = classes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(4).to_numpy()
            for n in np.unique(lengths).tolist():
                part = b.take(pa.array(np.flatnonzero(lengths == n)))
                units = _units(_matrix(part.column(3)))
                if n == size:
                    home, probes = quantiser.place(units, margin)
                    codes, lost = quantiser.code(units, home)
                else:  # one list, without codes
                    home, probes, codes, lost = np.zeros(len(units), int), [np.zeros(0, int)] * len(units), np.zeros((len(units), 0), np.uint8), np.zeros(len(units))
                columns = [
                    part.column(0), part.column(1), part.column(2), pa.array(lengths[lengths == n]), pa.array(home, pa.int32()), pa.array(probes, pa.list_(pa.int32())),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost), part.column(3),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "many", "label", "n", "home", "probes", "code", "lost", "v"])

    placed = written(classes.select("cid", "many", "label", "v", "n").mapInArrow(
        lean_batches(place), f"cid long, many long, label string, n int, home int, probes array<int>, code binary, lost double, v {kind}"), "pq-placed")
    asks = placed.withColumn("list", F.explode(F.array_prepend("probes", F.col("home"))))
    # a row for each list: into how many blocks its members and those that ask it fall
    at = ["label", "n", "list"]
    parts = asks.groupBy(at).agg(
        F.ceil(F.greatest(F.count_if(F.col("list") == F.col("home")), F.lit(1)) / block).cast("int").alias("_held"), F.ceil(F.count("*") / block).cast("int").alias("_asking"))
    spot = F.xxhash64("cid")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asking = asks.select(*at, "cid", "many", "home", "v").join(parts, at).withColumn("hb", every("_held")).withColumn("qb", F.pmod(spot, F.col("_asking")).cast("int"))
    held = placed.withColumnRenamed("home", "list").select(*at, "cid", "many", "probes", "code", "lost", "v").join(parts, at)
    held = held.withColumn("qb", every("_asking")).withColumn("hb", F.pmod(spot, F.col("_held")).cast("int"))
    group = [*at, "hb", "qb"]
    asking, held = (x.drop("_held", "_asking").select(*(F.col(c).alias(c) for c in x.columns if c[0] != "_")) for x in (asking, held))

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        here = key[2].as_py() if hasattr(key[2], "as_py") else key[2]
        n = key[1].as_py() if hasattr(key[1], "as_py") else key[1]
        return found_in(quantiser if n == size else None, here, left, right, threshold)

    found = asking.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(lean_keyed_pair(compare), "cid long, links long, other long")
    found = written(found, "pq-links")
    parts_of = components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "key", "rep", "many").join(counted, "cid", "left").join(parts_of, F.col("cid") == F.col("node"), "left")
    named = written(named.select("cid", "key", "rep", "many", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "cid").alias("part")), "pq-parts")
    least = named.groupBy("part").agg(F.min("rep").alias("least"))
    return _result(rows, named.join(least, "part").select("cid", "key", "rep", "many", "links", F.col("least")))


def found_in(q: Quantiser | None, here: int, left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Of vectors that ask a list (left) and a block of its members (right): links and edges by class.

    A pair that both lists find counts in the lesser of the two lists only, for both vectors; so does one that
    a single list finds.
    """
    ids, other = left.column("cid").to_numpy(), right.column("cid").to_numpy()
    many, other_many = left.column("many").to_numpy(), right.column("many").to_numpy()
    home = left.column("home").to_numpy()
    cids, links = np.concatenate((ids, other)), np.zeros(len(ids) + len(other), np.int64)
    root = np.arange(len(cids))
    if len(ids) and len(other):
        asking, held = _units(_matrix(left.column("v"))), _units(_matrix(right.column("v")))
        probes = right.column("probes").combine_chunks()
        sizes = np.diff(probes.offsets.to_numpy())
        asked = set(zip(np.repeat(np.arange(len(other)), sizes).tolist(), probes.flatten().to_pylist()))
        lost = right.column("lost").to_numpy()
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(other), -1)
        # whether a member asks the list that an asking vector comes from
        froms = np.unique(home)
        mutual = np.array([[(j, h) in asked for h in froms.tolist()] for j in range(len(other))], bool).reshape(len(other), len(froms))
        of_home = np.searchsorted(froms, home)
        for at in range(0, len(ids), ROWS):
            some = asking[at : at + ROWS]
            if q is None:
                near = some @ held.T >= threshold - SLACK
            else:
                near = q.products(some, here, codes) + lost >= threshold - SLACK
            i, j = np.nonzero(near)
            i = i + at
            true = np.concatenate([np.einsum("ij,ij->i", asking[i[k : k + 65_536]], held[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)] or [np.zeros(0)]) >= threshold
            i, j = i[true], j[true]
            # members of the list ask it too, so their pairs come both ways; other pairs count for both sides here
            own = home[i] == here
            count = np.where(own, ids[i] != other[j], ~mutual[j, of_home[i]] | (home[i] > here))
            i, j, own = i[count], j[count], own[count]
            np.add.at(links, i, other_many[j])
            np.add.at(links, len(ids) + j[~own], many[i[~own]])
            root = _joined_roots(root, i, len(ids) + j)
    there = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    return pa.table({"cid": pa.array(cids[there], pa.int64()), "links": pa.array(links[there]), "other": pa.array(cids[root[there]], pa.int64())})


def _result(rows: DataFrame, named: DataFrame) -> DataFrame:
    of_key = named.toDF("cid", "_key", "rep", "many", "links", "least").select("_key", "many", "links", "least")
    out = rows.join(of_key, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("least", "vec_id")
    links = F.coalesce(F.col("links") + F.col("many") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
