"""Overlaps, placeholders and rewriting over a table of findings, for documents of any number of findings.

The row forms in ``operators.resolve`` hold all findings of a document in one array. Here a finding is a
row. Findings that overlap, directly or through others, make an *island*: a finding begins a new one if it
starts at or after the largest end before it. What is kept in an island does not depend on other islands, so
overlaps are resolved island by island, and an island is as long as its overlaps reach.

Documents are worked through in blocks of offsets: what runs along a document (the largest end, the last
island, the counts of labels, the cut that a finding makes in the next block) runs within a block, and then
over one small row for each block. So no task, array or window holds a whole document's findings, and only
the last step puts a document's pieces next to each other, as the one text that they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.operators.detect import FINDING
from inkblot.operators.resolve import placeholder, resolve
from inkblot.plans.scrub import scan
from inkblot.rules import ScanConfig
from inkblot.session import stored

# Offsets in a block: few blocks for a document, few findings for a block.
BLOCK = 65_536


def _before(ids: list[str], value: Column, backward: bool = False) -> Column:
    """A value run over the blocks before one (or, ``backward``, after it)."""
    order = F.desc("_block") if backward else F.asc("_block")
    return value.over(Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def island_rows(scanned: DataFrame, ids: list[str]) -> DataFrame:
    """A scan as one row for each finding: ``ids`` and the fields of the finding."""
    rows = scanned.select(*ids, F.explode_outer("findings").alias("f")).where("f is not null")
    return rows.select(*ids, "f.*")


def with_islands(found: DataFrame, ids: list[str], block: int = BLOCK) -> DataFrame:
    """Findings (``start``, ``end`` and more) with ``island``: where the first finding of their island starts."""
    rows = found.withColumn("_block", F.floor(F.col("start") / block))
    key = [*ids, "_block"]
    within = Window.partitionBy(*key).orderBy("start", "end")
    ends = rows.groupBy(*key).agg(F.max("end").alias("_top"))
    ends = ends.select(*key, _before(ids, F.max("_top")).alias("_reach"))
    reached = F.greatest("_reach", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = _joined(rows, ends, key)
    rows = rows.withColumn("_first", F.when(F.coalesce(F.col("start") >= reached, F.lit(True)), F.col("start")))
    firsts = rows.groupBy(*key).agg(F.max("_first").alias("_last"))
    firsts = firsts.select(*key, _before(ids, F.max("_last")).alias("_open"))
    rows = _joined(rows, firsts, key)
    # up to all findings of the same start: which of them comes first may differ from one sort to the next
    so_far = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.coalesce(F.max("_first").over(so_far), "_open")
    return rows.withColumn("island", island).drop("_block", "_reach", "_first", "_open")


def _joined(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    renamed = more.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), *(c for c in more.columns if c not in key))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    return rows.join(renamed, same).drop(*(f"_k{i}" for i in range(len(key))))


def resolve_islands(found: DataFrame, ids: list[str], block: int = BLOCK) -> DataFrame:
    """The findings that overlap none kept before them, as one row each."""
    fields = [part.split(":")[0] for part in FINDING.removeprefix("struct<").removesuffix(">").split(",")]
    marked = with_islands(found, ids, block)
    grouped = marked.groupBy(*ids, "island").agg(F.sort_array(F.collect_list(F.struct(*fields).cast(FINDING))).alias("fs"))
    return grouped.select(*ids, F.explode(resolve(F.col("fs"))).alias("f")).select(*ids, "f.*")


def number_islands(kept: DataFrame, ids: list[str], block: int = BLOCK) -> DataFrame:
    """Kept findings with ``n`` and ``placeholder``: per label, from the end of a document to its start."""
    rows = kept.withColumn("_block", F.floor(F.col("start") / block))
    key, of_label = [*ids, "_block", "label"], [*ids, "label"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    counts = counts.select(*key, F.coalesce(_before(of_label, F.sum("_n"), backward=True), F.lit(0)).alias("_later"))
    rows = _joined(rows, counts, key)
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("start"))) + F.col("_later")
    rows = rows.withColumn("n", n.cast("int")).withColumn("placeholder", placeholder(F.col("label"), F.col("n")))
    return rows.drop("_block", "_later")


def rewrite_islands(docs: DataFrame, placed: DataFrame, ids: list[str], text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``ids`` and the text with each placed finding (by byte offsets) replaced by its placeholder.

    Texts are cut into blocks of bytes; a finding belongs to the block that it starts in, and what it
    reaches into the next ones is cut off there.
    """
    octets = F.col(text_col).cast("binary")
    n_blocks = F.greatest(F.ceil(F.octet_length(text_col) / block), F.lit(1)).cast("int")
    cut = docs.where(F.col(text_col).isNotNull()).select(*ids, octets.alias("_octets"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("_block"))
    cut = cut.select(*ids, F.col("_block").cast("long").alias("_block"), F.substring("_octets", F.col("_block") * block + 1, F.lit(block)).alias("_octets"))
    key = [*ids, "_block"]
    spans = placed.withColumn("_block", F.floor(F.col("bstart") / block))
    spans = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("bstart", "bend", "placeholder"))).alias("_spans"), F.max("bend").alias("_last"))
    renamed = spans.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "_spans", "_last")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    pieces = cut.join(renamed, same, "left").select(*key, "_octets", "_spans", "_last")
    pieces = pieces.withColumn("_from", F.greatest(F.coalesce(_before(ids, F.max("_last")), F.lit(0)), F.col("_block") * block))

    def part(begin: Column, end: Column) -> Column:
        at = begin - F.col("_block") * block
        return F.substring("_octets", (at + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")).cast("string")

    spans_or_none = F.coalesce("_spans", F.array().cast("array<struct<bstart:int,bend:int,placeholder:string>>"))
    turns = F.transform(
        spans_or_none,
        lambda p, i: F.concat(part(F.greatest(F.coalesce(F.get(spans_or_none, i - 1)["bend"], F.col("_from")), F.col("_from")), p["bstart"]), p["placeholder"]),
    )
    rest = part(F.greatest("_from", F.coalesce("_last", "_from")), (F.col("_block") + 1) * block)
    pieces = pieces.select(*key, F.array_join(F.concat(turns, F.array(rest)), "").alias("_piece"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_piece"))), lambda x: x["_piece"])
    return pieces.groupBy(*ids).agg(F.array_join(in_order, "").alias(text_col))


def scrub_islands(
    docs: DataFrame, config: ScanConfig | None = None, kind: str | None = None, text_col: str = "text", block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Scrubbed documents, with their other columns, ``kind`` and ``engine``; and what was replaced in them.

    Both come from one detection, which is stored in scratch, originals included. Rows are told apart by
    their place there (``_row``), so ids may be null or repeated; a null text stays null.
    """
    rows = stored(scan(docs, config, kind, text_col).withColumn("_row", F.monotonically_increasing_id()), "islands")
    placed = number_islands(resolve_islands(island_rows(rows, ["_row"]), ["_row"], block), ["_row"], block)
    placed = stored(placed, "islands-placed")
    new = rewrite_islands(rows, placed, ["_row"], text_col, block).withColumnRenamed(text_col, "_new")
    done = rows.drop("findings").join(new, "_row", "left").withColumn(text_col, F.col("_new")).withColumn("engine", F.col("kind"))
    return done.drop("_new"), placed
