"""Findings as arrays and as a table: order, form, allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.bitmap import BitMap
from inkblot.session import stored


def in_scan_order(findings: Column, kind: Column) -> Column:
    """As a scan lists them: sources from the end by rank, documents from the start by rule."""
    forward = F.transform(
        F.sort_array(
            F.transform(
                findings,
                lambda f: F.struct(f["start"].alias("at"), f["ordinal"].alias("o"), f["sub"].alias("s"), f.alias("f")),
            )
        ),
        lambda x: x["f"],
    )
    return F.when(kind == "CODE", findings).otherwise(forward)


def with_copies(findings: Column, at_most: int | None = None) -> Column:
    """Findings that stand for several equal ones, repeated."""
    times = (lambda f: F.least(f["copies"], F.lit(at_most))) if at_most else (lambda f: f["copies"])
    return F.flatten(F.transform(findings, lambda f: F.array_repeat(f, times(f))))


def findings_table(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each finding; ``ord`` is its place in scan order, ``copies`` how often it counts.

    Of a scan by leaves, ``leaf`` says in which leaf its offsets count.
    """
    if "finding_leaves" in scanned.columns:
        paired = F.arrays_zip(F.col("finding_leaves").alias("leaf"), F.col("findings").alias("f"))
        place = lambda x: F.struct(
            x["leaf"].alias("leaf"), F.when(F.col("kind") == "CODE", x["f"]["from_end"]).otherwise(x["f"]["start"]).alias("at"),
            F.when(F.col("kind") == "CODE", x["f"]["rank"]).otherwise(0).alias("rank"), x["f"]["ordinal"].alias("o"), x["f"]["sub"].alias("s"), x["f"].alias("f"),
        )
        ordered = scanned.select(id_col, F.sort_array(F.transform(paired, place)).alias("fs"))
        rows = ordered.select(id_col, F.posexplode_outer("fs").alias("ord", "x")).where("x is not null").select(id_col, "ord", "x.leaf", "x.f")
        return rows.select(id_col, "ord", "leaf", *_fields())
    ordered = scanned.select(id_col, in_scan_order(F.col("findings"), F.col("kind")).alias("fs"))
    # the outer form keeps the optimizer from adding size(fs) > 0, which would detect twice
    rows = ordered.select(id_col, F.posexplode_outer("fs").alias("ord", "f")).where("f is not null")
    return rows.select(id_col, "ord", *_fields())


def _fields() -> list:
    return [
        "f.start", "f.end", "f.label", "f.snippet", "f.detector", "f.ordinal", (-F.col("f.rank")).alias("priority"), "f.weight", "f.copies",
    ]


def findings_json(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, a JSON array of label, start, end and snippet in scan order."""
    listed = F.transform(
        with_copies(in_scan_order(F.col("findings"), F.col("kind"))),
        lambda f: F.struct(
            f["label"].alias("label"), f["start"].alias("start"), f["end"].alias("end"), f["snippet"].alias("snippet")
        ),
    )
    return scanned.select(id_col, F.to_json(listed).alias("findings"))


def drop_allowed(findings: DataFrame, allow: DataFrame) -> DataFrame:
    """Findings whose snippet is not in ``allow(value)``: exact and case-sensitive.

    How to join is left to Spark, which knows the size of the list in bytes: a short one is broadcast,
    and where a value found everywhere makes a partition long, adaptive execution splits it.
    """
    values = allow.select(F.col("value").alias("_value")).where("_value is not null").distinct()
    return findings.join(values, F.col("snippet") == F.col("_value"), "left_anti")


def content_key(texts: Column) -> Column:
    """A hash of an array of texts, null or not: rows with the same texts have the same findings, whatever their ids."""
    hashes = F.transform(texts, lambda t: F.coalesce(F.sha2(t.cast("binary"), 256), F.lit("-")))
    return F.sha2(F.array_join(hashes, ",").cast("binary"), 256)


def with_allowed(keyed: DataFrame, allow: DataFrame, findings: Column) -> DataFrame:
    """Rows with ``_key`` and, in ``_allowed``, the snippets of their findings that are on a long allow-list.

    A bit map of the list turns down most others inside the row. Only the snippets that are allowed go back
    to their rows, as a set for each ``_key``.
    """
    values = allow.select(F.col("value").alias("snippet")).where("snippet is not null").distinct()
    known = BitMap(values, "snippet")
    snippets = F.array_distinct(F.transform(F.filter(findings, lambda f: known.may_have(f["snippet"])), lambda f: f["snippet"]))
    pairs = keyed.select("_key", F.explode_outer(snippets).alias("snippet")).where("snippet is not null")
    hits = pairs.join(values, "snippet", "left_semi")
    per_key = hits.groupBy("_key").agg(F.collect_set("snippet").alias("_allowed"))
    return keyed.join(per_key, "_key", "left")


def without_allowed(findings: Column) -> Column:
    return F.filter(findings, lambda f: ~F.coalesce(F.array_contains("_allowed", f["snippet"]), F.lit(False)))


def allow_large(scanned: DataFrame, allow: DataFrame, text_col: str = "text") -> DataFrame:
    """A scan without the findings of an allow-list too large to travel in the plan.

    The hash of the text is what allowed snippets come back by: ids may be null or repeated.
    """
    # detected once: the join reads the stored rows, originals included
    keyed = stored(scanned.withColumn("_key", content_key(F.array(text_col))), "allow")
    allowed = with_allowed(keyed, allow, F.col("findings"))
    return allowed.withColumn("findings", without_allowed(F.col("findings"))).drop("_allowed", "_key")
