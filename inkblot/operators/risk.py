"""Risk: findings, before overlaps are resolved, weighed and totalled for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.operators.findings import in_scan_order, with_copies

# Lower bounds of the bands above SAFE, the score above which a report is flagged,
# and the length of lists and snippets in a report.
BANDS = ((100, "CRITICAL"), (50, "HIGH"), (20, "MEDIUM"))
LOWEST_BAND = "LOW"
ALERT_ABOVE = 50
LISTED = 10
SNIPPET_LENGTH = 27


def band(score: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score == 0, "SAFE").otherwise(out)


def count_of(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0).cast("bigint"), lambda n, f: n + f["copies"])


def score_of(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0).cast("bigint"), lambda n, f: n + f["weight"] * f["copies"].cast("bigint"))


def _rated(df: DataFrame) -> DataFrame:
    return df.withColumn("band", band(F.col("score"))).withColumn("alert", F.col("score") > ALERT_ABOVE)


def risk(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of findings, score, band, alert. Works inside the row: no shuffle."""
    return _rated(
        scanned.select(id_col, count_of(F.col("findings")).alias("n_findings"), score_of(F.col("findings")).alias("score"))
    )


def risk_of_table(findings: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same from a stored findings table; documents without findings are SAFE."""
    totals = findings.groupBy(id_col).agg(
        F.sum(F.col("copies").cast("bigint")).alias("n_findings"),
        F.sum(F.col("weight") * F.col("copies").cast("bigint")).alias("score"),
    )
    return _rated(docs.select(id_col).join(totals, id_col, "left").na.fill(0, ["n_findings", "score"]))


def short(snippet: Column) -> Column:
    line = F.regexp_replace(F.replace(snippet, F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(line) > SNIPPET_LENGTH, F.concat(F.substring(line, 1, SNIPPET_LENGTH), F.lit("..."))).otherwise(line)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first findings of each document as a reader sees them, and how many more there are."""
    ordered = with_copies(in_scan_order(F.col("findings"), F.col("kind")), LISTED)
    listed = scanned.select(
        id_col,
        F.greatest(count_of(F.col("findings")) - LISTED, F.lit(0)).alias("more"),
        F.posexplode_outer(F.slice(ordered, 1, LISTED)).alias("pos", "f"),
    ).where("f is not null")
    return listed.select(id_col, (F.col("pos") + 1).alias("rank"), "f.label", short(F.col("f.snippet")).alias("snippet"), "more")
