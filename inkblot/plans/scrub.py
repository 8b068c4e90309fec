"""Scan, scrub and vault over tables and streams of documents.

Everything here is a projection over the documents: it adds no shuffle, and runs unchanged on a
stream. ``docs`` has an id and a text, and may have ``kind`` (``CODE`` or ``DOC``) or ``path``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty, let
from inkblot.functions.routing import kind_of
from inkblot.operators.context import suspicious_literals
from inkblot.operators.detect import FINDING, findings_of
from inkblot.operators.findings import allow_large
from inkblot.operators.manyrules import add_rules, with_rule_index
from inkblot.operators.models import add_model
from inkblot.operators.names import add_names, name_labels
from inkblot.operators.resolve import PLACED, number, resolve, rewrite
from inkblot.operators.sites import native_literals
from inkblot.rules import ScanConfig


@lru_cache(maxsize=64)
def _findings(kind: str, config: ScanConfig, text_col: str, literals_col: str | None) -> Column:
    """Rule sets make long expressions; each is built once."""
    literals = F.col(literals_col) if literals_col else None
    return findings_of(F.col(text_col), kind, config, literals)


def with_kind(docs: DataFrame, kind: str | None = None) -> DataFrame:
    if kind is not None:
        return docs.withColumn("kind", F.lit(kind))
    if "kind" in docs.columns:
        return docs
    return docs.withColumn("kind", kind_of(F.col("path")) if "path" in docs.columns else F.lit("DOC"))


def scan(
    docs: DataFrame, config: ScanConfig | None = None, kind: str | None = None, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``kind`` and ``findings``: every finding, in resolving order.

    Give ``kind`` when all documents are of one, and only its rules enter the plan. Lists that are too
    long for the plan are joined, by what rows hold and not by ``id_col``, which may be null or repeated;
    all else is worked out inside the row.
    """
    config = (config or ScanConfig()).tables(docs.sparkSession)
    if config.names_table is not None and not config.joined_labels:
        config = replace(config, joined_labels=name_labels(config.names_table))
    config = with_rule_index(config)
    one_kind = kind or ("DOC" if not {"kind", "path"} & set(docs.columns) else None)
    routed = with_kind(docs, one_kind)
    if one_kind is None and (config.names_table is not None or config.rules_index is not None):
        parts = [scan(routed.where(F.col("kind") == k), config, k, text_col, id_col) for k in ("CODE", "DOC")]
        return parts[0].unionByName(parts[1])
    found = _in_row(routed, replace(config, ignore_table=None, names_table=None, rules_index=None, model=None), one_kind, text_col)
    if config.rules_index is not None:
        found = add_rules(found, config.rules_index, one_kind, config, text_col)
    if config.names_table is not None:
        found = add_names(found, config.names_table, one_kind, config, text_col)
    if config.model is not None:
        found = add_model(found, config.model, config, text_col)
    if config.ignore_table is not None:
        found = allow_large(found, config.ignore_table, text_col)
    return found


def _in_row(routed: DataFrame, config: ScanConfig, one_kind: str | None, text_col: str) -> DataFrame:
    if one_kind == "DOC":
        found = _findings("DOC", config, text_col, None)
        return routed.withColumn("findings", F.when(F.col(text_col).isNotNull(), found).otherwise(empty(FINDING)))
    read = native_literals if config.native_sites else suspicious_literals
    literals = read(F.col(text_col), F.col("kind") == "CODE", config.suspicious)
    routed = routed.withColumn("_literals", literals)
    found = _findings("CODE", config, text_col, "_literals")
    if one_kind is None:
        found = F.when(F.col("kind") == "CODE", found).otherwise(_findings("DOC", config, text_col, None))
    found = F.when(F.col(text_col).isNotNull(), found).otherwise(empty(FINDING))
    return routed.withColumn("findings", found).drop("_literals")


def scrub_scanned(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """A scan with its text rewritten, and ``placed``: what was replaced by which placeholder."""
    text = F.col(text_col)

    def placed_and_text(kept: Column) -> Column:
        return let(
            number(F.array(kept)),
            lambda placed: F.struct(placed.alias("placed"), rewrite(text, placed).alias("text")),
        )

    nothing = F.struct(empty(PLACED).alias("placed"), text.alias("text"))
    result = F.when(F.size("findings") > 0, let(resolve(F.col("findings")), placed_and_text)).otherwise(nothing)
    done = scanned.withColumn("_scrubbed", result)
    return (
        done.withColumn(text_col, F.col("_scrubbed.text")).withColumn("placed", F.col("_scrubbed.placed"))
        .withColumn("engine", F.col("kind")).drop("_scrubbed")
    )


def scrub(
    docs: DataFrame, config: ScanConfig | None = None, kind: str | None = None,
    text_col: str = "text", keep_vault: bool = True, id_col: str = "doc_id",
) -> DataFrame:
    """Documents with placeholders for what was found; one-way unless the vault is kept.

    With the vault, ``findings`` and ``placed`` stay on the row: write the texts and
    :func:`vault_table` to separate places.
    """
    done = scrub_scanned(scan(docs, config, kind, text_col, id_col), text_col)
    return done if keep_vault else done.drop("findings", "placed", "kind")


def vault_table(scrubbed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, placeholder, label, n, original``: what restoring needs. Holds secrets."""
    rows = scrubbed.select(id_col, F.explode_outer("placed").alias("p")).where("p is not null")
    return rows.select(id_col, "p.placeholder", "p.label", "p.n", "p.original")


def placed_table(scrubbed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The findings that were kept, where they stood in the original, and their placeholders."""
    rows = scrubbed.select(id_col, F.explode_outer("placed").alias("p")).where("p is not null")
    return rows.select(id_col, "p.leaf", "p.start", "p.end", "p.label", "p.n", "p.placeholder")
