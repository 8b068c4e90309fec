"""Reading documents, pages and CSV tables."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkblot.functions.routing import format_of, kind_of
from inkblot.operators.structured import BLOCK_ROWS

# The helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pages of one document joined in the first of two steps.
PAGES_PER_CHUNK = 256


@F.pandas_udf(T.StringType())
def _decode_valid_part(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 with invalid bytes left out, and every line end as ``\\n``.

    Only files that do hold invalid bytes are sent to Python.
    """
    text = content.cast("string")
    valid = F.call_function("is_valid_utf8", text)
    whole = F.when(valid, text).otherwise(_decode_valid_part(F.when(~valid, content)))
    return F.regexp_replace(whole, r"\r\n?", "\n")


def read_documents(spark: SparkSession, path: str, strict: bool = False, **options: str) -> DataFrame:
    """Files as documents: ``doc_id, path, kind, fmt, text, error``.

    With ``strict``, a file that is not valid UTF-8 has no text but an ``error``; otherwise its
    invalid bytes are dropped.
    """
    files = spark.read.format("binaryFile").options(**options).load(path)
    valid = F.call_function("is_valid_utf8", F.col("content").cast("string"))
    bad = ~valid if strict else F.lit(False)
    return files.select(
        # 128 bits: an id that two files share would give one the originals of the other
        F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 32).alias("doc_id"),
        "path",
        kind_of(F.col("path")).alias("kind"),
        format_of(F.col("path")).alias("fmt"),
        F.when(~bad, decode_text(F.col("content"))).alias("text"),
        F.when(bad, F.lit("invalid UTF-8")).alias("error"),
    )


def assemble_pages(
    pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text"
) -> DataFrame:
    """Page texts joined with line feeds into one document each, in page order.

    Chunks of pages are joined first, so that a document of very many pages is put together from
    few pieces and not gathered page by page in one task.
    """

    def joined(order: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(F.col(order), F.coalesce(text_col, F.lit("")).alias("text"))))
        return F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias(text_col)

    chunked = pages.withColumn("_chunk", F.floor(F.col(page_col) / PAGES_PER_CHUNK))
    return chunked.groupBy(id_col, "_chunk").agg(joined(page_col)).groupBy(id_col).agg(joined("_chunk"))


def _cells(texts: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Lines, or whole files, taken apart: each row's cells with its number in the line or file."""
    for batch in texts:
        taken, numbers, cells = [], [], []
        # cells may have any length here; the limit is the worker's, which others read too
        limit = csv.field_size_limit(sys.maxsize)
        try:
            for i, text in enumerate(batch.column("value").to_pylist()):
                rows = csv.reader(io.StringIO(text, newline="")) if whole else [next(csv.reader([text]), [])]
                for number, row in enumerate(rows):
                    taken.append(i)
                    numbers.append(number)
                    cells.append(row)
        finally:
            csv.field_size_limit(limit)
        rest = batch.select(["_path", "_begin", "_line"]).take(pa.array(taken, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["_path", "_begin", "_line", "_number", "cells"])


def read_csv_rows(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV files as tables of strings, header row included, for :func:`scrub_table`.

    Rows keep all their cells, however many the first one has, and empty lines are rows without cells:
    there are as many columns ``_c0, _c1, ..`` as the longest row has cells, with nulls where a row ends
    before. Adds ``_path`` (the scope), ``_order`` and ``_part`` (its blocks). Files without line feeds in
    quoted cells can be read with ``multiline=False``, which lets large ones be split.
    """
    texts = spark.read.text(path, wholetext=multiline).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_begin"),
        F.monotonically_increasing_id().alias("_line"),
    )
    taken = texts.mapInArrow(lambda rows: _cells(rows, multiline), "_path string, _begin long, _line long, _number long, cells array<string>")
    width = taken.agg(F.max(F.size("cells"))).first()[0] or 0
    # rows of a split are consecutive, and splits of a file are in order of their first byte
    row = F.struct(F.col("_begin").alias("begin"), F.col("_line").alias("line"), F.col("_number").alias("row"))
    block = F.struct(
        F.col("_begin").alias("begin"), F.floor(F.col("_line") / BLOCK_ROWS).alias("block"), F.floor(F.col("_number") / BLOCK_ROWS).alias("rows"),
    )
    return taken.select(*(F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(width)), "_path", row.alias("_order"), block.alias("_part"))
