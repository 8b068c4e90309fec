"""CSV files of any size with line feeds in quoted cells, read in splits by native expressions.

Whether a line begins inside a quoted cell depends on all lines before it in the file. But for each line it can
be told what becomes of both cases: it may close the cell or open one, whatever was before, keep the state, or
turn it round. Such steps are put together line by line in a split, and then over one small row for each
split; so no file is read in one piece. Lines that a quoted cell goes over are joined again, and a row is cut
into its cells by one pattern. Python's reader would give the same cells; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty

# A cell: quoted, with what may follow the closing quote, or without a quote in front. Rest of a line: more cells.
_QUOTED = r'"(?:[^"]++|"")*+"(?!")[^,]*+'
_PLAIN = r'(?:[^",][^,]*+)?+'
_CELL = rf"(?:{_QUOTED}|{_PLAIN}(?=,|\z))"
CLOSED_FROM_OUTSIDE = rf"(?s)\A{_CELL}(?:,{_CELL})*+\z"
CLOSED_FROM_INSIDE = rf'(?s)\A(?:[^"]++|"")*+"(?!")[^,]*+(?:,{_CELL})*+\z'
# The cells of a row with a comma before each; only the last one may be quoted and never closed.
CELLS = r'(?s),("(?:[^"]++|"")*+(?:"[^,]*+|\z)|[^,]*+)'


def _cell(c: Column) -> Column:
    """What a cell stands for."""
    whole = r'(?s)\A"((?:[^"]++|"")*+)(?:"([^,]*+))?\z'
    inner = F.replace(F.regexp_extract(c, whole, 1), F.lit('""'), F.lit('"'))
    return F.when(c.startswith('"'), F.concat(inner, F.regexp_extract(c, whole, 2))).otherwise(c)


def cells(row: Column) -> Column:
    return F.when(row == "", empty("string")).otherwise(F.transform(F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(CELLS), F.lit(1)), _cell))


def _state(before: Column, fixed: Column, turns: Column) -> Column:
    """Inside or not, after the steps of a stretch: from its last fixed step, or from the state before it.

    ``fixed``: a struct of that step's state and how many turns there were until then; ``turns``: how many in all.
    """
    return F.when(fixed.isNotNull(), fixed["state"] != ((turns - fixed["turns"]) % 2 == 1)).otherwise(before != (turns % 2 == 1))


def quoted_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (``_path, _begin, _line, value``) with ``_row``: the place of the line that its row begins with."""
    opens, stays = ~F.col("value").rlike(CLOSED_FROM_OUTSIDE), ~F.col("value").rlike(CLOSED_FROM_INSIDE)
    rows = lines.withColumn("_opens", opens).withColumn("_stays", stays).withColumn("_turn", (F.col("_opens") & ~F.col("_stays")).cast("long"))
    in_split = Window.partitionBy("_path", "_begin").orderBy("_line")
    of_file = Window.partitionBy("_path").orderBy("_begin")
    earlier = Window.unboundedPreceding, -1
    upto = F.sum("_turn").over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_turns", upto)
    rows = rows.withColumn("_fixed", F.when(F.col("_opens") == F.col("_stays"), F.struct(F.col("_opens").alias("state"), F.col("_turns").alias("turns"))))

    # a row for each split: what it makes of either state
    splits = rows.groupBy("_path", "_begin").agg(F.max_by("_fixed", F.when(F.col("_fixed").isNotNull(), F.col("_line"))).alias("_fixed"), F.sum("_turn").alias("_turn"))
    splits = splits.withColumn("_turns", F.sum("_turn").over(of_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the state after a split with a fixed step does not depend on what was before it
    ends = F.when(F.col("_fixed").isNotNull(), F.struct(_state(F.lit(False), F.col("_fixed"), F.col("_turn")).alias("state"), F.col("_turns").alias("turns")))
    known = splits.withColumn("_known", F.last(ends, ignorenulls=True).over(of_file.rowsBetween(*earlier))).withColumn("_all", F.coalesce(F.sum("_turn").over(of_file.rowsBetween(*earlier)), F.lit(0)))
    begins = known.select(F.col("_path").alias("_p"), F.col("_begin").alias("_b"), _state(F.lit(False), F.col("_known"), F.col("_all")).alias("_inside"))

    rows = rows.join(begins, (F.col("_path") == F.col("_p")) & (F.col("_begin") == F.col("_b"))).drop("_p", "_b")
    last = F.last("_fixed", ignorenulls=True).over(in_split.rowsBetween(*earlier))
    rows = rows.withColumn("_last", last).withColumn("_starts", ~_state(F.col("_inside"), F.col("_last"), F.col("_turns") - F.col("_turn")))
    here = F.struct(F.col("_begin").alias("begin"), F.col("_line").alias("line"))
    rows = rows.withColumn("_first", F.last(F.when(F.col("_starts"), here), ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = rows.groupBy("_path", "_begin").agg(F.max("_first").alias("_of"))
    firsts = firsts.select(F.col("_path").alias("_p"), F.col("_begin").alias("_b"), F.last("_of", ignorenulls=True).over(of_file.rowsBetween(*earlier)).alias("_open"))
    rows = rows.join(firsts, (F.col("_path") == F.col("_p")) & (F.col("_begin") == F.col("_b")))
    return rows.select(*lines.columns, F.coalesce("_first", "_open").alias("_row"))


def read_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as rows of cells: ``_path, _order, cells``; header row included, empty lines without cells.

    Rows end with a line feed, or a carriage return and a line feed. ``_order`` gives their order in the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_line"), "value",
    )
    in_order = F.sort_array(F.collect_list(F.struct("_begin", "_line", "value")))
    joined = quoted_lines(lines).groupBy("_path", "_row").agg(F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("row"))
    return joined.select("_path", F.col("_row").alias("_order"), cells(F.regexp_replace("row", r"\r\z", "")).alias("cells"))
