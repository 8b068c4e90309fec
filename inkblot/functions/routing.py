"""Which engine and which format a path calls for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source code, and those read as plain text.
CODE_EXTENSIONS = (".py",)
PLAIN_EXTENSIONS = ("js", "ts", "yaml", "yml")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; none for names that only begin with dots."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1))


def kind_of(path: Column) -> Column:
    return F.when(extension(path).isin(*CODE_EXTENSIONS), "CODE").otherwise("DOC")


def format_of(path: Column) -> Column:
    ext = F.replace(extension(path), F.lit("."), F.lit(""))
    return F.when(ext.isin(*PLAIN_EXTENSIONS), "txt").otherwise(ext)
