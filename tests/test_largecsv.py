"""CSV files read in splits beside Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from inkblot.sources.largecsv import cells, read_large_csv

ROWS = ["a,b", "", ",", '"a","b"', '"a""b",c', '"a,b"', '"a\nb",c', 'a"b,c', '"a"b,c', '"a" ,"b"', '"",""', '""""', '"a""', 'é😀,"ü\n\n"', " a , b ", '"x\r\ny"', 'a,"b', "5\" pipe,'q'"]


def plain(text):
    return [row for row in csv.reader(io.StringIO(text, newline=""))]


def test_cells(spark):
    df = spark.createDataFrame([(r,) for r in ROWS], "r string")
    for r in df.select("r", cells(F.col("r")).alias("c")).collect():
        assert [r.c] == (plain(r.r) or [[]]), r.r


def make(rng, n):
    cell = lambda: rng.choice(["", "a", "10.0.0.1", '"q"', '"a,b"', '"l1\nl2"', '"""x"""', '"\n"', '"a""\nb"', 'b"c', "é", '"z"t'])
    return "".join(",".join(cell() for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\r\n", "\n", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("split", [40, 300, 1 << 20])
def test_files_in_splits(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"f{i}.csv": make(rng, 120) for i in range(3)} | {"one.csv": '"' + "x,\n" * 200 + '",end\nlast', "open.csv": 'a,b\n"never\nclosed'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_large_csv(spark, str(tmp_path))
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in df.orderBy("_path", "_order").collect():
            got.setdefault(r["_path"].rsplit("/", 1)[1], []).append(r.cells)
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {name: plain(text) for name, text in texts.items()}
    assert split > 1000 or parts > 8
