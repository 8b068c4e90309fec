"""A user's entity model within a scan: people, places and other entities that no pattern tells.

The model is loaded once in each Python worker and gets texts batch by batch (Arrow). It returns spans; those
that do not lie within their text, are empty, or have a label the model did not announce are left out.
What is kept joins the other findings in resolving order, after the detectors of the scan.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty
from inkblot.operators.detect import FINDING, looks_like_person
from inkblot.rules import ScanConfig

# The helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Span = tuple[int, int, str]  # start and end in code points, half open, and the label
Predict = Callable[[Sequence[str]], Sequence[Sequence[Span]]]
SPANS = "array<struct<start:int,end:int,label:string>>"


@dataclass(frozen=True)
class EntityModel:
    """``load()`` gives a function from texts to the spans in each; ``labels`` are what it may find."""

    load: Callable[[], Predict]
    labels: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.labels or any(not name or any(c in "<>" for c in name) for name in self.labels):
            raise ValueError("a model needs the labels that it finds, without '<' and '>'")


@lru_cache(maxsize=4)
def _loaded(pickled: bytes) -> Predict:
    """Workers live on from task to task, and so does what they loaded."""
    return cloudpickle.loads(pickled)()


def spans_of(text: Column, model: EntityModel) -> Column:
    """What the model finds in each text, as it says it."""
    pickled = cloudpickle.dumps(model.load)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _loaded(pickled)
        for texts in batches:
            known = texts.notna()
            answers = list(predict(texts[known].tolist())) if known.any() else []
            if len(answers) != int(known.sum()):
                raise ValueError(f"the model gave {len(answers)} answers for {int(known.sum())} texts")
            out = pd.Series([[] for _ in range(len(texts))], dtype=object)
            for i, spans in zip(known.to_numpy().nonzero()[0].tolist(), answers):
                out.iat[i] = [{"start": int(s), "end": int(e), "label": str(label)} for s, e, label in spans]
            yield out

    found.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(found, SPANS).asNondeterministic()(text)


def add_model(scanned: DataFrame, model: EntityModel, config: ScanConfig | None = None, text_col: str = "text") -> DataFrame:
    """A scan with the findings of a model."""
    config = config or ScanConfig()
    text = F.col(text_col)
    first = 1 + max(r.ordinal for kind in ("CODE", "DOC") for r in config.rules(kind))
    labels = list(dict.fromkeys(model.labels))

    def by_label(label: Column, values: Sequence[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("int"))

    def finding(s: Column) -> Column:
        snippet = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        begin = F.octet_length(F.substring(text, F.lit(1), s["start"]))
        rank = F.when(F.col("kind") == "CODE", -by_label(s["label"], [config.priority(x) for x in labels])).otherwise(0)
        return F.struct(
            (-s["start"]).alias("from_end"), rank.alias("rank"), (by_label(s["label"], range(len(labels))) + first).alias("ordinal"), F.lit(0).alias("sub"),
            s["start"].alias("start"), s["end"].alias("end"), begin.alias("bstart"), (begin + F.octet_length(snippet)).alias("bend"),
            s["label"].alias("label"), snippet.alias("snippet"), F.lit("model").alias("detector"), by_label(s["label"], [config.weight(x) for x in labels]).alias("weight"), F.lit(1).alias("copies"),
        ).cast(FINDING)

    inside = F.filter("_spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & s["label"].isin(labels))
    # several answers for one span and label are one finding
    found = F.transform(F.array_distinct(inside), finding)
    if config.ignore:
        found = F.filter(found, lambda f: ~f["snippet"].isin(sorted(config.ignore)))
    if "PERSON" in labels:
        found = F.filter(found, lambda f: (F.col("kind") != "CODE") | (f["label"] != "PERSON") | looks_like_person(f["snippet"]))
    read = scanned.withColumn("_spans", spans_of(text, model))
    merged = F.sort_array(F.concat("findings", F.coalesce(found, empty(FINDING))))
    return read.withColumn("findings", merged).drop("_spans")
