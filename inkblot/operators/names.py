"""Person and place names from a list too large to travel in the plan: a join on word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import empty
from inkblot.functions.bitmap import BitMap
from inkblot.functions.spans import ngram_hits, ngram_key, place
from inkblot.operators.detect import FINDING, looks_like_person
from inkblot.operators.findings import content_key
from inkblot.rules import CODE_ENTITIES, DOC_ENTITIES, ScanConfig


def name_table(names: DataFrame) -> DataFrame:
    """``names(value, label)`` as distinct look-up keys with their number of words."""
    # trimmed of what separates words, as short lists are
    key = F.trim(ngram_key(F.col("value")))
    keyed = names.select(key.alias("key"), F.col("label").alias("name_label")).where("key <> ''").distinct()
    return keyed.withColumn("words", F.size(F.split("key", " ")))


def name_labels(names: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(r["label"] for r in names.select("label").distinct().collect() if r["label"] is not None))


def name_sizes(listed: DataFrame) -> list[int]:
    """How many words the names of a list have: a few small numbers, so every name can be found."""
    return sorted(r["words"] for r in listed.select("words").distinct().collect())


def name_spans(docs: DataFrame, names: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text") -> DataFrame:
    """Where listed names occur: ``id, start, end, bstart, bend, snippet, name_label, words``.

    Runs of words of every size that the list has are taken in one pass over the texts. A bit map of the
    list's keys turns down nearly all that are not in it, inside the row. Of the others, only place and key
    are shuffled, never the texts, and Spark broadcasts a list that is small in bytes.
    """
    listed = name_table(names)
    sizes = name_sizes(listed)
    known = BitMap(listed.select("key").distinct(), "key")
    hits = ngram_hits(F.col(text_col), {n: known.may_have for n in sizes or [1]})
    spans = F.flatten(F.transform(hits, lambda h, i: F.transform(place(h), lambda s: F.struct(s.alias("s"), i.alias("i")))))
    ids = [id_col] if isinstance(id_col, str) else id_col
    rows = docs.select(*ids, F.explode_outer(spans).alias("x")).where("x is not null")
    grams = rows.select(*ids, "x.s.*", F.get(F.array(*map(F.lit, sizes or [1])), F.col("x.i")).alias("words"))
    return grams.withColumn("key", ngram_key(F.col("snippet"))).join(listed, ["key", "words"]).drop("key")


def name_findings(docs: DataFrame, names: DataFrame, kind: str, config: ScanConfig, ids: list[str], text_col: str = "text") -> DataFrame:
    """``ids`` and ``f``: the findings of a name list in texts of one engine."""
    labels = CODE_ENTITIES if kind == "CODE" else DOC_ENTITIES
    # ordinals as if the names had been part of the rule set
    planned = (config if config.joined_labels else config.with_names([("x", "PERSON"), ("x", "LOCATION")])).rules(kind)
    rules = {r.label: r for r in planned if r.detector == "names" and r.label in labels}
    hits = name_spans(docs, names, ids, text_col).where(F.col("name_label").isin(list(rules)))
    if kind == "CODE":
        hits = hits.where((F.col("name_label") != "PERSON") | looks_like_person(F.col("snippet")))
    if config.ignore:
        hits = hits.where(~F.col("snippet").isin(sorted(config.ignore)))

    def by_label(value):
        out = F.lit(None).cast("int")
        for label, rule in rules.items():
            out = F.when(F.col("name_label") == label, F.lit(value(rule))).otherwise(out)
        return out

    finding = F.struct(
        (-F.col("start")).alias("from_end"), by_label(lambda r: -r.priority).alias("rank"),
        by_label(lambda r: r.ordinal).alias("ordinal"), F.lit(0).alias("sub"),
        "start", "end", "bstart", "bend", F.col("name_label").alias("label"), "snippet",
        F.lit("names").alias("detector"), by_label(lambda r: r.weight).alias("weight"), F.lit(1).alias("copies"),
    ).cast(FINDING)
    return hits.select(*ids, finding.alias("f"))


def add_names(
    scanned: DataFrame, names: DataFrame, kind: str, config: ScanConfig | None = None, text_col: str = "text",
) -> DataFrame:
    """A scan (of one engine) with the findings of a name list joined in.

    They depend on the text alone, so its hash is what they come back by: ids may be null or repeated.
    """
    keyed = scanned.withColumn("_key", content_key(F.array(text_col)))
    hits = name_findings(keyed, names, kind, config or ScanConfig(), ["_key"], text_col)
    # bounded by the words of the one text; rows of the same text bring the same findings
    per_text = hits.groupBy("_key").agg(F.collect_set("f").alias("_names"))
    joined = keyed.join(per_text, "_key", "left").drop("_key")
    merged = F.sort_array(F.concat("findings", F.coalesce("_names", empty(FINDING))))
    return joined.withColumn("findings", merged).drop("_names")
